from pyspark.sql import functions as F

from sparkwarden.functions.url import SUFFIXES, parsed, suffix_rules, suffix_table

HOSTS = ["a.b.example.co.uk", "example.co.uk", "co.uk", "UK", "x.Example.COM", "www.ck", "a.www.ck", "foo.bar.ck", "bar.ck", "ck", "10.0.0.1", "[::1]", "localhost", "a..com", "", "nothing.unknownsuffix", "deep.a.b.c.d.e.org"]


def listed(tmp_path, rules):
    path = tmp_path / "suffixes.txt"
    path.write_text("// a comment\n\n" + "\n".join(rules) + "\n" + rules[0] + "\n")
    return str(path)


def test_table_gives_what_literals_give(spark, tmp_path):
    path = listed(tmp_path, SUFFIXES)
    urls = [(k, u) for k, u in enumerate([f"http://{h}/p?q" for h in HOSTS] + [None, "", "http://a.com/", "http://a.com/"])]
    df = spark.createDataFrame(urls, "k int, url string")
    every = df.unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select((F.col("page_id") + 1000).cast("int").alias("k"), "url"))
    want = sorted(parsed(every, rules=suffix_rules(spark, path)).collect(), key=repr)
    got = sorted(parsed(every, rules=suffix_table(spark, path)).select("k", "url", "u").collect(), key=repr)
    assert got == want and len(got) == every.count()


def test_many_rules_and_none(spark, tmp_path):
    many = suffix_table(spark, listed(tmp_path, [f"s{k}.net" for k in range(20_000)]))
    df = spark.createDataFrame([(f"http://a.host.s{k}.net/",) for k in (0, 7, 19_999)] + [("http://a.net/",)], "url string")
    assert sorted(r.u.suffix for r in parsed(df, rules=many).collect()) == ["", "s0.net", "s19999.net", "s7.net"]
    assert {r.u.suffix for r in parsed(df, rules=many.where("false")).collect()} == {""}


LIST = """// comment
// ===BEGIN ICANN DOMAINS===
com
io
uk
co.uk
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
рф
 台湾 trailing words
公司.cn
CN
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
// a host
github.io
*.compute.example.com
// ===END PRIVATE DOMAINS===
"""


def split_hosts(spark, hosts, rules):
    df = spark.createDataFrame([(h, f"http://{h}/x") for h in hosts], "h string, url string")
    return {r.h: (r.u.subdomain, r.u.registered, r.u.suffix) for r in parsed(df, rules=rules).collect()}


def test_sections_and_forms(spark, tmp_path):
    """Private rules count only if asked for; Unicode rules match hosts in both forms; exceptions and wildcards of several labels."""
    path = tmp_path / "list.dat"
    path.write_bytes(LIST.replace("\n", "\r\n").encode())
    want = {
        "me.github.io": ("me", "github", "io"), "a.b.co.uk": ("a", "b", "co.uk"), "www.ck": ("", "www", "ck"), "x.y.ck": ("", "x", "y.ck"), "a.city.kawasaki.jp": ("a", "city", "kawasaki.jp"), "a.b.c.kawasaki.jp": ("a", "b", "c.kawasaki.jp"),
        "www.пример.рф": ("www", "пример", "рф"), "www.xn--e1afmkfd.xn--p1ai": ("www", "xn--e1afmkfd", "xn--p1ai"), "a.台湾": ("", "a", "台湾"), "b.公司.cn": ("", "b", "公司.cn"), "b.xn--55qx5d.cn": ("", "b", "xn--55qx5d.cn"), "X.Com": ("", "X", "Com"), "no.rule": ("no", "rule", ""), "x.compute.example.com": ("x.compute", "example", "com"),
    }
    table, literal = suffix_table(spark, str(path)), suffix_rules(spark, str(path))
    assert split_hosts(spark, want, table) == want == split_hosts(spark, want, literal)
    private = {"me.github.io": ("", "me", "github.io"), "x.compute.example.com": ("", "", "x.compute.example.com"), "a.x.compute.example.com": ("", "a", "x.compute.example.com"), "github.io": ("", "", "github.io")}
    assert split_hosts(spark, private, suffix_table(spark, str(path), private=True)) == private == split_hosts(spark, private, suffix_rules(spark, str(path), private=True))


def test_a_list_of_full_size_compiles(spark, tmp_path):
    """Ten thousand rules, all features on top of the join, and no stage that falls back from generated code."""
    from sparkwarden.operators.features import features

    path = tmp_path / "list.dat"
    path.write_text("// ===BEGIN ICANN DOMAINS===\n" + "\n".join(f"s{k}.net\n*.w{k}.org\n!x.w{k}.org\né{k}" for k in range(2_500)) + "\n// ===END ICANN DOMAINS===\n")
    rules = suffix_table(spark, str(path))
    assert rules.count() == 12_500  # the Unicode ones twice
    df = spark.createDataFrame([("http://a.b.s7.net/",), ("http://q.r.w8.org/x",), ("http://y.x.w9.org/",), ("http://z.é77/",), ("http://z.xn--77-9ia/",), (None,)], "url string").withColumns({"_url_host": F.lit("x"), "_p": F.lit("x"), "_d": F.lit("x"), "h": F.lit("x")})
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = parsed(df, rules=rules)
        assert got.columns == [*df.columns, "u"]
        assert sorted(r.u.suffix for r in got.where("url is not null").collect()) == ["r.w8.org", "s7.net", "w9.org", "xn--77-9ia", "é77"]
        assert features(df, rules=rules).count() == 6
        assert len(features(df, rules=rules).collect()) == 6
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_every_unsafe_host_falls_back_and_no_other(spark):
    """Each code point that folds to a delimiter, and a thousand that do not."""
    import sys
    import unicodedata

    from sparkwarden.functions.hosts import folds_to

    unsafe = folds_to("/?#@:")
    assert set(unsafe) == {chr(k) for k in range(128, sys.maxunicode + 1) if any(p in unicodedata.normalize("NFKC", chr(k)) for p in "/?#@:")}
    others = [chr(k) for k in range(0x100, 0x2FFFF, 191) if not 0xD800 <= k < 0xE000 and chr(k) not in unsafe]
    df = spark.createDataFrame([(c, f"http://a{c}b.com/x") for c in [*unsafe, *others]], "c string, url string")
    got = {r.c: (r.u.domain, r.u.path) for r in parsed(df).collect()}
    assert all(got[c] == ("http:", f"//a{c}b.com/x") for c in unsafe) and all(got[c] == (f"a{c}b.com", "/x") for c in others)
