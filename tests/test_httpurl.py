import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.hosts import ascii_host, folded, folds_to, punycode
from sparkwarden.functions.httpurl import normalised

# input, result (None: rejected), reason
GOLDEN = [
    ("HTTP://EXAMPLE.com", "http://example.com/", None), ("https://bücher.de:443/", "https://xn--bcher-kva.de/", None), ("http://example.com:80", "http://example.com/", None), ("https://example.com:80", "https://example.com:80/", None),
    ("http://example.com:", "http://example.com/", None), ("http://example.com:0080/", "http://example.com/", None), ("http://example.com:08080/a", "http://example.com:8080/a", None), ("  http://a.b/c d ", "http://a.b/c%20d", None),
    ("http://a.b/x\ty\nz", "http://a.b/xyz", None), ("http:a.b", "http://a.b/", None), ("http:///a.b/c", "http://a.b/c", None), ("http:\\\\a.b\\c\\d", "http://a.b/c/d", None), ("http://a.b?q", "http://a.b/?q", None), ("http://a.b#f", "http://a.b/#f", None),
    ("http://a.b/?", "http://a.b/?", None), ("http://a.b/a/./b/../c", "http://a.b/a/c", None), ("http://a.b/..", "http://a.b/", None), ("http://a.b/a/..", "http://a.b/", None), ("http://a.b/a/.", "http://a.b/a/", None), ("http://a.b/%2E%2e/x", "http://a.b/x", None),
    ("http://a.b/a//b/", "http://a.b/a//b/", None), ("http://a.b/é?é#é", "http://a.b/%C3%A9?%C3%A9#%C3%A9", None), ('http://a.b/"<>`{}?"<>\'`#"<>`', "http://a.b/%22%3C%3E%60%7B%7D?%22%3C%3E%27`#%22%3C%3E%60", None), ("http://a.b/%zz%41", "http://a.b/%zz%41", None),
    ("http://u:p@a.b/", "http://u:p@a.b/", None), ("http://u@a.b/", "http://u@a.b/", None), ("http://u:@a.b/", "http://u@a.b/", None), ("http://@a.b/", "http://a.b/", None), ("http://:p@a.b/", "http://:p@a.b/", None), ("http://a@b@c.d/", "http://a%40b@c.d/", None), ("http://u:p:q@a.b", "http://u:p%3Aq@a.b/", None),
    ("http://%65xample.com", "http://example.com/", None), ("http://ｅｘａｍｐｌｅ。com", "http://example.com/", None), ("http://EXAMPLE.ÉA/", "http://example.xn--a-9fa/", None), ("http://日本語.jp/", "http://xn--wgv71a119e.jp/", None), ("http://ü.de", "http://xn--tda.de/", None),
    ("http://x­y.com", "http://xy.com/", None), ("http://faß.de", "http://xn--fa-hia.de/", None), ("http://a.b./", "http://a.b./", None), ("http://a_b.c/", "http://a_b.c/", None), ("http://xn--bcher-kva.de", "http://xn--bcher-kva.de/", None), ("http://a+b.c/", "http://a+b.c/", None),
    ("http://192.168.0.1/", "http://192.168.0.1/", None), ("http://0x7f.1/", "http://127.0.0.1/", None), ("http://3232235521", "http://192.168.0.1/", None), ("http://0300.0250.1", "http://192.168.0.1/", None), ("http://1.2.3", "http://1.2.0.3/", None), ("http://1.2.3.4./", "http://1.2.3.4/", None),
    ("http://[::1]:8080/", "http://[::1]:8080/", None), ("http://[2001:DB8:0:0:1:0:0:1]", "http://[2001:db8::1:0:0:1]/", None), ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/", None), ("http://[0:0:0:0:0:0:0:0]", "http://[::]/", None), ("http://[1:0:0:2:0:0:0:3]:80", "http://[1:0:0:2::3]/", None),
    (None, None, "missing"), ("", None, "no scheme"), ("example.com", None, "no scheme"), ("//a.b/c", None, "no scheme"), ("ftp://a.b", None, "scheme"), ("localhost:8000", None, "scheme"), ("javascript:alert(1)", None, "scheme"), ("http://", None, "empty host"), ("http:///", None, "empty host"), ("http://:80/", None, "empty host"), ("http://u@/x", None, "empty host"), ("http://?q", None, "empty host"),
    ("http://a.b:99999/", None, "port"), ("http://a.b:8x/", None, "port"), ("http://a.b:-1/", None, "port"), ("http://a.b:99999999999999999999/", None, "port"), ("http://a b.c/", None, "domain character"), ("http://a%20b.c/", None, "domain character"), ("http://a%zz.b/", None, "domain character"), ("http://a<b.c/", None, "domain character"), ("http://a℀b.com/", None, "domain character"), ("http://a%ff.b/", None, "domain character"),
    ("http://1.2.3.4.5/", None, "ipv4"), ("http://256.1.1.1/", None, "ipv4"), ("http://1.2.3.09/", None, "ipv4"), ("http://a.1/", None, "ipv4"), ("http://99999999999/", None, "ipv4"), ("http://[::1/", None, "ipv6"), ("http://[1:2:3]/", None, "ipv6"), ("http://[::g]/", None, "ipv6"), ("http://[1::2::3]/", None, "ipv6"), ("http://[::1]x/", None, "ipv6"),
    ("http://a.b/" + "x" * 2072, "http://a.b/" + "x" * 2072, None), ("http://a.b/" + "x" * 2073, None, "too long"),
]


def test_golden_rows(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(GOLDEN)], "k int, url string").withColumns({"_u_text": F.lit("x"), "u": F.lit("y")})
    out = normalised(df)
    assert out.columns == ["k", "url", "_u_text", "u", "http"]
    got = {r.k: (r.url, r.http.url, r.http.reason) for r in out.collect()}
    want = {k: (u, v, r) for k, (u, v, r) in enumerate(GOLDEN)}
    assert got == want


def test_what_is_normal_stays(spark):
    done = [(v,) for _, v, _ in GOLDEN if v]
    assert all(r.http.url == r.url for r in normalised(spark.createDataFrame(done, "url string")).collect())


def test_punycode_equals_the_codec(spark):
    rng = random.Random(1)
    pools = [lambda: rng.randrange(97, 123), lambda: rng.randrange(0xE0, 0x250), lambda: rng.randrange(0x4E00, 0x9FFF), lambda: rng.randrange(0x10000, 0x10FFFF)]
    labels = ["".join(chr(rng.choice(pools)()) for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["é" * 50, "x" * 60 + "é", "日本語", "ひとつしかない世界"]
    labels = [x for x in labels if not x.isascii()]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", punycode(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [r.x.encode("punycode").decode() for r in got]


def test_hosts_equal_the_idna_codec(spark):
    """Folding and Punycode together, on names that the older standard treats alike."""
    hosts = ["Bücher.DE", "MÜNCHEN.ost.example", "ｗｗｗ．Ｅｘａｍｐｌｅ．ｃｏｍ", "ﬁnance.org", "㎏.com", "Ångström.se", "été.fr", "пример.испытание", "한국.kr", "日本｡jp"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", ascii_host(folded(F.col("h"))).alias("a")).collect()
    assert [r.a for r in got] == [r.h.encode("idna").decode().lower() for r in got]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(2)
    six = [ipaddress.IPv6Address(sum(rng.choice([0, 0, 1, rng.randrange(65536)]) << 16 * k for k in range(8))) for _ in range(60)]
    four = [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(40)]
    rows = [(f"http://[{rng.choice([a.exploded, a.compressed, a.exploded.upper()])}]/", f"http://[{a.compressed if a.ipv4_mapped is None else ':'.join(['', '', 'ffff', *(f'{int(a) >> s & 65535:x}' for s in (16, 0))])}]/") for a in six]
    rows += [(f"http://{rng.choice([str(a), str(int(a)), hex(int(a)), f'0{int(a):o}'])}/", f"http://{a}/") for a in four]
    got = normalised(spark.createDataFrame(rows, "url string, want string")).collect()
    assert [r.http.url for r in got] == [r.want for r in got]


@pytest.mark.parametrize("parts, some", [("/?#@:", "℀℁℅℆⁇⁈⁉⩴︓︖﹕﹖﹟﹫／：？＃＠")])
def test_unsafe_code_points_are_all_there(parts, some):
    assert set(folds_to(parts)) == set(some)
