"""Splitting URLs into parts with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.hosts import ascii_host, folds_to
from sparkwarden.functions.text import fresh

SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Schemes whose last path segment may carry ;parameters.
WITH_PARAMETERS = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips", "mms", "sftp", "tel")
#: Public suffixes known without a list at hand; a fuller table can be given as a path.
SUFFIXES = tuple("com org net edu gov mil int info biz name io ai app dev me tv cc co us uk de fr es it nl be ch at se no dk fi pl pt ru cn jp in br au ca mx eu xyz tk ml ga cf gq ly gl do gd ac cm cy st tt ae".split()) + (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.br", "net.br", "org.br", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr", "com.ar", "*.ck", "!www.ck",
)


def with_scheme(url: Column) -> Column:
    """http:// in front of what looks like a host without scheme."""
    bare = ~url.rlike("(?i)^https?://") & url.contains(".") & ~F.substring_index(url, ".", 1).contains("/")
    return F.when(bare, F.concat(F.lit("http://"), url)).otherwise(url)


def _listed(spark: SparkSession, path: str, private: bool) -> DataFrame:
    """v: the rules of a file in the public list's format, lower-case, each also in its ASCII form. The file is one row, so its lines keep their order and its sections their marks; it is bounded by that list's size.

    Comments and blank lines go, and what follows white space in a line. The section of private domains counts only if asked for; it runs from its mark to its end mark or the end of the file.
    """
    text = F.regexp_replace("value", r"\r\n?", "\n")
    if not private:
        text = F.regexp_replace(text, r"(?s)//[ \t]*===BEGIN PRIVATE DOMAINS===.*?(//[ \t]*===END PRIVATE DOMAINS===|$)", "")
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(text, "\n")).alias("line"))
    rule = lines.select(F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1)).alias("v")).where("v <> '' and v not like '//%'")
    return rule.select(F.explode(F.array("v", ascii_host(F.col("v")))).alias("v")).distinct()


def suffix_rules(spark: SparkSession, path: str | None = None, private: bool = False) -> tuple[str, ...]:
    """Rules of the suffix list at a path (see suffix_table) for use as literals, or the built-in ones; for short lists."""
    return SUFFIXES if path is None else tuple(sorted(r.v for r in _listed(spark, path, private).collect()))


def suffix_table(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The suffix list as (ends, kind): what a host must end with, lower-case, in Unicode and ASCII form, and whether the rule is plain, wild or an exception (but).

    Rules of the list's private section count only with private.
    """
    rule = _listed(spark, path, private)
    kind = F.when(F.col("v").startswith("*."), "wild").when(F.col("v").startswith("!"), "but").otherwise("plain")
    return rule.select(F.regexp_replace("v", r"^(\*\.|!)", "").alias("ends"), kind.alias("kind"))


def parsed(df: DataFrame, url_col: str = "url", rules: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """df with u: struct of url, scheme, domain, path, query, fragment, subdomain, registered, suffix.

    The text itself is kept as u.url; nulls give null parts. A host with unmatched brackets, or characters that compatibility folding turns into / ? # @ or :, falls back
    to a cut at the first slash. A few suffix rules are literals of the plan; a full list is given as a suffix_table and joined. Working columns are plain ones and used by several
    others, so that each stays a step of its own and the generated code small.
    """
    p = fresh(df, "url")
    c = lambda k: F.col(f"{p}{k}")
    url = F.col(url_col).cast("string")
    df = df.withColumn(f"{p}clean", F.regexp_replace(F.regexp_replace(with_scheme(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""))
    part = lambda k: F.regexp_extract(c("clean"), SPLIT, k)
    df = df.withColumns({f"{p}scheme": F.lower(part(1)), f"{p}netloc": part(2), f"{p}path": part(3), f"{p}query": part(4), f"{p}fragment": part(5)})
    df = df.withColumn(f"{p}bad", (c("netloc").contains("[") != c("netloc").contains("]")) | c("netloc").rlike(f"[{folds_to('/?#@:')}]"))
    path = F.when(c("scheme").isin(*WITH_PARAMETERS), F.regexp_replace(c("path"), ";[^/]*$", "")).otherwise(c("path"))
    rest = F.when(url.contains("/"), F.concat(F.lit("/"), F.regexp_replace(url, "(?s)^[^/]*/", ""))).otherwise("")
    unless = lambda good, bad: F.when(c("bad"), bad).otherwise(good)
    host = F.regexp_replace(F.regexp_replace(c("netloc"), "^.*@", ""), r":\d*$", "")
    df = df.withColumns({f"{p}host": unless(host, ""), f"{p}at": unless(c("netloc"), F.substring_index(url, "/", 1))})
    df = with_registered(df, f"{p}host", rules, f"{p}name") if isinstance(rules, DataFrame) else df.withColumn(f"{p}name", registered(c("host"), rules))
    joined = F.regexp_replace(F.concat_ws(".", f"{p}name.subdomain", f"{p}name.registered", f"{p}name.suffix"), r"^\.+|\.+$", "")
    domain = F.when((c("at") != "") | c("bad"), c("at")).otherwise(joined)
    scheme = F.when(c("bad") | (c("scheme") == ""), "http").otherwise(c("scheme"))
    u = {"url": url, "scheme": scheme, "domain": domain, "path": unless(path, rest), "query": unless(c("query"), ""), "fragment": unless(c("fragment"), "")}
    whole = F.struct(*(v.alias(k) for k, v in u.items()), *(F.col(f"{p}name.{k}").alias(k) for k in ("subdomain", "registered", "suffix")))
    return df.withColumn("u", whole).drop(*(f"{p}{k}" for k in ("clean", "scheme", "netloc", "path", "query", "fragment", "bad", "host", "at", "name")))


def _once(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ends(v: Column) -> Column:
    """What begins at each label, lower-case."""
    return F.transform(v, lambda _, i: F.lower(F.array_join(F.slice(v, i + 1, F.size(v)), ".")))


def _split(v: Column, at: Column) -> Column:
    """struct(subdomain, registered, suffix) of labels whose suffix begins after `at` of them."""
    piece = lambda a, b: F.when(b > a, F.array_join(F.slice(v, a + 1, F.greatest(b - a, F.lit(0))), ".")).otherwise("")
    last = F.greatest(at - 1, F.lit(0))
    return F.struct(piece(F.lit(0), last).alias("subdomain"), piece(last, at).alias("registered"), piece(at, F.size(v)).alias("suffix"))


def _numeric(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.startswith("[")


def _alone(host: Column) -> Column:
    return F.struct(F.lit("").alias("subdomain"), host.alias("registered"), F.lit("").alias("suffix"))


def registered(host: Column, rules: tuple[str, ...] = SUFFIXES) -> Column:
    """struct(subdomain, registered, suffix) of a host: the longest matching rule wins, then exceptions; an unknown suffix is empty."""
    plain = [r for r in rules if r[0] not in "*!"] or [""]
    wild = [r[2:] for r in rules if r.startswith("*.")] or [""]
    but = [r[1:] for r in rules if r.startswith("!")] or [""]

    def place(r: Column) -> Column:
        """Labels before the suffix, from what begins at each label; all of them if no rule matches."""
        exception = F.array_max(F.transform(r, lambda x, i: F.when(x.isin(but), i + 1)))
        hit = F.array_min(F.transform(r, lambda x, i: F.when(x.isin(plain) | F.get(r, i + 1).isin(wild), i)))
        return F.coalesce(exception, hit, F.size(r))

    return F.when(_numeric(host), _alone(host)).otherwise(_once(F.split(host, r"\."), lambda v: _once(_once(_ends(v), place), lambda at: _split(v, at))))


def with_registered(df: DataFrame, host: str, rules: DataFrame, name: str = "registered", most_sent: int = 200_000) -> DataFrame:
    """df with `name`, as registered(host) gives it, by rules of suffix_table: each distinct host is looked up once.

    Up to `most_sent` rules go to the hosts' endings by broadcast, more by a shuffle. Hosts come back to their rows by a join that is split
    at run time where one host is hot. A null host gives a null suffix place and so null parts; no rules leave every suffix empty.
    """
    own = fresh(df, "host")
    hosts = df.select(F.col(host).alias("h")).distinct()
    ends = hosts.where(~_numeric(F.col("h"))).select("h", F.posexplode(_ends(F.split("h", r"\."))).alias("j", "ends"))
    ruled = rules.select("ends", "kind").distinct()
    hits = ends.join(ruled.hint("broadcast" if ruled.count() <= most_sent else "merge"), "ends")
    j, kind = F.col("j"), F.col("kind")
    hit = F.min(F.when(kind == "plain", j).when((kind == "wild") & (j > 0), j - 1))
    at = hits.groupBy(F.col("h").alias("of")).agg(F.coalesce(F.max(F.when(kind == "but", j + 1)), hit).alias("at"))
    labels = F.split("h", r"\.")
    found = hosts.join(at, F.col("h") == F.col("of"), "left").select(F.col("h").alias(own), F.when(_numeric(F.col("h")), _alone(F.col("h"))).otherwise(_split(labels, F.coalesce("at", F.size(labels)))).alias(name))
    return df.join(found, F.col(host).eqNullSafe(F.col(own)), "left").drop(own)
