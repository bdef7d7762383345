"""Registered queries of the URL engine and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.text import tokens
from sparkwarden.functions.url import SPLIT, SUFFIXES, parsed, with_scheme
from sparkwarden.operators import matrix, models, scoring
from sparkwarden.operators.features import BRANDS, COUNTED, MATRIX, SECURITY_TERMS, TERMS, features
from sparkwarden.sources import io, logs
from sparkwarden.sources.io import label_distribution

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkwarden-")
    return f"{base}/{uuid.uuid4()}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places as DuckDB rounds them: the product with a million is rounded, so 4.1703125 gives 4.170312 where F.round, which goes by the decimal digits, gives 4.170313."""
    return df.select(*((F.round(F.col(c) * 1e6, 0) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def spread(df: DataFrame) -> DataFrame:
    """df in a partition for each core: URLs are few bytes and much work, and a task that applies a forest first reads it whole."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def some(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return rounded(features(pages(spark, sf_dir), keep=("page_id",), names=names))


# SQL pieces over pages: all its URLs have a scheme, and one-label suffixes.
_FROM = f"""u0 AS (SELECT page_id, url AS s, lower(regexp_extract(url, '{SPLIT}', 1)) AS scheme, regexp_extract(url, '{SPLIT}', 2) AS d, regexp_replace(regexp_extract(url, '{SPLIT}', 3), ';[^/]*$', '') AS p, regexp_extract(url, '{SPLIT}', 4) AS q, regexp_extract(url, '{SPLIT}', 5) AS f FROM {{}}),
u AS (SELECT *, greatest(length(s), 1) AS n, lower(s) AS low, string_split(d, '.')[-1] AS suf, string_split(d, '.')[-2] AS reg, array_to_string(string_split(d, '.')[:-3], '.') AS sub, list_filter(regexp_split_to_array(d, '[.-]'), lambda x: x <> '') AS parts, list_filter(string_split(p, '/'), lambda x: x <> '') AS dirs FROM u0)"""
_U = _FROM.format("pages")


def _sql(cells: dict[str, str]) -> str:
    return f"WITH {_U} SELECT page_id, {', '.join(f'{e} AS {k}' for k, e in cells.items())} FROM u"


def _occ(s: str, piece: str) -> str:
    return f"CAST((length({s}) - length(replace({s}, '{piece}', ''))) // {len(piece)} AS INT)"


def _has(s: str, piece: str) -> str:
    return f"CAST(contains({s}, '{piece}') AS INT)"


def _like(s: str, pattern: str) -> str:
    return f"CAST(regexp_matches({s}, '{pattern}') AS INT)"


def _ent(s: str) -> str:
    return f"CASE WHEN {s} = '' THEN 0.0 ELSE list_aggregate(string_split({s}, ''), 'entropy') END"


def _share(pattern: str, s: str = "s") -> str:
    return f"round(len(regexp_extract_all({s}, '{pattern}')) / n, 6)"


def _grams(k: int) -> str:
    return f"round(CASE WHEN length(s) < {k} THEN 0.0 ELSE len(list_distinct(list_transform(range(1, length(s) - {k} + 2), lambda i: substr(s, i, {k})))) / (length(s) - {k} + 1) END, 6)"


_min_distance = {b: f"CAST(coalesce(list_min(list_transform(parts, lambda t: levenshtein('{b}', lower(t)))), -1) AS INT)" for b in BRANDS}
CELLS: dict[str, str] = (
    {"url_length": "length(s)", "domain_length": "length(d)", "path_length": "length(p)"}
    | {f"count_{k}": _occ("s", c) for k, c in COUNTED.items()}
    | {"count_www": _occ("low", "www"), "count_com": _occ("low", ".com"), "digit_count": "len(regexp_extract_all(s, '[0-9]'))", "letter_count": "len(regexp_extract_all(s, '\\p{L}'))"}
    | {"digit_letter_ratio": "round(len(regexp_extract_all(s, '[0-9]')) / (len(regexp_extract_all(s, '\\p{L}')) + 1), 6)", "has_ip_address": _like("d", r"^\d{1,3}(\.\d{1,3}){3}(:[0-9]+)?$"), "has_port": _has("d", ":")}
    | {"subdomain_count": f"CASE WHEN sub <> '' THEN {_occ('sub', '.')} + 1 ELSE 0 END", "is_https": "CAST(scheme = 'https' AS INT)", "path_depth": _occ("p", "/"), "has_suspicious_path": _like("lower(p)", "login|admin|verify|secure|account")}
    | {"query_length": "length(q)", "query_param_count": f"CASE WHEN q <> '' THEN {_occ('q', '&')} + 1 ELSE 0 END", "security_terms_count": " + ".join(_has("low", t) for t in SECURITY_TERMS), "entropy": f"round({_ent('s')}, 6)"}
    | {"fragment_length": "length(f)", "domain_token_count": "len(parts)", "path_token_count": "len(dirs)", "special_char_ratio": _share(r"[^\p{L}\p{N}]"), "upper_case_ratio": _share(r"\p{Lu}")}
    | {"vowel_ratio": _share("[aeiou]", "low"), "consonant_ratio": _share("[b-df-hj-np-tv-z]", "low"), "unique_char_ratio": "round(len(list_distinct(string_split(s, ''))) / n, 6)"}
    | {f"{k}_entropy": f"round({_ent(k[0])}, 6)" for k in ("domain", "path", "query")}
    | {"entropy_ratio": f"round(({_ent('d')}) / ({_ent('s')}), 6)", "is_shortened": "CAST(reg || '.' || suf IN ('bit.ly', 'tinyurl.com', 't.co', 'goo.gl', 'is.gd', 'cli.gs', 'ow.ly', 'buff.ly', 'adf.ly', 'tiny.cc', 'lnkd.in', 'db.tt', 'qr.ae', 'cutt.ly') AS INT)"}
    | {"domain_has_digit": _like("reg", "[0-9]"), "subdomain_has_digit": _like("sub", "[0-9]"), "tld": "suf", "has_suspicious_tld": "CAST(suf IN ('tk', 'ml', 'ga', 'cf', 'gq', 'xyz') AS INT)"}
    | {f"contains_{t}": _has("low", t) for t in TERMS}
    | {k: v for b in BRANDS for k, v in ((f"contains_{b}", _has("lower(d)", b)), (f"{b}_min_distance", _min_distance[b]))}
    | {"min_brand_distance": f"least({', '.join(_min_distance.values())})", "has_multiple_subdomains": _has("sub", "."), "has_suspicious_chars": _like("s", "xn--|%[0-9A-Fa-f]{2}"), "has_at_symbol": _has("s", "@")}
    | {"has_hexadecimal": _like("s", "0x[0-9a-fA-F]+"), "has_ip_pattern": _like("s", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), "dir_count": _occ("p", "/")}
    | {"avg_dir_length": "round(CASE WHEN len(dirs) = 0 THEN 0.0 ELSE list_avg(list_transform(dirs, lambda x: length(x))) END, 6)", "has_file_extension_in_path": _like("lower(p)", r"\.(php|exe|js|cgi|pl|sh|py|asp|aspx|dll)")}
    | {"unique_2gram_ratio": _grams(2), "unique_3gram_ratio": _grams(3)}
)
GROUPS = {
    "feat_lengths": ("url_length", "domain_length", "path_length", "query_length", "fragment_length"),
    "feat_char_counts": (*(f"count_{k}" for k in COUNTED), "count_www", "count_com", "digit_count", "letter_count"),
    "feat_char_ratios": ("digit_letter_ratio", "special_char_ratio", "upper_case_ratio", "vowel_ratio", "consonant_ratio", "unique_char_ratio"),
    "feat_entropy": ("entropy", "domain_entropy", "path_entropy", "query_entropy", "entropy_ratio"),
    "feat_domain_flags": ("has_ip_address", "has_port", "subdomain_count", "is_https", "is_shortened", "domain_has_digit", "subdomain_has_digit", "tld", "has_suspicious_tld", "has_multiple_subdomains", "domain_token_count"),
    "feat_path_query": ("path_depth", "has_suspicious_path", "query_param_count", "path_token_count", "dir_count", "avg_dir_length", "has_file_extension_in_path"),
    "feat_security_terms": ("security_terms_count", *(f"contains_{t}" for t in TERMS)),
    "feat_brand_presence": tuple(f"contains_{b}" for b in BRANDS),
    "feat_brand_distance": (*(f"{b}_min_distance" for b in BRANDS), "min_brand_distance"),
    "feat_patterns": ("has_suspicious_chars", "has_at_symbol", "has_hexadecimal", "has_ip_pattern"),
    "feat_ngrams": ("unique_2gram_ratio", "unique_3gram_ratio"),
    "feature_matrix": tuple(CELLS),
}
for _name, _names in GROUPS.items():
    QUERIES[_name] = lambda spark, sf_dir, n=_names: some(spark, sf_dir, *n)
    ORACLE_SQL[_name] = _sql({k: CELLS[k] for k in _names})


@registered("SELECT page_id, CASE WHEN NOT regexp_matches(bare, '(?i)^https?://') AND contains(bare, '.') AND NOT contains(string_split(bare, '.')[1], '/') THEN 'http://' || bare ELSE bare END AS fixed FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS bare FROM pages)")
def url_scheme_fix(spark, sf_dir):
    bare = pages(spark, sf_dir).withColumn("bare", F.regexp_replace("url", "^https?://", ""))
    return bare.select("page_id", with_scheme(F.col("bare")).alias("fixed"))


@registered(f"WITH {_U} SELECT page_id, scheme, d AS domain, p AS path, q AS query, f AS fragment FROM u")
def url_parts(spark, sf_dir):
    return parsed(pages(spark, sf_dir)).select("page_id", "u.scheme", "u.domain", "u.path", "u.query", "u.fragment")


@registered(f"WITH {_U} SELECT page_id, sub AS subdomain, reg AS registered, suf AS suffix FROM u")
def registered_domain(spark, sf_dir):
    return parsed(pages(spark, sf_dir)).select("page_id", "u.subdomain", "u.registered", "u.suffix")


@registered(ORACLE_SQL["registered_domain"])
def registered_domain_joined(spark, sf_dir):
    """registered_domain with the suffix rules as a table that the hosts' endings are joined to."""
    rules = spark.createDataFrame([(r.lstrip("*!").lstrip("."), "wild" if r[0] == "*" else "but" if r[0] == "!" else "plain") for r in SUFFIXES], "ends string, kind string")
    return parsed(pages(spark, sf_dir), rules=rules).select("page_id", "u.subdomain", "u.registered", "u.suffix")


@registered(f"WITH {_U} SELECT page_id, array_to_string(parts, ' ') AS domain_tokens, array_to_string(dirs, ' ') AS path_tokens FROM u")
def url_tokens(spark, sf_dir):
    u = parsed(pages(spark, sf_dir))
    return u.select("page_id", F.array_join(tokens(F.col("u.domain"), "[.-]"), " ").alias("domain_tokens"), F.array_join(tokens(F.col("u.path"), "/"), " ").alias("path_tokens"))


@registered(f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS url FROM pages), {_FROM.format("h")}
SELECT page_id, s AS url, {', '.join(f'{e} AS {k}' for k, e in CELLS.items())} FROM u""")
def href_features(spark, sf_dir):
    base = F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0)
    hrefs = read(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    links = hrefs.select("page_id", F.concat("base", "href").alias("url"))
    return rounded(features(links, keep=("page_id", "url")))


@registered("SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1")
def label_counts(spark, sf_dir):
    return label_distribution(read(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))


@registered("SELECT toxic AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weights(spark, sf_dir):
    return rounded(matrix.class_weights(read(spark, sf_dir, "labels").select(F.col("toxic").alias("label"))))


_SPLIT_SQL = "SELECT doc_id, toxic AS label, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= round(count(*) OVER (PARTITION BY toxic) * 0.2) THEN 'test' ELSE 'train' END AS split FROM labels"


@registered(_SPLIT_SQL)
def split_exact(spark, sf_dir):
    return matrix.exact_split(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@registered(f"SELECT split, label, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return split_exact(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


_MATRIX_SQL = _sql({k: CELLS[k] for k in MATRIX})
_STATE = "SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale FROM m"


@registered(f"WITH m AS ({_MATRIX_SQL}) SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM ({' UNION ALL '.join(_STATE.format(c=c) for c in MATRIX)})")
def scaler_fit(spark, sf_dir):
    return rounded(matrix.fitted_scaler(matrix.aligned(some(spark, sf_dir, *MATRIX))))


@registered(f"WITH m AS ({_MATRIX_SQL}) SELECT page_id, {', '.join(f'round(({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END), 6) + 0.0 AS {c}' for c in MATRIX)} FROM m")
def scaler_apply(spark, sf_dir):
    m = matrix.aligned(some(spark, sf_dir, *MATRIX), keep=("page_id",))
    out = rounded(matrix.scaled(m, matrix.fitted_scaler(m, MATRIX), keep=("page_id",)))
    return out.select("page_id", *((F.col(c) + F.lit(0.0)).alias(c) for c in MATRIX))


@registered(f"WITH m AS ({_MATRIX_SQL}) SELECT page_id, CAST(url_length AS DOUBLE) AS url_length, 0.0::DOUBLE AS absent, CAST(count_dots AS DOUBLE) AS count_dots FROM m")
def align_columns(spark, sf_dir):
    return matrix.aligned(some(spark, sf_dir, "url_length", "count_dots", "tld"), keep=("page_id",), names=("url_length", "absent", "count_dots"))


def threshold_votes(df: DataFrame) -> DataFrame:
    """Four fixed votes that stand in for models where results must be exact."""
    f = features(df, keep=tuple(df.columns), names=("url_length", "path_depth", "digit_count", "count_hyphens"))
    votes = {"v1": F.col("url_length") > 40, "v2": F.col("path_depth") > 2, "v3": F.col("digit_count") > 2, "v4": F.col("count_hyphens") > 0}
    return f.select(*df.columns, *(v.cast("int").alias(k) for k, v in votes.items()))


_VOTES = f"WITH {_U}, v AS (SELECT page_id, s AS url, d, CAST(length(s) > 40 AS INT) AS v1, CAST({_occ('p', '/')} > 2 AS INT) AS v2, CAST(len(regexp_extract_all(s, '[0-9]')) > 2 AS INT) AS v3, CAST(contains(s, '-') AS INT) AS v4 FROM u)"
_PRED = "CAST(v1 + v2 + v3 + v4 > 2 AS INT)"


def _voted() -> Column:
    return models.hard_vote(*(F.col(f"v{k}") for k in range(1, 5)))


@registered(f"{_VOTES} SELECT page_id, v1, v2, v3, v4, {_PRED} AS prediction FROM v")
def hard_vote(spark, sf_dir):
    return threshold_votes(pages(spark, sf_dir)).select("page_id", "v1", "v2", "v3", "v4", _voted().alias("prediction"))


def stand_in(df: DataFrame) -> DataFrame:
    return threshold_votes(df).select(*df.columns, _voted().alias("prediction"), F.lit(-1.0).alias("probability"))


#: Hosts of the tables that stand in for trusted ones.
NET = ("blog.tionsh.example.net", "blog.tionsh.example.com", "thther.example.org", "tionble.example.org")
_NET = f"regexp_replace(d, '^www\\.', '') IN {NET}"


@registered(f"{_VOTES} SELECT page_id, {_NET} AS whitelisted FROM v")
def whitelist_split(spark, sf_dir):
    return scoring.score(pages(spark, sf_dir), stand_in, NET).select("page_id", "whitelisted")


@registered(f"{_VOTES}, r AS (SELECT *, {_PRED} AS prediction FROM v) SELECT page_id, CASE WHEN prediction = 1 THEN 'Phishing Warning!' ELSE 'URL Looks Safe' END AS title, CASE WHEN prediction = 1 THEN 'Potential phishing detected for:' ELSE 'This URL appears to be safe:' END || chr(10) || url AS message, CASE WHEN prediction = 1 THEN 2 ELSE 0 END AS priority FROM r")
def verdict_message(spark, sf_dir):
    return scoring.message(stand_in(pages(spark, sf_dir))).select("page_id", "title", "message", "priority")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page loads, six of seven of them complete: event_id modulo the number of pages names the page."""
    p = pages(spark, sf_dir)
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, "loading").otherwise("complete").alias("status"), (F.col("event_id") % p.count()).alias("page_id"))
    return scoring.completed(e.join(p, "page_id"))


@registered(f"{_VOTES}, r AS (SELECT event_id, v.*, {_NET} AS whitelisted FROM events JOIN v ON event_id % (SELECT count(*) FROM pages) = page_id WHERE event_id % 7 <> 0) SELECT event_id, url, CASE WHEN whitelisted THEN 0 ELSE {_PRED} END AS prediction, CASE WHEN whitelisted THEN 1.0 ELSE -1.0 END::DOUBLE AS probability, whitelisted FROM r")
def visit_scores(spark, sf_dir):
    return scoring.score(visits(spark, sf_dir), stand_in, NET).select("event_id", "url", "prediction", "probability", "whitelisted")


@registered(f"{_VOTES}, r AS (SELECT event_id, v.*, ts FROM events JOIN v ON event_id % (SELECT count(*) FROM pages) = page_id WHERE event_id % 7 <> 0 AND NOT {_NET}) SELECT url, {_PRED} AS prediction, (-1.0)::DOUBLE AS probability, 'urlset_ensemble' AS model_type, ts AS timestamp FROM r")
def prediction_log(spark, sf_dir):
    return scoring.prediction_log(scoring.score(visits(spark, sf_dir), stand_in, NET), F.col("ts"))


_DIRTY = """SELECT CASE page_id % 8 WHEN 1 THEN 'too many fields' WHEN 2 THEN 'missing value' WHEN 3 THEN 'missing value' WHEN 4 THEN 'bad label' WHEN 6 THEN 'missing value' ELSE 'loaded' END AS outcome,
  CASE WHEN page_id % 8 NOT IN (1, 2) THEN url END AS domain, CAST(CASE page_id % 8 WHEN 0 THEN page_id % 3 WHEN 5 THEN 1 WHEN 7 THEN page_id % 3 END AS INT) AS label,
  CASE page_id % 8 WHEN 1 THEN url || ',' || page_id % 3 || ',x,y' WHEN 4 THEN 'abc' END AS text FROM pages"""


def dirty_csv(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Pages as lines (domain, label, extra) of CSV files: good ones, too many fields, no domain, no label, a label that is no number, a fraction, NaN, too few fields."""
    k = F.col("page_id") % 8
    label = F.when(k == 3, "").when(k == 4, "abc").when(k == 5, "1.0").when(k == 6, "nan").otherwise((F.col("page_id") % 3).cast("string"))
    lines = pages(spark, sf_dir).select(F.concat(F.when(k != 2, F.col("url")).otherwise(""), F.lit(","), label, F.when(k == 1, ",x,y").when(k == 7, "").otherwise(",x")).alias("value"))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["domain,label,extra"]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(folder)


@registered(_DIRTY)
def csv_load(spark, sf_dir):
    """Every line of a dirty CSV file: what was loaded, and what was not with its reason."""
    folder = shared(spark)
    dirty_csv(spark, sf_dir, f"{folder}/csv")
    rows, rejects, _ = io.load_labelled(spark, f"{folder}/csv", f"{folder}/loaded")
    loaded = rows.select(F.lit(io.LOADED).alias("outcome"), "domain", "label", F.lit(None).cast("string").alias("text"))
    return loaded.unionByName(rejects.withColumn("label", F.lit(None).cast("int")))


@registered(f"WITH d AS ({_DIRTY}) SELECT 'lines' AS outcome, count(*) AS n FROM d UNION ALL SELECT outcome, count(*) FROM d GROUP BY outcome")
def csv_load_counts(spark, sf_dir):
    """The counters of the same load, seen while it wrote."""
    folder = shared(spark)
    dirty_csv(spark, sf_dir, f"{folder}/csv")
    *_, counts = io.load_labelled(spark, f"{folder}/csv", f"{folder}/loaded")
    return spark.createDataFrame(list(counts.items()), "outcome string, n long")


@registered("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS rest FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 2 THEN host || rest WHEN 3 THEN 'ftp://' || host || rest WHEN 5 THEN scheme || '://xn--bcher-kva.' || host || rest ELSE url END AS url, CASE page_id % 6 WHEN 2 THEN 'no scheme' WHEN 3 THEN 'scheme' END AS reason FROM p""")
def request_urls(spark, sf_dir):
    """Requests for all pages, written in other ways: in upper case, with the default port, without or with another scheme, with dot segments, under a host beyond ASCII."""
    part = lambda k: F.regexp_extract("url", "^(https?)://([^/?#]*)(.*)$", k)
    k, scheme, host, rest = F.col("page_id") % 6, part(1), part(2), part(3)
    port = F.when(scheme == "https", ":443").otherwise(":80")
    put = lambda *c: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in c))
    url = F.when(k == 0, put(F.upper(scheme), "://", F.upper(host), rest)).when(k == 1, put(scheme, "://", host, port, rest)).when(k == 2, put(host, rest)).when(k == 3, put("ftp://", host, rest)).when(k == 4, put(scheme, ":\\\\", host, "/x/../.", rest)).otherwise(put(scheme, "://Bücher.", host, rest))
    valid, rejected = io.requests(pages(spark, sf_dir).select("page_id", F.to_json(F.struct(url.alias("url"))).alias("value")))
    return valid.select("page_id", "url", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("page_id", "url", "reason"))


@registered("""SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 4 < 2 THEN 'u' || event_id END AS url, CAST(CASE WHEN event_id % 11 <> 0 AND event_id % 4 < 2 THEN event_id % 4 END AS INT) AS reported_label, CASE WHEN event_id % 11 = 0 THEN 'json' WHEN event_id % 4 >= 2 THEN 'label' END AS reason FROM events""")
def report_requests(spark, sf_dir):
    """Reports as JSON, some cut off and some with labels that aren't: those that are valid, and the others with a reason."""
    e = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), (F.col("event_id") % 4).alias("reported_label"))).alias("value"))
    e = e.withColumn("value", F.when(F.col("event_id") % 11 == 0, F.left("value", F.lit(9))).otherwise(F.col("value")))
    valid, rejected = io.reports(e)
    return valid.select("event_id", "url", "reported_label", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("event_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("reported_label"), "reason"))


@registered(ORACLE_SQL["prediction_log"])
def prediction_log_committed(spark, sf_dir):
    """prediction_log through a log of three batches: one that was killed before its record, one that comes twice, and a compaction of all."""
    path, kind = shared(spark), read(spark, sf_dir, "events").schema["ts"].dataType
    records = scoring.score(visits(spark, sf_dir), stand_in, NET)
    records.write.parquet(f"{path}/scored")
    records = spark.read.parquet(f"{path}/scored")
    part = lambda k: scoring.prediction_log(records.where(F.pmod("event_id", F.lit(3)) == k), F.col("ts")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    logs._write(part(1), f"{path}/log", "b-1")
    for k in (0, 1, 2, 1):
        logs.append_log(part(k), f"{path}/log", k)
    logs.compact(spark, f"{path}/log", scoring.LOG)
    return logs.read_log(spark, f"{path}/log", scoring.LOG).drop("date").withColumn("timestamp", F.col("timestamp").cast(kind))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("toxic").alias("y"), (1 - F.col("quality")).alias("pred"))


_JUDGED = "j AS (SELECT toxic AS y, 1 - quality AS pred FROM labels)"


@registered(f"WITH {_JUDGED} SELECT round(avg(CAST(y = pred AS INT)), 4) AS accuracy FROM j")
def eval_accuracy(spark, sf_dir):
    return models.accuracy(judged(spark, sf_dir))


@registered(f"WITH {_JUDGED} SELECT y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM j GROUP BY y")
def eval_confusion(spark, sf_dir):
    return models.confusion(judged(spark, sf_dir))


@registered(f"""WITH {_JUDGED}, k AS (SELECT l, count(*) FILTER (y = l AND pred = l) AS hit, count(*) FILTER (y = l) AS support, count(*) FILTER (pred = l) AS said FROM j, (VALUES (0), (1)) AS t(l) GROUP BY l),
s AS (SELECT l, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support, hit FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM s)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(n AS BIGINT) AS support FROM (
SELECT CAST(l AS VARCHAR) AS label, p, r, f, support AS n FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f)""")
def eval_report(spark, sf_dir):
    return rounded(models.report(judged(spark, sf_dir)))


def shown_and_clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    shown = e.where("event_type = 'view'").select(F.col("event_id").alias("shown_id"), F.col("user_id").alias("id"), F.col("ts").alias("shown_ts"), F.lit("http://example.com/").alias("url"))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("id"), F.col("ts").alias("click_ts"), (F.col("event_id") % 3).cast("int").alias("button"))
    return shown, clicks


_MATCH = "m AS (SELECT s.event_id AS shown_id, c.event_id AS click_id, s.user_id AS id, CAST(c.event_id % 3 AS INT) AS button, c.ts AS click_ts, s.ts AS shown_ts FROM events s JOIN events c ON s.user_id = c.user_id AND c.ts >= s.ts AND c.ts < s.ts + INTERVAL 5 MINUTE WHERE s.event_type = 'view' AND c.event_type = 'click')"


@registered(f"WITH {_MATCH} SELECT shown_id, click_id, id FROM m")
def feedback_join_5min(spark, sf_dir):
    return scoring.clicks_on_live(*shown_and_clicks(spark, sf_dir)).select("shown_id", "click_id", "id")


@registered(f"WITH {_MATCH} SELECT shown_id, button FROM m QUALIFY row_number() OVER (PARTITION BY shown_id ORDER BY click_ts, button) = 1")
def feedback_first_click(spark, sf_dir):
    return scoring.first_click(scoring.clicks_on_live(*shown_and_clicks(spark, sf_dir)), ("shown_id",)).select("shown_id", "button")


@registered("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS reported_label FROM events WHERE event_type = 'click'")
def feedback_labels(spark, sf_dir):
    _, clicks = shown_and_clicks(spark, sf_dir)
    return scoring.valid_reports(clicks.select(F.col("click_id").alias("event_id"), scoring.button_label(F.col("button")).alias("reported_label")))[0]


@registered(f"WITH {_MATCH}, c AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase') SELECT shown_id, click_id FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = m.id AND c.ts <= m.click_ts AND c.ts >= m.shown_ts)")
def feedback_unless_closed(spark, sf_dir):
    closes = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").alias("close_ts"))
    return scoring.unless_closed(scoring.clicks_on_live(*shown_and_clicks(spark, sf_dir)), closes).select("shown_id", "click_id")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix of the pages that have a stand-in label."""
    y = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("label"))
    m = rounded(features(spread(pages(spark, sf_dir).join(y, "page_id")), keep=("page_id", "label"), names=MATRIX))  # features of labelled pages only
    return matrix.hash_split(matrix.aligned(m, keep=("page_id", "label")), "page_id")


@registered()
def train_ensemble(spark, sf_dir):
    """Fit on the train side, evaluate on the test side: (y, pred_0, pred_1)."""
    folder = shared(spark)
    models.save_split(_training(spark, sf_dir), folder)
    train, test, _ = models.load_split(spark, folder)
    state = matrix.fitted_scaler(train)
    fitted_on = matrix.scaled(train, state, keep=("label",))
    ensemble = models.fit(fitted_on)
    logs.append_log(models.run_metrics(ensemble, fitted_on).withColumnRenamed("fitted_at", "timestamp"), f"{folder}/runs")
    out = ensemble.predict(matrix.scaled(test, state, keep=("page_id", "label")))
    return models.confusion(out.select(F.col("label").alias("y"), F.col("prediction").alias("pred")))


@registered()
def predict_ensemble(spark, sf_dir):
    """Fit, save, load again, and score every page."""
    folder = shared(spark)
    _training(spark, sf_dir).write.parquet(f"{folder}/matrix")  # the fit reads it many times
    data = spark.read.parquet(f"{folder}/matrix")
    state = matrix.fitted_scaler(data)
    models.save(models.fit(matrix.scaled(data, state, keep=("label",))), state, folder)
    ensemble, state, names = models.load(spark, folder)
    m = matrix.aligned(rounded(features(spread(pages(spark, sf_dir)), keep=("page_id",), names=MATRIX)), keep=("page_id",), names=names)
    return ensemble.predict(matrix.scaled(m, state, keep=("page_id",))).select("page_id", "prediction", "probability")


@registered(ORACLE_SQL["visit_scores"])
def stream_scores(spark, sf_dir):
    """visit_scores as a stream over all visits."""
    from sparkwarden.streaming import jobs

    folder = shared(spark)
    visits(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = jobs.read_parquet_stream(spark, f"{folder}/in", "*.parquet")
    jobs.score_stream(stream, stand_in, f"{folder}/out", f"{folder}/state", f"{folder}/log", once=True, trusted=NET).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "url", "prediction", "probability", "whitelisted")


@registered()
def stream_ensemble(spark, sf_dir):
    """Visits scored by a fitted ensemble as they arrive, the first half by one version and the rest by the next, published in between."""
    from sparkwarden.streaming import jobs

    folder = shared(spark)
    _training(spark, sf_dir).write.parquet(f"{folder}/matrix")
    data = spark.read.parquet(f"{folder}/matrix")
    state = matrix.fitted_scaler(data)
    train = matrix.scaled(data, state, keep=("label",))
    for k, version in enumerate(("one", "two")):
        models.publish(models.fit(train, trees=20, rounds=10, depth=4 + 4 * k), state, f"{folder}/models", version)
        visits(spark, sf_dir).where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == k).write.mode("append").parquet(f"{folder}/in")
        served = models.Served(spark, f"{folder}/models")
        jobs.score_stream(jobs.read_parquet_stream(spark, f"{folder}/in", "*.parquet"), served, f"{folder}/out", f"{folder}/state", f"{folder}/log", once=True, trusted=NET).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "url", "prediction", "probability", "whitelisted")


@registered(f"""WITH {_MATCH}, c AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = m.id AND c.ts <= m.click_ts AND c.ts >= m.shown_ts))
SELECT shown_id, id, 'http://example.com/' AS url, CAST(button <> 0 AS INT) AS reported_label, click_ts AS timestamp FROM k QUALIFY row_number() OVER (PARTITION BY shown_id ORDER BY click_ts, button) = 1""")
def stream_feedback(spark, sf_dir):
    """Feedback of the first click on each live notification that no close came before, as a stream."""
    from sparkwarden.streaming import jobs

    folder = shared(spark)
    events = read(spark, sf_dir, "events")
    closes = events.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").alias("close_ts"))
    frames = dict(zip(("shown", "clicks", "closes"), (*shown_and_clicks(spark, sf_dir), closes)))
    frames["ticks"] = events.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))  # time goes on after the last event
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
    streams = [jobs.read_parquet_stream(spark, f"{folder}/{n}", "*.parquet") for n in frames]
    jobs.feedback_stream(*streams[:3], f"{folder}/out", f"{folder}/state", once=True, ticks=streams[3]).awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("timestamp", F.col("timestamp").cast(events.schema["ts"].dataType))
