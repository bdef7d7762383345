"""Labelled URLs, JSON requests and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.functions.httpurl import normalised

NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: Outcomes of a line of a labelled CSV file.
LOADED, TOO_LONG, MISSING, BAD_LABEL = "loaded", "too many fields", "missing value", "bad label"


def _lines(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, Column]:
    """The raw lines of a CSV with header as texts, and whether one has too many fields. Raises ValueError if a required column is missing; short lines are padded."""
    header = spark.read.option("encoding", encoding).csv(path, header=True).columns
    if missing := {"domain", "label"} - set(header):
        raise ValueError(f"missing columns: {sorted(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_bad"]])
    raw = spark.read.option("columnPruning", False).csv(path, header=True, schema=schema, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", escape='"')
    fields = F.size(F.split(F.regexp_replace("_bad", r'"(?:[^"]|"")*"', ""), ",", -1))
    # The second part is always true; Spark refuses plans that read nothing but the corrupt-record column.
    return raw, F.coalesce(fields > len(header), F.lit(False)) & (F.coalesce(F.length("label"), F.lit(0)) >= 0)


def _value(c: str) -> Column:
    return F.when(~F.col(c).isin(*NULLS), F.col(c))


def labelled_urls(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of a CSV with header: rows (domain string, label int) without nulls, skipped lines with too many fields.

    Short lines are padded. Raises ValueError if a required column is missing; a label that is no number fails when rows are read (see load_labelled).
    """
    raw, long = _lines(spark, path, encoding)
    rows = raw.where(~long).select(_value("domain").alias("domain"), _value("label").alias("label")).dropna()
    return rows.withColumn("label", F.col("label").cast("double").cast("int")), raw.where(long).select("_bad")


def checked_urls(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """outcome, domain, label (int), text of each line of a CSV with header: loaded, or why not.

    A line with too many fields is kept as text; a null domain or label is a missing value; a label that is no finite number within an int's range is a bad
    one, kept as text. Fractions of a label are cut off.
    """
    raw, long = _lines(spark, path, encoding)
    number = _value("label").try_cast("double")
    whole = F.when(F.abs(number) < 2**31, number.cast("int"))
    outcome = F.when(long, TOO_LONG).when(_value("domain").isNull() | _value("label").isNull(), MISSING).when(whole.isNull(), BAD_LABEL).otherwise(LOADED)
    df = raw.select(outcome.alias("outcome"), F.when(~long, _value("domain")).alias("domain"), F.when(~long, whole).alias("label"), F.when(long, F.col("_bad")).otherwise(F.col("label")).alias("text"))
    return df.withColumn("label", F.when(F.col("outcome") == LOADED, F.col("label"))).withColumn("text", F.when(F.col("outcome").isin(TOO_LONG, BAD_LABEL), F.col("text")))


def load_labelled(spark: SparkSession, path: str, folder: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Load a labelled CSV file in one pass: (rows (domain, label), rejects (outcome, domain, text), counts).

    All lines are written to `folder`, a part of it for each outcome, and counted as they are written: lines, and lines of each outcome.
    """
    seen = Observation()
    counts = {"lines": F.count("*"), **{k: F.count_if(F.col("outcome") == k) for k in (LOADED, TOO_LONG, MISSING, BAD_LABEL)}}
    lines = checked_urls(spark, path, encoding).observe(seen, *(c.cast("long").alias(k) for k, c in counts.items()))
    lines.write.mode("overwrite").partitionBy("outcome").parquet(folder)
    done = spark.read.schema("domain string, label int, text string, outcome string").parquet(folder)
    return done.where(F.col("outcome") == LOADED).select("domain", "label"), done.where(F.col("outcome") != LOADED).select("outcome", "domain", "text"), {k: seen.get[k] for k in counts}


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


def requests(raw: DataFrame, value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of JSON texts {url}: valid ones have `url` in its one form (see httpurl.normalised), rejected ones `url` as it came and a `reason`.

    A text that is no JSON, or has no url, misses it.
    """
    text = value if value is not None else F.col("value")
    got = normalised(raw.withColumn("url", F.from_json(text, "url string")["url"]), "url", "_http")
    valid, rest = got.where("_http.reason is null"), got.where("_http.reason is not null")
    return valid.withColumn("url", F.col("_http.url")).drop("_http"), rest.withColumn("reason", F.col("_http.reason")).drop("_http")


def reports(raw: DataFrame, value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of JSON texts {url, reported_label}: raw with url and a reported_label of 0 or 1; rejected ones with a `reason` instead: json, url or label.

    The url is any text; a label may be a number or a text that is a whole number. Columns of raw with those names are replaced.
    """
    text = (value if value is not None else F.col("value")).cast("string")
    kind = F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>")
    url, label = F.try_variant_get(F.try_parse_json(text), "$.url", "variant"), F.try_variant_get(F.try_parse_json(text), "$.reported_label", "string")
    shown = F.when(F.schema_of_variant(url) == "STRING", F.try_variant_get(F.try_parse_json(text), "$.url", "string"))
    number = F.when(label.rlike(r"^[+-]?\d+(\.0*)?$"), label.try_cast("double").cast("int"))
    reason = F.when(kind.isNull(), "json").when(shown.isNull(), "url").when(~F.coalesce(number.isin(0, 1), F.lit(False)), "label")
    rest = [c for c in raw.columns if c not in ("url", "reported_label", "reason")]
    rows = raw.select(*rest, shown.alias("url"), number.alias("reported_label"), reason.alias("reason"))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(*rest, "reason")
