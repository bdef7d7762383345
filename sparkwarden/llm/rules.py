"""Quality rules in DataFrame functions only: base counts of each text, and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into `buckets` counters; two smoothed multinomials are counted, one over trusted
texts and one over the whole corpus. A document's verdict is the mean log-ratio of its n-grams, held
against a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import SPACE, cut

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
BUCKETS = 1 << 14
#: The white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
THRESHOLD = -0.1


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(df: DataFrame, runs: str, have: int, width: int, name: str) -> DataFrame:
    """df with column `name`: hashes of all runs of `width` words, from `runs`, the hashes of all runs of `have` words.

    A longer run is hashed from two shorter ones, the second `step` words on. Each length is a column of its own, so slices stay in generated code.
    """
    while have < width:
        step = min(have, width - have)
        n = F.greatest(F.size(runs) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(runs, 1, n), F.slice(runs, step + 1, n), lambda x, y: F.xxhash64(x, y)))
        runs, have = name, have + step
    return df


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows found twice or more, the first included."""

    def places(sorted_windows: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            beside = lambda n: F.coalesce(F.get(sorted_windows, k + n)["h"] == x["h"], F.lit(False))
            return F.struct((beside(-1) | beside(1)).alias("twice"), x["i"].alias("i"))

        return F.sort_array(F.transform(F.filter(F.transform(sorted_windows, twin), lambda x: x["twice"]), lambda x: x["i"]))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda t, p: F.struct((t["n"] + F.least(F.lit(width), p + width - t["end"])).alias("n"), (p + width).alias("end"))
        return F.aggregate(let(ranked, places), start, step, lambda t: t["n"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def grams(df: DataFrame) -> DataFrame:
    """df(_text) with _words, _h (hashes of the words) and _pairs (hashes of all two neighbours)."""
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn("_h", word_hashes(F.col("_words")))
    return window_hashes(df, "_h", 1, 2, "_pairs")


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0, most_sent: int = 1_000_000) -> DataFrame:
    """One row with _llr, the log-ratio of each bucket's chance among trusted texts to that in the whole corpus.

    Trusted are all documents with labels.quality = 1; the corpus counts cover every document. Without trusted texts all ratios fall to their smoothing.
    Up to `most_sent` trusted ids (8 bytes each) go to the texts by broadcast; more meet them by a shuffle, with the same result.
    """
    known = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    known = known.withColumn("_trusted", F.lit(1)).hint("broadcast" if known.count() <= most_sent else "merge")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = grams(docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text")).join(known, "_id", "left"))
    each = texts.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(F.concat("_h", "_pairs")).alias("gram"))
    counts = each.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("all"), F.sum("t").alias("trusted"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("trusted", F.lit(0)).alias("trusted")))).alias("c"), F.sum("all").alias("n_all"), F.sum("trusted").alias("n_trusted"))
    share = lambda n, total: F.log((n + smoothing) / (F.coalesce(total, F.lit(0)) + smoothing * buckets))
    return cut(row.select(F.transform("c", lambda x: share(x["trusted"], F.col("n_trusted")) - share(x["all"], F.col("n_all"))).alias("_llr")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    llr is the mean log-ratio of the text's n-grams (0 without words); kept needs llr >= threshold and that the base rules pass.
    Null and empty texts have no words and fail the base rules. Rows are handled one by one; other columns are ignored.
    """
    model = ratios(docs, labels, **settings)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    own = window_hashes(grams(own), "_pairs", 2, WINDOW, "_runs").withColumn("_llr", model.scalar())
    long = lambda c: c.cast("long")
    total = F.aggregate(F.concat("_h", "_pairs"), F.lit(0.0), lambda t, gram: t + F.get("_llr", bucket(gram, settings.get("buckets", BUCKETS))))
    out = own.select(
        "doc_id", long(F.size("_h")).alias("n_words"), long(F.length(F.array_join("_words", ""))).alias("word_chars"), long(F.regexp_count("_text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(duplicate_lines(F.col("_text"))).alias("n_dup_lines"), long(repeated_words(F.col("_runs"))).alias("n_repeat_words"), (total / F.greatest(F.size("_h") + F.size("_pairs"), F.lit(1))).alias("llr"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
