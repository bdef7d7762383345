"""Small inputs that every text operator must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

ODD = [
    (1, "The the of and ther inth.\nThe the of and ther inth.", "en", "a", 3),
    (1, "The the of and ther inth.\nThe the of and ther inth.", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, "le la des éèux ment ré", "fr", "b", 1),
    (4, " \t\n ", "fr", "b", 1),
    (5, "x" * 40_000, "en", "a", 1),
    (6, "word " * 9_000, "en", "a", 1),
    (7, "1234567890 " * 4_000 + "a.b@c.de " + "9" * 30_000, "de", "\U0001f600", 1),
    (8, "日本語 テキスト 😀 " * 3, None, "b", 1),
]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a clashing extra column of every name that operators use inside."""
    extra = ["score", "size", "fp", "a", "b", "target", "taken", "n_words", "kept", "held_out", "spans", "lang_pred", "row", "at", "slot", "doc", "id", "print", "root", "found", "learn", "rest", "nothing", "file"]
    extra += ["_key", "_id", "_k", "_l", "_learn", "_pii", "_p", "_s", "_h", "_d", "_n", "_v", "_at", "_q", "_toxic", "_votes", "_words", "_text", "_pairs", "_runs", "_llr", "_trusted", "_clean", "_base", "_all"]
    df = spark.createDataFrame(ODD, DOCS)
    return df.selectExpr("*", *(f"'x' as `{x}`" for x in extra))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
