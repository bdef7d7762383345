import duckdb
from pyspark.sql import functions as F

from sparkwarden.plans.queries import rounded


def test_halves_round_as_in_sql(spark):
    """Means over 640 rows end in the seventh place, at a half: among them 4.1703125, whose product with a million lies below it."""
    df = spark.range(-20_000, 20_000).select("id", ((F.col("id") * 2 + 1) / 640).alias("x"))
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, 0.1), (5, 1e300), (6, 123456789.0000005)], "id long, x double")
    for rows in (df, odd):
        halves = rows.toArrow()
        want = dict(duckdb.connect().sql("select id, round(x, 6) from halves").fetchall())
        got = {r.id: r.x for r in rounded(rows).collect()}
        assert repr(sorted(got.items())) == repr(sorted(want.items()))
