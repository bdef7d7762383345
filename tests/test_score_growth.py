from pyspark.sql import functions as F

from sparkwarden.operators import scoring


def test_urls_are_judged_on_all_cores(spark):
    """A few thousand URLs are too few bytes for more than one partition, but much work."""
    seen = []

    def model(urls):
        seen.append(urls.rdd.getNumPartitions())
        return urls.select("url", F.length("url").alias("prediction"), F.lit(-1.0).alias("probability"))

    visits = spark.range(4_000).select(F.col("id").alias("event_id"), F.concat(F.lit("http://h.example/"), F.col("id") % 1_000).alias("url"))
    got = scoring.score(visits.union(visits.limit(3).withColumn("url", F.lit(None).cast("string"))), model)
    assert got.count() == 4_003 and got.where("prediction = length(url)").count() == 4_000
    assert seen == [spark.sparkContext.defaultParallelism]
