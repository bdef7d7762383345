import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import models
from sparkwarden.operators.features import MATRIX


def rows(spark, n=60):
    x = spark.range(n).select("id", *(((F.col("id") * (k + 3)) % 11).cast("double").alias(c) for k, c in enumerate(MATRIX)))
    return x.withColumn("label", (F.col("id") % 3 == 0).cast("int")).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))


def test_split_comes_back(spark, tmp_path):
    models.save_split(rows(spark), str(tmp_path))
    train, test, names = models.load_split(spark, str(tmp_path))
    assert (train.count(), test.count(), names) == (48, 12, MATRIX)
    assert set(train.columns) == {"id", "label", *MATRIX}


def test_missing_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train"):
        models.load_split(spark, str(tmp_path))
    for side in ("train", "test"):
        rows(spark, 3).write.parquet(f"{tmp_path}/{side}")
    with pytest.warns(UserWarning, match="column list"):
        assert models.load_split(spark, str(tmp_path))[2] is None


def test_models_and_metrics_come_back(spark, tmp_path):
    data = rows(spark).drop("split")
    fitted = models.fit(data, trees=3, rounds=2, depth=3)
    (row,) = models.run_metrics(fitted, data).collect()
    assert row.rows == 60 and row.seconds == fitted.seconds > 0
    state = spark.createDataFrame([("url_length", 1.0, 2.0)], "feature string, mean double, scale double")
    models.save(fitted, state, str(tmp_path))
    again, back, names = models.load(spark, str(tmp_path))
    assert names == MATRIX and back.collect() == state.collect()
    assert again.predict(data).collect() == fitted.predict(data).collect()


def test_what_is_missing_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="column list, scaler, model"):
        models.load(spark, str(tmp_path / "none"))
    data = rows(spark).drop("split")
    state = spark.createDataFrame([("url_length", 1.0, 2.0)], "feature string, mean double, scale double")
    state.write.parquet(f"{tmp_path}/part/scaler")
    with pytest.raises(FileNotFoundError, match="no column list, model in"):
        models.load(spark, str(tmp_path / "part"))
    with pytest.raises(FileNotFoundError, match="no version"):
        models.Served(spark, str(tmp_path / "models"))
    assert data.count() == 60


def test_versions_swap_between_batches(spark, tmp_path):
    """A stream over two runs and three batches: each batch is scored by the version that was current, as batch scoring does."""
    from sparkwarden.operators import matrix
    from sparkwarden.plans.queries import _training, pages
    from sparkwarden.streaming import jobs

    data = _training(spark, "/root/testdata/sf0.001").persist()
    state = matrix.fitted_scaler(data)
    train = matrix.scaled(data, state, keep=("label",))
    flipped = train.withColumn("label", 1 - F.col("label"))
    urls = pages(spark, "/root/testdata/sf0.001").withColumn("status", F.lit("complete"))
    want = {}
    served = None
    for k, (version, on) in enumerate((("one", train), ("two", flipped))):
        fitted = models.fit(on, trees=3, rounds=2, depth=3, newton=bool(k))
        models.publish(fitted, state, f"{tmp_path}/models", version)
        served = served or models.Served(spark, f"{tmp_path}/models")
        part = urls.where(F.col("page_id") % 2 == k)
        want |= {r.url: r.prediction for r in models.Served(spark, f"{tmp_path}/models")(part.select("url")).collect()}
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.score_stream(jobs.read_parquet_stream(spark, f"{tmp_path}/in", "*.parquet"), served, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
        assert served.version == version and models.current_version(spark, f"{tmp_path}/models") == version
    got = {r.url: r.prediction for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and set(got.values()) == {0, 1} and len(got) == urls.count()
    direct = fitted.predict(matrix.scaled(matrix.aligned(models.features(urls.where("page_id % 2 = 1"), keep=("url",), names=MATRIX), keep=("url",)), state, keep=("url",)))
    assert all(got[r.url] == r.prediction for r in direct.collect())


def test_exact_split_ranks_only_the_cut(spark):
    """Equal to a plain rank by label, with null labels and keys, repeated rows and columns of any name; one narrow shuffle of rows."""
    import hashlib

    from sparkwarden.operators import matrix

    data = [(k % 700 if k % 50 else None, None if k % 97 == 0 else k % 3, k) for k in range(9_000)]
    df = spark.createDataFrame(data, "key long, label int, _split_md long")
    got = matrix.exact_split(df, "key").collect()
    assert len(got) == 9_000 and set(got[0].asDict()) == {"key", "label", "_split_md", "split"}
    for label in (0, 1, 2, None):
        mine = [r for r in data if r[1] == label]
        order = sorted(mine, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0))
        n = int(len(mine) * 0.2 + 0.5)
        want = sorted(str(r[0]) for r in order[:n])
        assert sorted(str(r.key) for r in got if r.label == label and r.split == "test") == want
