"""Logs that take each batch once: files by day, and a commit record that says which of them count.

    <path>/data/date=.../batch=.../attempt=...   what an attempt at a batch has written
    <path>/commits/<batch>                       one file: the attempt that counts, and the batches that it stands in for

A batch that dies between its files and its record leaves files that no reader looks at, and is written again under another attempt. A batch
that has its record is not written again. Everything goes through Spark's own readers and writers.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "batch string, attempt string, replaces string, committed_at timestamp"
_PLACE = ("date", "batch", "attempt")


def _name(batch: object) -> str:
    """A batch's folder name, which is never taken for a number."""
    return f"b-{batch}"


def _there(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The Parquet files at a path, or an empty frame if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each committed batch (replaces is null), and one for each batch that it stands in for."""
    return _there(spark, f"{path}/commits/*", _COMMIT)


def committed(spark: SparkSession, path: str, batch: object) -> bool:
    return not commits(spark, path).where(F.col("batch") == _name(batch)).isEmpty()


def _write(log: DataFrame, path: str, batch: str) -> str:
    """Write an attempt at a batch, a folder for each day of its timestamp (null: an own one); nothing of it counts yet."""
    attempt = f"a-{uuid.uuid4()}"
    log.withColumns({"date": F.to_date("timestamp"), "batch": F.lit(batch), "attempt": F.lit(attempt)}).write.mode("append").partitionBy(*_PLACE).parquet(f"{path}/data")
    return attempt


def _commit(spark: SparkSession, path: str, batch: str, attempt: str, replaces: list[str] | None = None) -> None:
    """One file, moved into place when it is complete; a record that was cut off is overwritten."""
    rows = [(batch, attempt, r) for r in [None, *(replaces or [])]]
    record = spark.createDataFrame(rows, "batch string, attempt string, replaces string").withColumn("committed_at", F.current_timestamp())
    record.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")


def append_log(log: DataFrame, path: str, batch: object | None = None) -> bool:
    """Append records (timestamp, ...) as a batch, once: False if a batch of that name is in the log already. Without a name every call is a batch of its own.

    Columns named date, batch or attempt are not allowed in records.
    """
    if taken := {c.lower() for c in log.columns} & set(_PLACE):
        raise ValueError(f"columns of the log itself: {sorted(taken)}")
    spark, name = log.sparkSession, _name(batch if batch is not None else uuid.uuid4())
    if batch is not None and committed(spark, path, batch):
        return False
    _commit(spark, path, name, _write(log, path, name))
    return True


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The records of all committed batches with their columns `schema` and `date`; of a batch and one that stands in for it only the latter. No log yet: no records."""
    known = commits(spark, path)
    gone = known.where("replaces is not null").select(F.col("replaces").alias("batch"))
    live = known.where("replaces is null").select("batch", "attempt").join(gone, "batch", "left_anti")
    columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*columns, *(T.StructField(c, T.DateType() if c == "date" else T.StringType()) for c in _PLACE)])
    data = _there(spark, f"{path}/data", full)
    return data.join(live, ["batch", "attempt"], "left_semi").select(*columns.names, "date")


def compact(spark: SparkSession, path: str, schema: str | T.StructType, rows_per_file: int = 5_000_000) -> int:
    """Rewrite all committed batches as one with few files a day; how many batches that were. Readers see the old files until the new ones are committed, then those.

    A day's rows go to as many tasks as hold rows_per_file each. The files of before stay until their folders are removed.
    """
    known = commits(spark, path)
    gone = known.where("replaces is not null").select(F.col("replaces").alias("batch"))
    old = [r.batch for r in known.where("replaces is null").join(gone, "batch", "left_anti").select("batch").distinct().collect()]  # one row a batch
    if len(old) < 2:
        return 0
    records = read_log(spark, path, schema)
    most = records.groupBy("date").count().agg(F.max("count")).first()[0] or 0
    spread = F.floor(F.rand(0) * max(1, -(-most // rows_per_file)))
    name = _name(f"compacted-{uuid.uuid4()}")
    _commit(spark, path, name, _write(records.repartition("date", spread).drop("date"), path, name), old)
    return len(old)
