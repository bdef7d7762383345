"""What the text operators share: reading a table, folds, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and Python's syntax: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key gives null."""
    return F.crc32(key.cast("string")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one is set only if the session has none and runs on one machine, else ValueError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, by Hadoop's file system, whatever store it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, and lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table_of(df: DataFrame) -> DataFrame:
    """As cut, but as a compressed Parquet table, which for whole texts takes under half the disk; a type that Parquet can't hold is cut instead."""
    if "void" in df.schema.simpleString():
        return cut(df)
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hash_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of the key: no shuffle, and reruns agree."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * rows / total))


def join_hot(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", share: int = 64) -> DataFrame:
    """rows joined with named (at most one row a key) so that no key's rows meet in one task.

    Keys that hold over 1/share of all rows, fewer than `share` by count, find their row of named by broadcast;
    all others by shuffle. rows is read twice, so it should be cut. A null key finds nothing.
    """
    least = rows.count() // share
    hot = [r[0] for r in rows.groupBy(key).count().where((F.col("count") > least) & F.col(key).isNotNull()).collect()] if least else []
    if not hot:
        return rows.join(named, key, how)
    held = F.coalesce(F.col(key).isin(hot), F.lit(False))
    apart = rows.where(held).join(F.broadcast(named.where(held)), key, how)
    return rows.where(~held).join(named.where(~held), key, how).unionByName(apart)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): one row (node, root) per node in an edge; root is the smallest node.

    Each round gives every node its smallest neighbour as parent, jumps once to the parent's
    parent, and keeps the edges between different parents; the graph shrinks until no edge is left.
    All steps are joins and pre-aggregated minima; nothing is collected but one emptiness flag a round
    and the few keys that join_hot treats apart.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        parent = cut(parent)
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = cut(join_hot(parent, up, "p").select("v", F.col("pp").alias("to")))
        found = cut(join_hot(found, jump.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = (jump.select(F.col("v").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        moved = join_hot(cut(join_hot(edges, a, "a")), b, "b").where("a_to <> b_to")
        edges = cut(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct())
    return found
