"""WARC archives by Spark's own text source: written with one record a row, read in splits, and verified along the chain of record lengths.

A record is a header, a blank line, a block of the header's Content-Length and two line ends. The reader splits archives at the bytes
that begin a record. Those bytes may also stand inside a payload, so each piece is only a candidate: it emits its own offset and
its successor's, as far as its header names a length. Inside a split, pointers are followed to where they leave it; between splits, pointer jumping
from the start of each file doubles the distance each round. Only what is reached so is a record; pieces in between are put back into the payload that holds them.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, join_hot, shared_folder

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def header_value(text: Column) -> Column:
    """A text that can stand in a header line: white space as URLs escape it, no other control characters, and never the magic at its end."""
    safe = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")), text.cast("string"))
    safe = F.regexp_replace(safe, r"[\x00-\x1F\x7F]", "")
    return F.when(safe.endswith(MAGIC.strip()), F.concat(safe, F.lit(" "))).otherwise(safe)


def digested(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumns({"digest": F.sha2(F.col("body").cast("binary"), 256), "size": F.octet_length("body").cast("long")})


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, at: Column | None = None, most_sent: int = 200_000) -> DataFrame:
    """value: one record for each row of pages, without its last two line ends.

    Of rows with equal payloads of at least `least` bytes those with the smallest key are responses; the others revisit it, and hold no payload.
    A null payload is an empty one; a null key never comes first, and rows without any key that isn't null are responses. Rows that repeat key and payload of a
    response are responses too, with its record id. The first keys of repeated payloads go to the pages by broadcast if they are at most `most_sent`, else both meet by a shuffle that is split where a payload is hot.
    """
    rows = digested(pages, key, url, payload)
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated)
    rows = rows.join(repeated.hint("broadcast" if repeated.count() <= most_sent else "merge"), "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda field, c: F.concat(F.lit(f"{field}: "), c, F.lit("\r\n"))
    stamp = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.lit("Content-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("body")))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("key"))), line("WARC-Date", stamp),
        F.coalesce(line("WARC-Target-URI", header_value(F.col("url"))), F.lit("")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(IDENTICAL)), line("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, **settings) -> None:
    """Archives of all pages in a folder, one for each partition."""
    records(pages, **settings).write.option("lineSep", END).text(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between the magics of each archive, byte for byte, with its file and split."""
    place = {"file": "file_path", "block": "file_block_start", "file_size": "file_size"}
    return spark.read.option("lineSep", MAGIC).text(folder).select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in place.items()))


def facts(v: Column) -> dict[str, Column]:
    """What a piece says of itself: bytes, the record's bytes behind the magic (null without a header that names a length), its fields, and the payload if it is all there."""
    head = F.substring_index(v, END, 1)
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    until = (F.octet_length(head) + len(END) + F.when(v.contains(END), field("Content-Length")).try_cast("long")).cast("long")
    both = F.octet_length(F.substring_index(v, END, 2)) + len(END)  # up to the end of an HTTP header
    begin = F.when(F.lower(field("Content-Type")).startswith("application/http") & (both <= until), both).otherwise(F.octet_length(head) + len(END))
    payload = F.when(F.octet_length(v) >= until, F.substring(v.cast("binary"), begin + 1, (until - begin).cast("int")))
    return {
        "n": F.octet_length(v).cast("long"), "step": until + len(END), "type": field("WARC-Type"), "record_id": field("WARC-Record-ID"), "refers_to": field("WARC-Refers-To"), "target": field("WARC-Target-URI"),
        "declared": field("WARC-Payload-Digest"), "payload": payload,
    }


def measured(df: DataFrame) -> DataFrame:
    """df with the size and digest of its payload in place of it."""
    return df.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256)}).drop("payload")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """file, block, file_size, offset, next of each piece that a magic precedes, with its facts and a digest of it: narrow rows, written to the shared folder.

    A piece's offset is the sum of all before it: inside its split by the order of reading, and one sum for each split of the file.
    """
    rows = scan(spark, folder).withColumn("id", F.monotonically_increasing_id())
    rows = cut(measured(rows.select("file", "block", "file_size", "id", F.sha2(F.col("value").cast("binary"), 256).alias("print"), *(c.alias(k) for k, c in facts(F.col("value")).items()))))
    full = F.col("n") + len(MAGIC)
    sums = rows.groupBy("file", "block").agg(F.sum(full).alias("sum"))
    base = sums.select("file", "block", (F.sum("sum").over(Window.partitionBy("file").orderBy("block")) - F.col("sum")).alias("base"))  # one row a split
    inside = F.sum(full).over(Window.partitionBy("file", "block").orderBy("id")) - full
    placed = rows.withColumn("inside", inside).join(base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC))
    return cut(placed.where("offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("step")).drop("base", "inside", "id"))


def _inside(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of a split in order, successors (-1: none), and the position of each successor in the split (-1: outside)."""
    x = x.sort_values("offset")
    at, to = x["offset"].to_numpy(np.int64), x["next"].fillna(-1).to_numpy(np.int64)
    place = np.searchsorted(at, to)
    return at, to, np.where((place < len(at)) & (at[np.minimum(place, len(at) - 1)] == to), place, -1)


def _exits(x: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves its split."""
    at, to, place = _inside(x)
    for k in range(len(at) - 1, -1, -1):
        if place[k] >= 0:
            to[k] = to[place[k]]
    return pd.DataFrame({"file": x["file"].iloc[0], "offset": at, "to": to})


def _reached(x: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the chains from a split's entries meet."""
    at, _, place = _inside(x)
    live = x.sort_values("offset")["entry"].to_numpy(bool).copy()
    for k in range(len(at)):
        if live[k] and place[k] >= 0:
            live[place[k]] = True
    return pd.DataFrame({"file": x["file"].iloc[0], "offset": at[live]})


def chain(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that are records: those that the chain from their file's start reaches.

    Splits meet only at their entries, which pointers of other splits name; every round joins them to the pointers and doubles what a pointer spans.
    """
    narrow = found.select("file", "block", "offset", "next")
    exits = cut(narrow.groupBy("file", "block").applyInPandas(_exits, "file string, offset long, to long"))
    named = exits.select("file", F.col("to").alias("offset")).union(exits.where("offset = 0").select("file", "offset")).distinct()
    jump = cut(exits.join(named, ["file", "offset"], "left_semi"))
    entries, n = cut(jump.where("offset = 0").select("file", "offset")), -1
    while (now := entries.count()) != n:
        n = now
        entries = cut(entries.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset")).union(entries).distinct())
        beyond = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(beyond, ["file", "to"], "left").select("file", "offset", F.coalesce("far", "to").alias("to")))
    marked = narrow.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(_reached, "file string, offset long")


def whole(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(file, offset, value): the text behind the magic of each record of parts(file, offset, at, print), whose pieces lie at `at`.

    Pieces are read again and found by their digest, equal ones once; a record's pieces meet in its row.
    """
    texts = scan(spark, folder).select(F.sha2(F.col("value").cast("binary"), 256).alias("print"), "value")
    texts = texts.join(parts.select("print").distinct(), "print", "left_semi").dropDuplicates(["print"])
    pieces = parts.join(texts, "print").groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
    return pieces.select("file", "offset", F.array_join("p.value", MAGIC).alias("value"))


def _indexed(spark: SparkSession, folder: str, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(candidates with `record` true or false, records whose payload other candidates cut)."""
    found = candidates(spark, folder)
    marked = cut(found.join(chain(found).withColumn("record", F.lit(True)), ["file", "offset"], "left").withColumn("record", F.coalesce("record", F.lit(False))))
    if strict:
        ends = scan(spark, folder).select("file", "file_size").distinct().join(marked.where("record").groupBy("file").agg(F.max("next").alias("end")), "file", "left")
        if bad := ends.where("end is null or end <> file_size").select("file").take(3):
            raise ValueError(f"the chain of records doesn't reach the end of {', '.join(r.file for r in bad)}")
    return marked, marked.where("record and payload_bytes is null")


def _pieces(marked: DataFrame, of: DataFrame) -> DataFrame:
    """(file, offset, at, print) of all pieces of the records `of`; what is no record belongs to the last record before it."""
    rows = of.select("file", F.col("offset").alias("at"), "print", F.col("offset").alias("own")).union(marked.where("not record").select("file", F.col("offset").alias("at"), "print", F.lit(None).cast("long")))
    held = F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))  # only cut records and false candidates, not all records of a file
    return rows.select("file", held.alias("offset"), "at", "print").where("offset is not null")


SHOWN = ("file", "offset", "length", "type", "record_id", "target", "refers_to", "declared", "payload_bytes", "payload_sha256")


def read(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """One row for each record of a folder's archives: file, offset, length, type, record_id, target, refers_to, declared (digest), payload_bytes, payload_sha256.

    The payload is the block, less an HTTP header if the block is an HTTP message; texts that a header lacks are empty. With strict a file
    whose chain doesn't reach its end (cut off, damaged, or a header line of another writer that ends in the magic) raises ValueError, else what is reached is returned. Empty files and folders hold no records.
    """
    marked, broken = _indexed(spark, folder, strict)
    length = (F.col("next") - F.col("offset")).alias("length")
    shown = [length if c == "length" else F.col(c) for c in SHOWN]
    if broken.isEmpty():
        return marked.where("record").select(*shown)
    full = whole(spark, folder, _pieces(marked, broken))
    again = measured(full.select("file", "offset", F.length("value").alias("seen"), facts(F.col("value"))["payload"].alias("payload"))).drop("seen")
    mended = broken.drop("payload_bytes", "payload_sha256").join(again, ["file", "offset"]).select(*shown)
    return marked.where("record and payload_bytes is not null").select(*shown).unionByName(mended)


def payloads(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """file, offset, type, record_id, refers_to, payload (binary) of each record."""
    marked, _ = _indexed(spark, folder, strict)
    full = whole(spark, folder, _pieces(marked, marked.where("record")))
    said = facts(F.col("value"))
    return full.select("file", "offset", *(said[c].alias(c) for c in ("type", "record_id", "refers_to", "payload")))


def resolved(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record that `write` made: a revisit has size and digest of the payload that it refers to."""
    own = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    index = cut(index.select("type", "record_id", "refers_to", "payload_bytes", "payload_sha256"))
    first = index.where("type = 'response'")
    named = first.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_sha256").dropDuplicates(["refers_to"])
    again = join_hot(cut(index.where("type = 'revisit'").select("record_id", "refers_to", "type")), named, "refers_to", "left")
    every = first.unionByName(again)
    return every.select(own("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), own("refers_to").alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write all pages to a folder (a new one in the shared folder unless given), read the archives back, and return a row a page, as `resolved` does."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write(pages, folder, **settings)
    return resolved(read(spark, folder))


#: DuckDB's SQL for op12: the first of equal payloads is the response.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), s AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM s"""
