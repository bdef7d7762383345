"""Mixing sources to target weights by a low-discrepancy schedule.

Every source owns as many cells of the unit interval as its target holds blocks. The van der Corput point of slot i falls in a cell and
so names the slot's source; a slot's rank among its source's slots names the block it takes. Blocks are runs of equally
many words of the source's documents, shuffled and laid end to end, round and round; the last one of a target holds the rest. Nothing corrects
the slots afterwards: what a source yields is what the points hand to it, up to the limit of passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import SPACE, WORD, cut, fresh, table_of

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK = 128


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def by_source() -> Column:
    return F.col("source").asc_nulls_last()


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df sorted, with the sum of value over all rows before each one; sums of whole partitions stand for what lies before a partition."""
    rows = cut(df.withColumn("_v", value).orderBy(*order)).withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_n", 33))
    parts = rows.groupBy("_p").agg(F.sum("_v").alias("_sum"))
    before = parts.select("_p", (F.sum("_sum").over(Window.orderBy("_p")) - F.col("_sum")).alias("_base"))  # one row a partition
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    return rows.join(F.broadcast(before), "_p").withColumn(name, (inside + F.col("_base")).cast("long")).drop("_n", "_p", "_v", "_base")


def of_source(df: DataFrame, facts: DataFrame, *names: str, most_sent: int = 100_000) -> DataFrame:
    """df with the named facts of its source; a null source is a source. Facts go to all rows by broadcast if they are at most `most_sent`, since few sources would be few tasks, else by a shuffle."""
    found = facts.select(F.col("source").alias("_s"), *names)
    found = found.hint("broadcast" if facts.count() <= most_sent else "merge")
    return df.join(found, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, start, weight, target double) from rows (source, size): shares of all words by weight, none above `passes` times its source.

    Sources rank by code point, null last, and take the weights in turn; start counts the words of the sources before. The excess of
    capped sources is shared again by weight: two sums a round come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = running(running(per, [by_source()], F.lit(1), "_rank"), [by_source()], F.col("source_size"), "start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    per = cut(per.select("source", "source_size", "start", weight.alias("weight")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * float(passes), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, taken, rest = per.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - taken) / rest
    return per.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def planned(sizes: DataFrame, weights: tuple[int, ...], passes: int, block: int) -> DataFrame:
    """targets with goal (whole words), need (blocks that hold the goal) and cell (the source's first cell)."""
    plan = targets(sizes, weights, passes).withColumn("goal", F.floor("target").cast("long"))
    plan = plan.withColumn("need", F.ceil(F.col("goal") / block).cast("long"))
    return cut(running(plan, [by_source()], F.col("need"), "cell"))


def laid_out(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized(row, doc_id, source, size, key) with `at`, the row's first word in its shuffled source, and the source's facts.

    The shuffle is the order of the key, a digest of doc_id and text, so reruns agree and no key is hot but that of rows that are the same.
    """
    rows = running(sized, [by_source(), F.col("key"), F.col("doc_id"), F.col("size")], F.col("size"), "_at")
    rows = of_source(rows, plan, "source_size", "target", "start")
    return rows.withColumn("at", F.col("_at") - F.col("start")).drop("_at", "start", "key")


def point(slot: Column, bits: int) -> Column:
    """The van der Corput point of a slot in base 2, as a cell of 2 ** bits: the bits of its number, turned round."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("long")


def schedule(plan: DataFrame) -> DataFrame:
    """(source, slot, turn): all slots whose point falls in a source's cells; turn counts the slots of a source from 0."""
    cells, sources = plan.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    bits = max(1, (cells - 1).bit_length())
    # Bins of cells turn the search for a cell's source into a join on equal bins.
    shift = max(0, bits - max(16, sources.bit_length() + 1))
    edges = plan.where("need > 0").select("source", "cell", "need", F.explode(F.sequence(F.shiftright("cell", shift), F.shiftright(F.col("cell") + F.col("need") - 1, shift))).alias("bin"))
    slots = plan.sparkSession.range(1 << bits).select(F.col("id").alias("slot"), point(F.col("id"), bits).alias("_cell")).withColumn("bin", F.shiftright("_cell", shift))
    hit = slots.join(edges, "bin").where("_cell >= cell and _cell < cell + need").select("source", "slot")
    ranked = cut(running(hit, [by_source(), F.col("slot")], F.lit(1), "_rank"))
    first = ranked.groupBy("source").agg(F.min("_rank").alias("_first"))
    return of_source(ranked, first, "_first").select("source", "slot", (F.col("_rank") - F.col("_first")).alias("turn"))


def pieces(laid: DataFrame, plan: DataFrame, passes: int, block: int) -> DataFrame:
    """row, size, slot, pass_no, lo, hi: words lo (from 0) to hi (exclusive) of a row, taken in a slot and pass."""
    taken = of_source(schedule(plan), plan, "source_size", "goal", "need")
    begin, most = F.col("turn") * block, F.col("source_size") * passes
    end = F.least(most, F.when(F.col("turn") == F.col("need") - 1, F.col("goal")).otherwise(begin + block))
    taken = taken.withColumn("begin", begin).withColumn("end", end).where("begin < end")
    taken = taken.withColumn("pass_no", F.explode(F.sequence(F.floor(F.col("begin") / F.col("source_size")), F.floor((F.col("end") - 1) / F.col("source_size")))))
    lap = F.col("pass_no") * F.col("source_size")
    taken = taken.select("source", "slot", "pass_no", F.greatest(F.col("begin") - lap, F.lit(0)).alias("from"), F.least(F.col("end") - lap, F.col("source_size")).alias("to"))
    taken = taken.withColumn("run", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    parts = laid.where("size > 0").select(F.col("source").alias("_s"), "row", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("_run"))
    joined = taken.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_run")))
    left = F.greatest("from", "at", F.col("run") * block)
    right = F.least("to", F.col("at") + F.col("size"), (F.col("run") + 1) * block)
    return joined.where(left < right).select("row", "size", "slot", "pass_no", (left - F.col("at")).alias("lo"), (right - F.col("at")).alias("hi"))


def sizes_of(doc_id: Column, text: Column, source: Column) -> list[Column]:
    """Columns doc_id, source, size and key of each row."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.md5(F.concat(shown(doc_id), F.lit(":"), F.md5(shown(text))))
    return [doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), size_of(text.cast("string")).alias("size"), key.alias("key")]


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix of sized(row, doc_id, source, size, key) as (pieces, rows laid out). row names each row; sized should be cut.

    Rows without words have no pieces; a null source is a source; repeated rows count each by itself; without words every target is 0.
    """
    plan = planned(sized, weights, passes, block)
    laid = cut(laid_out(sized, plan))
    return pieces(laid, plan, passes, block), laid


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, source, size, source_size, target, at, taken (words the mix takes of it), first_slot (null if none)."""
    sized = cut(docs.select(F.monotonically_increasing_id().alias("row"), *sizes_of(F.col("doc_id"), F.col("text"), F.col("source"))))
    got, laid = mix(sized, **settings)
    got = got.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("_got"), F.min("slot").alias("first_slot"))
    return laid.join(got, "row", "left").select("doc_id", "source", "size", "source_size", "target", "at", F.coalesce("_got", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_texts(docs: DataFrame, slots: bool = False, **settings) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each row of docs and pass that takes words of it; with slots also its first one, the order of the mix, in a last column `slot` (underscores follow if docs has one of that name).

    A row that a pass takes whole keeps its text as it is; one that a pass takes in part keeps those words, space-joined.
    Rows without words have nothing to take. Null and repeated doc_ids keep each row's own words, since rows go by a number of their own.
    """
    own = table_of(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    sized = cut(own.select("row", *sizes_of(F.col("doc.doc_id"), F.col("doc.text"), F.col("doc.source"))))
    got, _ = mix(sized, **settings)
    runs = got.groupBy("row", "pass_no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("size").alias("size"), F.min("slot").alias("slot"))
    words = F.filter(F.split("doc.text", SPACE), lambda w: w != "")
    part = F.array_join(F.slice(words, F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ")
    made = {"text": F.when(F.col("hi") - F.col("lo") == F.col("size"), F.col("doc.text")).otherwise(part)}
    out = own.join(runs, "row").withColumn("_text", made["text"])
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    made["text"] = F.col("_text")
    return out.select(*(made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns), *([F.col("slot").alias(fresh(docs, "slot"))] if slots else []))


#: DuckDB's SQL for op3: words by source in the order of the key, targets by the level at which water fills the capped sources, and the slot of each block.
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE turn WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
fill AS (SELECT 0.0::DOUBLE AS level, -1::BIGINT AS capped, 0 AS round UNION ALL
  SELECT CASE WHEN rest = 0 THEN level ELSE (total - taken) / rest END, n, round + 1 FROM (SELECT any_value(level) AS level, any_value(capped) AS capped, any_value(round) AS round, count(*) FILTER (weight * level > source_size * 3.0) AS n,
    coalesce(sum(source_size * 3.0::DOUBLE) FILTER (weight * level > source_size * 3.0), 0) AS taken, coalesce(sum(weight) FILTER (NOT weight * level > source_size * 3.0), 0) AS rest, CAST(sum(source_size) AS DOUBLE) AS total FROM w, fill) WHERE n <> capped AND rest > 0),
p AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT arg_max(level, round) FROM fill)) AS target FROM w),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, CAST(ceil(floor(target) / {BLOCK}) AS BIGINT) AS need FROM p),
c AS (SELECT *, CAST(sum(need) OVER (ORDER BY source NULLS LAST) - need AS BIGINT) AS cell, CAST(sum(need) OVER () AS BIGINT) AS cells FROM q),
b AS (SELECT greatest(1, length(ltrim(bin(greatest(max(cells) - 1, 0)), '0'))) AS bits FROM c),
v AS (SELECT slot, CAST('0b' || reverse(lpad(bin(slot), CAST(bits AS INT), '0')) AS BIGINT) AS point FROM (SELECT unnest(range(CAST(2 ** bits AS BIGINT))) AS slot, bits FROM b)),
h AS (SELECT c.source, slot, row_number() OVER (PARTITION BY c.source ORDER BY slot) - 1 AS turn FROM v JOIN c ON point >= cell AND point < cell + need),
l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, c.source_size, target, CASE WHEN size = 0 THEN 0 ELSE goal // c.source_size * size + greatest(0, least(goal % c.source_size, pos + size) - pos) END::BIGINT AS taken, h.slot AS first_slot
FROM l JOIN c ON l.source IS NOT DISTINCT FROM c.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM l.source AND h.turn = pos // {BLOCK} AND size > 0 AND pos < goal"""
