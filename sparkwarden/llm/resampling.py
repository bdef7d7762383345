"""Importance resampling towards a target distribution: hashed n-gram features, log ratios of bucket shares, Gumbel top-k.

CRC-32 is affine over XOR: the checksum of a span is a constant of its length XOR what each byte adds, which depends on the byte and on how
many bytes of the span follow it. `TABLE` holds those contributions by distance from the end. The words of many texts lie in one
array; all features of one length that don't overlap are summed by one bitwise_xor.reduceat over their spans. A span over DEPTH bytes is
cut in blocks from its end; the sum of what lies before is moved on by DEPTH bytes and XORed with the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut

DEPTH = 128
POLYNOMIAL = 0xEDB88320
#: Bytes of text whose features are summed at a time.
SLICE = 1 << 20
#: ASCII letters (folded to lower case), digits and every byte of a character beyond ASCII are parts of words; all else parts them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _after(state: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    for _ in range(zeros):
        state = one[state & 255] ^ (state >> 8)
    return state


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What byte b adds with d bytes behind it (at d * 256 + b), what a byte of a state becomes DEPTH bytes later (at place * 256 + byte), checksums of up to DEPTH zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(1, DEPTH):
        rows.append(_after(rows[-1], one, 1))
    moved = np.concatenate([_after(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), one, DEPTH) for k in range(4)])
    states = [np.array([0xFFFFFFFF], np.uint32)]
    for _ in range(DEPTH):
        states.append(_after(states[-1], one, 1))
    return np.concatenate(rows), moved, ~np.concatenate(states)


TABLE, MOVED, CONSTANT = _tables()


def _on(state: np.ndarray) -> np.ndarray:
    """States DEPTH zero bytes later."""
    return MOVED[state & 255] ^ MOVED[256 + (state >> 8 & 255)] ^ MOVED[512 + (state >> 16 & 255)] ^ MOVED[768 + (state >> 24)]


def _constants(lengths: np.ndarray) -> np.ndarray:
    """Checksums of that many zero bytes."""
    out = CONSTANT[lengths % DEPTH if (lengths > DEPTH).any() else lengths].copy()
    left = lengths // DEPTH if (lengths > DEPTH).any() else np.zeros(len(lengths), np.int64)
    while (far := left > 0).any():
        out[far] = ~_on(~out[far])
        left[far] -= 1
    return out


def _block_sums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the contributions in each block of at most DEPTH bytes; blocks are in order and don't overlap."""
    out, k = np.empty(len(begin), np.uint32), 0
    while k < len(begin):
        e = max(k + 1, int(np.searchsorted(begin, begin[k] + SLICE)))
        lo, hi = int(begin[k]), int(end[e - 1])
        edges = np.stack([begin[k:e], end[k:e]], 1).ravel() - lo
        until = np.repeat(edges[1:].astype(np.int32), np.diff(edges))
        behind = np.minimum(until - 1 - np.arange(hi - lo, dtype=np.int32), DEPTH - 1)  # what lies between blocks counts for nothing
        adds = TABLE[behind * 256 + raw[lo:hi]]
        out[k:e] = np.bitwise_xor.reduceat(np.append(adds, np.uint32(0)), edges)[::2]
        k = e
    return out


def span_checksums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span raw[begin:end] (uint8); spans are in order, not empty, and don't overlap."""
    lengths = end - begin
    if not len(lengths):
        return np.empty(0, np.uint32)
    blocks = -(-lengths // DEPTH)
    first = np.cumsum(blocks) - blocks
    rank = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    ends = np.repeat(end, blocks) - (np.repeat(blocks, blocks) - 1 - rank) * DEPTH
    sums = _block_sums(raw, np.where(rank == 0, np.repeat(begin, blocks), ends - DEPTH), ends)
    out, k = sums[first], 1
    long = np.flatnonzero(blocks > 1)
    while len(long):
        out[long] = _on(out[long]) ^ sums[first[long] + k]
        k += 1
        long = long[blocks[long] > k]
    return out ^ _constants(lengths)


def pieces(text: bytes | None, width: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text by slices: each slice's words after the last width - 1 words before it, and how many those are."""
    folded, lo, before = (text or b"").translate(FOLD), 0, []
    while lo < len(folded):
        hi = lo + SLICE
        if hi < len(folded):
            hi = max(folded.rfind(b" ", lo + 1, hi), 0) or folded.find(b" ", hi)
        words = before + (folded[lo:hi] if hi > 0 else folded[lo:]).split()
        yield words, len(before)
        before, lo = words[len(words) - width + 1 :] if 1 < width <= len(words) else words if width > 1 else [], hi if hi > 0 else len(folded)


def hashed(texts: list[bytes | None], width: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words of it and the following ones, (text, bucket) of their features), slice by slice; a long text comes in several slices."""
    group: list[tuple[int, list[bytes], int]] = []
    size = 0
    for k, text in enumerate(texts):
        for words, old in pieces(text, width):
            group.append((k, words, old))
            size += sum(map(len, words))
            if size >= SLICE:
                yield _features(group, width, buckets)
                group, size = [], 0
    if group:
        yield _features(group, width, buckets)


def _features(group: list[tuple[int, list[bytes], int]], width: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    counts = np.array([len(words) for _, words, _ in group])
    raw = np.frombuffer(b" ".join([b" ".join(words) for _, words, _ in group if words]), np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw)) if len(raw) else np.empty(0, np.int64)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    piece = np.repeat(np.arange(len(group)), counts)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    new = place >= np.array([old for _, _, old in group])[piece] if len(piece) else np.empty(0, bool)
    text = np.array([k for k, _, _ in group])
    found = []
    for n in range(1, width + 1):
        for r in range(n):
            at = np.arange(r, len(piece) - n + 1, n)
            at = at[(piece[at] == piece[at + n - 1]) & new[at + n - 1]]
            if len(at):
                found.append(np.stack([text[piece[at]], span_checksums(raw, begins[at], ends[at + n - 1]).astype(np.int64) % buckets]))
    words = np.bincount(text[piece[new]] - text[0], minlength=text[-1] - text[0] + 1)
    return int(text[0]), words, np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)


def bucket_counts(texts: DataFrame, width: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts in each bucket; a task sends at most a row for each bucket, and so many come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for x in batches:
            for _, _, (_, bucket) in hashed(x["text"].tolist(), width, buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pd.DataFrame({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(buckets, np.int64)
    raw = texts.select(F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    for r in raw.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the corpus, floored."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, width: int = 2, name: str = "weighed") -> DataFrame:
    """docs with a struct `name`: n_words, n_features, weight (the floored mean of its features' gains, 0 without features)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            words, n, total = (np.zeros(len(x), np.int64) for _ in range(3))
            for first, counted, (text, bucket) in hashed(x.tolist(), width, len(sent.value)):
                words[first : first + len(counted)] += counted
                n += np.bincount(text, minlength=len(x))
                by = np.argsort(text, kind="stable")
                some, starts = np.unique(text[by], return_index=True)
                if len(some):
                    total[some] += np.add.reduceat(sent.value[bucket[by]], starts)
            yield pd.DataFrame({"n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    return docs.withColumn(name, of.asNondeterministic()(F.col("text").cast("string").cast("binary")))  # else each field that is read hashes the text again


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that the id alone decides; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored(doc_id, score, ...) in the order of falling score, then doc_id (null last), with rank from 1 for the first `percent` of 100 of all rows, else null.

    The rank of a row is its place in its sorted partition behind the rows of the partitions before, one count each.
    """
    n, p = F.col("_n"), F.shiftright("_n", 33)
    rows = cut(scored.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).withColumn("_n", F.monotonically_increasing_id())
    sizes = rows.groupBy(p.alias("_p")).agg(F.count("*").alias("_size"))
    before = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_all"))  # one row a partition
    place = F.col("_before") + n.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = rows.join(F.broadcast(before), p == F.col("_p"))
    return out.withColumn("rank", F.when(place <= F.floor(F.col("_all") * percent / 100), place)).drop("_n", "_p", "_size", "_before", "_all")


def _drawn(docs: DataFrame, target: DataFrame, percent: int, least: int, width: int, buckets: int, seed: int, *carry: str) -> DataFrame:
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    rows = weighed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry), gain, width).select("doc_id", *carry, "weighed.*")
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    short = rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(F.col("n_words") >= least), percent).withColumn("rank", F.col("rank").cast("long")).unionByName(short)


def importance(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, width: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs(doc_id, text), resampled towards target(text).

    rank counts from 1 the first floor(percent * N / 100) of the N rows of at least `least` words, by falling score, ties to the smaller
    doc_id; other rows have a null rank. Null and empty texts have no features and weight 0. A null doc_id draws by an empty id and comes
    last among equal scores; repeated rows draw alike and count each. Without target texts, or without docs, all shares are the smoothing's. Other columns are ignored.
    """
    return _drawn(docs, target, percent, least, width, buckets, seed)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, width: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """The rows of docs that `importance` gives a rank, whole and with docs' columns; repeated rows are told apart by a number of their own."""
    own = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    picked = _drawn(own.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), target, percent, least, width, buckets, seed, "row")
    return own.join(picked.where("rank is not null").select("row"), "row", "left_semi").select("doc.*")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: DuckDB's SQL for op11: the checksum of each different feature byte by byte.
ORACLE = f"""WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, i)) AS t),
b AS (SELECT 1 AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 2, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM b),
f AS (SELECT side, row, unnest(words || list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS feature FROM w),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
c AS (SELECT feature, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM h, steps),
s AS (SELECT bucket, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM f JOIN c USING (feature) GROUP BY bucket),
n AS (SELECT coalesce(CAST(sum(s) AS DOUBLE), 0) AS all_s, coalesce(CAST(sum(t) AS DOUBLE), 0) AS all_t FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM s, n),
m AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE side = 1 GROUP BY row),
r AS (SELECT w.row, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON w.row = m.row WHERE side = 1),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS many FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN place END AS BIGINT) AS rank FROM k"""
