"""Hard negatives by exact integer inner products, several candidates to a number.

Components are whole numbers. Biased so that none is negative, the components of several candidates lie in separate fields of one wide
integer (Kronecker packing): one product with an anchor's component multiplies them all, and no field overflows into the next, since each
is as wide as the largest sum. Unpacked fields less the biases' share are the exact inner products. Where a packed sum stays under 2 ** 53 it
is carried in doubles, which hold it exactly, so that the sums of a tile are one matrix product; larger numbers are Python's integers.

Anchors meet tiles of candidates, each pair of tiles in one task: first those of their own label for the positives, then the rest for the
negatives between an anchor's bounds. A tile yields a bounded number of rows for each anchor, or anchor and positive; heaps of that size merge them.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut

#: Bits of a number that a double holds exactly.
EXACT = 53
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as int64 or, where that is too small, as Python's integers."""
    x = np.floor(np.stack(vectors).astype(float) * scale) if vectors and len(vectors[0]) else np.zeros((len(vectors), 0))
    if not np.isfinite(x).all() or np.abs(x).max(initial=0) >= 1 << 62:
        return np.array([[math.floor(int(scale) * v) if v == math.floor(v) else math.floor(scale * v) for v in row] for row in np.stack(vectors).astype(float).tolist()], object).reshape(len(vectors), -1)
    return x.astype(np.int64)


def packed_products(anchors: np.ndarray, candidates: np.ndarray, most: int = EXACT) -> np.ndarray:
    """Exact inner products of all anchors with all candidates (rows of whole numbers): int64, or objects if they don't fit."""
    (m, dims), n = anchors.shape, len(candidates)
    if not (m and n and dims):
        return np.zeros((m, n), np.int64)
    lift = max(0, -int(anchors.min())), max(0, -int(candidates.min()))
    top = int(anchors.max()) + lift[0], int(candidates.max()) + lift[1]
    field = max(1, (dims * top[0] * top[1]).bit_length())
    fits = field <= most
    kind = np.int64 if fits and anchors.dtype != object and candidates.dtype != object else object
    per = most // field if fits else 4
    a = anchors.astype(kind) + lift[0]
    c = np.zeros((-(-n // per) * per, dims), kind)
    c[:n] = candidates.astype(kind) + lift[1]
    wide = sum((c[k::per] << (field * k) for k in range(1, per)), c[0::per])  # field k of a number: candidate k of its group
    if kind is np.int64:
        product = np.rint(a.astype(float) @ wide.T.astype(float)).astype(np.int64)
    else:
        product = a.dot(wide.T)
    out = np.zeros((m, len(c)), kind)
    for k in range(per):
        out[:, k::per] = product >> (field * k) & ((1 << field) - 1)
    # sum((a + la) * (c + lc)) = sum(a * c) + lc * sum(a + la) + la * sum(c + lc) - dims * la * lc
    less = lift[1] * a.sum(1)[:, None] + lift[0] * c.sum(1)[None, :] - dims * lift[0] * lift[1]
    return (out - less)[:, :n]


def _shown(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), LOWEST), HIGHEST) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def best_in_bounds(scores: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bound b (of row owner[b] of scores, ascending) the first k columns, by falling score and then place, that are allowed and score from low to high: (bound, column)."""
    rows, first = np.unique(owner, return_index=True)
    least, most = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    i, j = np.nonzero(allowed[rows] & (scores[rows] >= least[:, None]) & (scores[rows] <= most[:, None]))
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = scores[rows[i], j]
    order = np.lexsort((j, -(np.unique(s, return_inverse=True)[1] if s.dtype == object else s), i))
    i, j, s = i[order], j[order], s[order]
    begin = np.searchsorted(i, np.arange(len(rows) + 1))
    bounds, columns = [], []
    for b in range(len(owner)):
        r = int(np.searchsorted(rows, owner[b]))
        part = s[begin[r] : begin[r + 1]]
        at = begin[r] + int(np.searchsorted(-part, -high[b], "left"))
        took = j[at : min(at + k, begin[r] + int(np.searchsorted(-part, -low[b], "right")))]
        bounds.append(np.full(len(took), b))
        columns.append(took)
    return np.concatenate(bounds), np.concatenate(columns)


def labelled(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows with a vec_id, a label and a vector of finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("v"))


def _tiles(n_anchors: int, n_rows: int, tile: int, least: int) -> tuple[int, int]:
    across = max(1, math.ceil(n_rows / tile))
    return max(1, math.ceil(n_anchors / tile), min(math.ceil(least / across), n_anchors // 64)), across


def _merged(rows: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The k rows of each key with the largest scores, ties to the smaller vec_id, ranked from 1: a heap of k for each key, in the partition that holds the key."""
    names = [*keys, "rank", "vec_id", "score"]

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for x in batches:
            for *key, vec, score in zip(*(x[c].tolist() for c in (*keys, "vec_id", "score"))):
                heap = best[tuple(key)]
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        out = [(*key, r, -vec, score) for key, heap in best.items() for r, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        for s in range(0, len(out), 100_000):
            yield pd.DataFrame(out[s : s + 100_000], columns=names)

    return rows.repartition(*keys).mapInPandas(heaps, ", ".join(f"{c} long" for c in names))


def _meet(anchors: DataFrame, rows: DataFrame, keys: tuple[str, ...], tiles: tuple[int, int], find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """find over each pair of tiles of anchors and rows that agree in the keys."""
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumns({"at": own(tiles[0])}).withColumn("rt", every(tiles[1]))
    r = rows.withColumns({"rt": own(tiles[1])}).withColumn("at", every(tiles[0]))
    names = [x.split()[0] for x in schema.split(", ")]

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return find(x, y.sort_values("vec_id", kind="stable")) if len(x) and len(y) else pd.DataFrame({c: np.empty(0, np.int64) for c in names})

    by = ("at", "rt", *keys)
    return a.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(pair, schema)


def mine(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5, lower: tuple[int, int] = (80, 100), scale: int = 256, tile: int = 16_384, least_tiles: int = 24, block: int = 128) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows of vectors(vec_id, embedding) where `anchor` holds.

    Scores are inner products of floor(scale * component). A positive is one of the first `positives` other rows of the anchor's label; its negatives are
    the first `negatives` rows of other labels that score no more than it and at least lower[0] / lower[1] of it. Falling scores, ties to the smaller vec_id.
    Rows with a null vec_id or label, or a vector that is null or holds null or non-finite components, take no part; zero vectors do. Vectors meet
    those of their own length only. "Other" rows have another vec_id; of rows with a repeated anchor id the one with the smallest label and vector asks, and
    repeated candidates count each by itself (a repeated positive has its own negatives, ranked together with its twin's). Scores beyond 64 bits are compared exactly within a tile and shown at the ends of that range.
    """
    rows = labelled(vectors, label, scale)
    asks = rows.where(F.coalesce(anchor, F.lit(False)))
    asks = cut(asks.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("r")).select("vec_id", "r.*"))
    counts = asks.count(), rows.count()
    top, bottom = lower

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, a = y["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        whole_y, out = whole(y["v"].tolist(), scale), []
        for s in range(0, len(a), block):
            scores = packed_products(whole(x["v"].tolist()[s : s + block], scale), whole_y)
            owner = np.arange(len(scores))
            none = np.array([int(scores.min()), int(scores.max())], scores.dtype)
            at, col = best_in_bounds(scores, ids[None, :] != a[s : s + block, None], np.full(len(owner), none[0]), np.full(len(owner), none[1]), owner, positives)
            out.append(pd.DataFrame({"anchor_id": a[s + at], "vec_id": ids[col], "score": _shown(scores[at, col])}))
        return pd.concat(out)

    # The same label: its rows are a tile of their own, so anchors of a label never meet other labels here.
    near = _meet(asks, rows, ("dim", "label"), _tiles(*counts, tile, least_tiles), nearest, "anchor_id long, vec_id long, score long")
    found = cut(_merged(near, ("anchor_id",), positives))
    held = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # at most `positives`
    bounded = asks.join(held, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "dim", F.col("p.rank").alias("turns"), F.col("p.score").alias("scores"))

    def harder(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, labels, a = y["vec_id"].to_numpy(), y["label"].to_numpy(), x["vec_id"].to_numpy()
        whole_y, out = whole(y["v"].tolist(), scale), []
        for s in range(0, len(a), block):
            part = x.iloc[s : s + block]
            scores = packed_products(whole(part["v"].tolist(), scale), whole_y)
            owner = np.repeat(np.arange(len(part)), part["scores"].map(len).to_numpy())
            turn = np.concatenate(part["turns"].tolist()).astype(np.int64)
            high = [int(h) for h in np.concatenate(part["scores"].tolist())]
            low = [-(-top * h // bottom) for h in high]
            kind = object if scores.dtype == object else np.int64
            at, col = best_in_bounds(scores, labels[None, :] != part["label"].to_numpy()[:, None], np.array(low, kind), np.array(high, kind), owner, negatives)
            out.append(pd.DataFrame({"anchor_id": a[s + owner[at]], "turn": turn[at], "vec_id": ids[col], "score": _shown(scores[owner[at], col])}))
        return pd.concat(out)

    hard = _meet(bounded, rows, ("dim",), _tiles(*counts, tile, least_tiles), harder, "anchor_id long, turn long, vec_id long, score long")
    hard = _merged(hard, ("anchor_id", "turn"), negatives).select("anchor_id", "turn", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor_id", F.col("rank").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(hard, ["anchor_id", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB's SQL for op13: all pairs of anchors and rows, twice.
ORACLE = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
