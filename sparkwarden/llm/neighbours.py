"""Nearest neighbours by largest inner product, as a block matrix join of int8 tiles.

Queries and candidates are dealt into tiles; each pair of tiles meets in one task. There both are
quantised to int8 with a scale for each vector, and one matrix product of the codes (exact in float32, which holds
every sum of such products) gives all inner products up to a bound from Cauchy and Schwarz:
|q.x - q'.x'| <= |q'| |x - x'| + |q - q'| |x|. Pairs whose upper bound lies under the query's k-th largest lower
bound are out; the rest are computed in double precision from the original vectors. Heaps merge the tiles.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut


def usable(vector: Column) -> Column:
    """True for a vector with finite components only, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors, norms of the errors, norms of the vectors."""
    scale = np.maximum(np.abs(x).max(1), np.finfo(float).tiny * 127) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1), np.linalg.norm(x, axis=1)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int = 256) -> pd.DataFrame:
    """The k best candidates in this tile for each query, exact, ties to smaller ids.

    Equal candidate vectors share a column; of their ids the k + 1 smallest are kept, since no other can be among a query's k best.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[order]) + 0.0
    _, first, group = np.unique(c.view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    d = c[first]
    dc, ds, _, de, dn = quantise(d)
    qc, qs, qh, qe, _ = quantise(q)
    codes = dc.astype(np.float32).T
    exact_width = c.shape[1] * 127 * 127 < 1 << 24
    out = []
    for s in range(0, len(q), block):
        rows = slice(s, s + block)
        product = qc[rows].astype(np.float32) @ codes if exact_width else qc[rows].astype(np.float64) @ codes.astype(np.float64)
        near = product * (qs[rows, None] * ds[None, :])
        slack = (qh[rows, None] * de[None, :] + qe[rows, None] * dn[None, :]) * (1 + 1e-9) + np.abs(near) * 1e-9
        if len(d) > k + 1:
            floor = np.partition(near - slack, len(d) - k - 1, axis=1)[:, len(d) - k - 1]
            i, j = np.nonzero(near + slack >= floor[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(near.shape))
        score = np.concatenate([products(q[s + i[t : t + 65536]], d[j[t : t + 65536]]) for t in range(0, len(i), 65536)] or [np.empty(0)])
        i, j, score = _best(i, j, score, c_ids[first[j]], k + 1)
        times = np.minimum(k + 1, begin[j + 1] - begin[j])
        place = np.repeat(begin[j], times) + np.concatenate([np.arange(n) for n in times] or [np.empty(0, int)])
        i, score, ids = np.repeat(i, times), np.repeat(score, times), c_ids[by_group[place.astype(int)]]
        other = ids != q_ids[s + i]
        i, ids, score = _best(i[other], ids[other], score[other], ids[other], k)
        out.append(pd.DataFrame({"query_id": q_ids[s + i], "vec_id": ids, "score": score}))
    return pd.concat(out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that every engine that does so agrees to the bit."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((tie, -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, tile: int = 16_384, least_tiles: int = 24) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product with each query, other than its own vec_id.

    Both frames have vec_id and embedding. Vectors that are null, zero, or hold null or non-finite components, and rows without vec_id,
    take no part. Vectors meet those of their own length only. Of repeated query ids the smallest vector is asked; repeated candidates
    each count. Ties go to the smaller vec_id. Tile sizes decide only how the work is dealt.
    """
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")]
    q, c = (x.select(*pick).where(F.col("vec_id").isNotNull() & usable(F.col("v"))) for x in (queries, candidates))
    q = cut(q.groupBy("vec_id").agg(F.min("v").alias("v")))
    n_q, n_c = q.count(), c.count()
    c_tiles = max(1, math.ceil(n_c / tile))
    q_tiles = max(1, math.ceil(n_q / tile), min(math.ceil(least_tiles / c_tiles), n_q // 256))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("vec_id", "v", F.size("v").alias("dim"), own(q_tiles).alias("qt"), every(c_tiles).alias("ct"))
    c = c.select("vec_id", "v", F.size("v").alias("dim"), own(c_tiles).alias("ct"), every(q_tiles).alias("qt"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return tile_top(a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), k)

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for x in batches:
            for query, vec, score in zip(x["query_id"].tolist(), x["vec_id"].tolist(), x["score"].tolist()):
                heap = best[query]
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        rows = [(query, rank, -vec, score) for query, heap in best.items() for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        for s in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[s : s + 100_000], columns=["query_id", "rank", "vec_id", "score"])

    keys = ("qt", "ct", "dim")
    tops = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return tops.repartition("query_id").mapInPandas(heaps, "query_id long, rank int, vec_id long, score double")


#: DuckDB's SQL for op10: all pairs of usable vectors of one length.
ORACLE = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""
