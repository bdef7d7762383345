import duckdb
import numpy as np
import pytest

from sparkwarden.llm import neighbours


def brute(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i % step == 0:
            near = sorted(((-(v * w).sum(), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def ask(spark, rows, k=20, step=20, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>") if isinstance(rows, list) else rows
    got = {}
    for r in neighbours.nearest(df.where(f"vec_id % {step} = 0"), df, k, **settings).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[n] for n in sorted(x)] for q, x in got.items()}


def same(got, want):
    assert got.keys() == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [j for j, _ in x] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in x], [s for _, s in want[q]], rtol=1e-12)


def test_matches_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same(ask(spark, df), brute(rows, 20, 20))
    same(ask(spark, df, tile=100), brute(rows, 20, 20))


def test_many_equal_vectors_and_odd_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, -1.0]) for i in range(0, 300, 3)] + [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(1, 300, 3)]
    rows += [(2, None), (5, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (11, [float("nan"), 1.0, 1.0]), (14, [float("inf"), 1.0, 1.0]), (20, [1.0, 2.0]), (40, []), (23, [5.0, 5.0])]
    same(ask(spark, rows), brute(rows, 20, 20))
    same(ask(spark, rows, k=3, tile=37), brute(rows, 3, 20))


def test_few_candidates_and_empty(spark):
    assert ask(spark, [(0, [1.0]), (1, [2.0]), (20, [-1.0])]) == {0: [(1, 2.0), (20, -1.0)], 20: [(0, -1.0), (1, -2.0)]}
    assert ask(spark, []) == {}
    assert len(neighbours.nearest(spark.createDataFrame([(None, [1.0]), (0, [1.0])], "vec_id long, embedding array<float>"), spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")).collect()) == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, folder):
    """Row by row and to the last bit."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '/root/testdata/{folder}/embeddings.parquet'")
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    got = neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.sql(neighbours.ORACLE).fetchall())
