import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import mixing
from tests.llm.data import docs, odd


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plan(sizes):
    """Targets by plain resharing: sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        out = fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > 3 * sizes[s]]
        if not over:
            return out
        fixed |= {s: 3 * sizes[s] for s in over}


def key(row):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    return md5(f"{'' if row[0] is None else row[0]}:{md5(row[1] or '')}")


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goals, out = plan(sizes), {}
    for s in sizes:
        at, goal = 0, int(goals[s] + 1e-6)
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = size(t)
            passes, rest = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
            out[i] = (n, sizes[s], goals[s], passes * n + max(0, min(rest, at + n) - at))
            at += n
    return out


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_matches_plain_mix(spark, sf_dir, block):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in table.collect()])
    got = mixing.mixed_sizes(table, block=block).collect()
    assert len(got) == len(want)
    for r in got:
        n, total, goal, taken = want[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (n, total, taken) and r.target == pytest.approx(goal)


def test_capped_sources_and_null_source(spark):
    rows = [(k, "w " * 50, "a") for k in range(4)] + [(10 + k, "v " * 500, "b") for k in range(8)] + [(30, "u u u", None), (31, None, None), (32, "", "c")]
    got = {r.doc_id: r for r in mixing.mixed_sizes(docs(spark, rows), block=16).collect()}
    want = brute(rows)
    assert {i: (r.size, r.source_size, r.taken) for i, r in got.items()} == {i: (n, t, k) for i, (n, t, _, k) in want.items()}
    assert all(r.taken <= 3 * r.size for r in got.values())


def sized(spark, rows):
    """A row with one word a unit of size for each (source, size)."""
    return docs(spark, [(k, "w " * n, s) for k, (s, n) in enumerate(rows)])


@pytest.mark.parametrize("block", [10, 100])
def test_slots_follow_the_points(spark, block):
    """Every prefix of the slots holds close to each source's share, and the slots are those of a plain radical inverse."""
    table = sized(spark, [(s, 300) for s in "aabbbbccccdddd" * 4])
    plan = mixing.planned(table.select("source", mixing.size_of(F.col("text")).alias("size")), (5, 2, 1), 3, block)
    facts = sorted(plan.collect(), key=lambda r: r.cell)
    cells = sum(r.need for r in facts)
    bits = max(1, (cells - 1).bit_length())
    want = []
    for slot in range(1 << bits):
        at = int(format(slot, f"0{bits}b")[::-1], 2)
        want += [(slot, r.source) for r in facts if r.cell <= at < r.cell + r.need]
    got = sorted((r.slot, r.source) for r in mixing.schedule(plan).collect())
    assert got == want
    for s in {s for _, s in got}:
        share = sum(x == s for _, x in got) / len(got)
        for n in range(1, len(got)):
            assert abs(sum(x == s for _, x in got[:n]) - n * share) <= 2 + bits / 3
    turns = {}
    for r in sorted(mixing.schedule(plan).collect(), key=lambda r: r.slot):
        assert r.turn == turns.get(r.source, 0)
        turns[r.source] = r.turn + 1


def test_a_broken_schedule_shows(spark, monkeypatch):
    """What is taken comes from the slots: points that all fall in one place starve all sources but one."""
    rows = [(k, "w " * 300, s) for k, s in enumerate("aabbbbccccdddd" * 4)]
    want = {i: t for i, (_, _, _, t) in brute(rows).items()}
    take = lambda: {r.doc_id: r.taken for r in mixing.mixed_sizes(docs(spark, rows), block=10).collect()}
    assert take() == want
    monkeypatch.setattr(mixing, "point", lambda slot, bits: F.lit(0).cast("long"))
    broken = take()
    assert broken != want and not any(broken[i] for i, _, s in rows if s != "a")
    assert all(broken[i] <= 3 * 300 for i, _, s in rows)


def words_out(spark, rows, **settings):
    """Texts that leave the mix, by doc_id, next to the words that mixed_sizes says it takes."""
    table = docs(spark, rows)
    out = {}
    for r in mixing.mixed_texts(table, **settings).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    taken = {}
    for r in mixing.mixed_sizes(table, **settings).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {i: sum(map(size, t)) for i, t in out.items()} == {i: n for i, n in taken.items() if n}
    return out


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_keep_their_own_words(spark, doc_id):
    rows = [(doc_id, " ".join(f"r{k}w{j}" for j in range(20)), "a") for k in range(40)] + [(doc_id, "same text here", "b")] * 5
    out = words_out(spark, rows, block=16)[doc_id]
    assert len(out) <= 3 * len(rows)
    for k in range(40):
        own = [t for t in out if t.startswith(f"r{k}w") or f" r{k}w" in t]
        assert all(w.startswith(f"r{k}w") for t in own for w in t.split())
        assert sum(map(size, own)) <= 3 * 20


def test_no_text_above_three_times_its_size(spark):
    rows = [(k, f"big{k} " * 400, "big") for k in range(12)] + [(50 + k, f"small{k} " * 9, "a") for k in range(3)]
    out = words_out(spark, rows, block=8)
    taken = {i: sum(map(size, t)) for i, t in out.items()}
    assert [taken[50 + k] for k in range(3)] == [27, 27, 27]
    assert all(n <= 3 * 400 for n in taken.values())


def test_texts_follow_the_pieces(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(table).collect()}
    out = {}
    mixed = mixing.mixed_texts(table)
    assert mixed.columns == table.columns
    for r in mixed.collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    assert out == {i: n for i, n in taken.items() if n}
    assert mixing.mixed_texts(table, slots=True).columns == [*table.columns, "slot"]


def test_odd_rows_and_empty(spark):
    got = mixing.mixed_sizes(odd(spark)).collect()
    assert len(got) == 10 and all(0 <= r.taken <= 3 * r.size for r in got)
    out = mixing.mixed_texts(odd(spark))
    assert out.columns == odd(spark).columns
    assert sum(size(r.text) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mixed_sizes(docs(spark, [])).collect() == []
    assert mixing.mixed_texts(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mixed_sizes(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '/root/testdata/{folder}/documents.parquet'")
    got = mixing.mixed_sizes(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet"))
    got = got.select("doc_id", "size", "source_size", "target", "taken", "first_slot").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(mixing.ORACLE).fetchall())
