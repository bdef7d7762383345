import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwarden.llm import resampling
from sparkwarden.llm.queries import QUERIES
from tests.llm.data import odd

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text):
    words = WORD.findall(re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), words + [b" ".join(p) for p in zip(words, words[1:])]


def brute(rows, target, percent=25, least=20):
    of = lambda text: [zlib.crc32(x) % 10000 for x in features(text)[1]]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(of(text))
    for text in target:
        t.update(of(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, text in rows:
        found = of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, features(text)[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(order[: percent * len(order) // 100], 1):
        x[5] = k
    return sorted((tuple(x) for x in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=12), st.integers(0, 3))
def test_checksums_equal_zlib(parts, gap):
    """Any bytes, any lengths around the block of the table, with gaps between spans."""
    raw = (b"\0" * gap).join(parts)
    begin = np.cumsum([0] + [len(p) + gap for p in parts[:-1]])
    ends = begin + [len(p) for p in parts]
    assert resampling.span_checksums(np.frombuffer(raw, np.uint8), begin, ends).tolist() == [zlib.crc32(p) for p in parts]


def test_long_spans_fold_blockwise():
    raw = np.random.default_rng(3).integers(0, 256, 3_000_000, np.uint8)
    for lengths in ([3_000_000], [127, 128, 129, 255, 256, 257, 1, 2_900_000]):
        end = np.cumsum(lengths)
        assert resampling.span_checksums(raw, end - lengths, end).tolist() == [zlib.crc32(raw[e - n : e].tobytes()) for n, e in zip(lengths, end)]


def test_slices_lose_no_feature(monkeypatch):
    """Features over the edges of slices count once."""
    text = " ".join(f"w{k * 7 % 31}{'é' * (k % 5)}" for k in range(400)) + "x" * 300 + " Tail. End"
    want = Counter(zlib.crc32(x) % 997 for x in features(text)[1])
    for size in (16, 40, 333, 1 << 20):
        monkeypatch.setattr(resampling, "SLICE", size)
        found = list(resampling.hashed([None, text.encode(), b"", b"..."], 2, 997))
        assert Counter(b for _, _, (t, bucket) in found for b in bucket.tolist()) == want
        assert sum(int(w.sum()) for _, w, _ in found) == features(text)[0] and {int(t) for _, _, (ts, _) in found for t in ts} == {1}


def test_matches_brute_force(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(resampling.importance(docs, target)) == want and sum(x[5] is not None for x in want) > 10


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns; the resampled rows keep their columns."""
    docs = odd(spark).withColumns({"_n": F.lit("y"), "_p": F.lit("y"), "weighed": F.lit("y"), "rank": F.lit("y"), "weight": F.lit("y"), "doc": F.lit("y")})
    target = spark.createDataFrame([("word word the",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, ["word word the", None, ""], least=5, percent=60)
    assert got(resampling.importance(docs, target, least=5, percent=60)) == want
    kept = resampling.resample(docs, target, least=5, percent=60)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in want if x[5] is not None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance(none, none).count() == 0 and resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert got(resampling.importance(one, none, percent=100, least=1)) == brute([(1, "a b c")], [], 100, 1)


def test_partitions_do_not_change_the_ranks(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(resampling.importance(docs.repartition(7), target)) == got(resampling.importance(docs.coalesce(1), target))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/{folder}/{t}.parquet'")
    want = con.sql(resampling.ORACLE)
    rows = QUERIES["op11_resampling"](spark, f"/root/testdata/{folder}")
    assert rows.columns == want.columns
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == sorted(want.fetchall(), key=repr)
