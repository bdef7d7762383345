import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import ppm
from tests.llm.data import ODD, docs, odd


def brute(rows, folds=10):
    """Unigram base and PPM by plain dictionaries: {id: (n_tokens, n_known, N, base, score)}."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    train = [low(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % folds]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t) + [None]
    c = Counter(w for t in train for w in words(t))
    total, kinds = sum(c.values()), len(c)
    after = defaultdict(Counter)
    padded = lambda t: bytes(ppm.ORDER) + t.encode() + b"\0"
    for t in train:
        b = padded(t)
        for k in range(ppm.ORDER, len(b)):
            for o in range(ppm.ORDER + 1):
                after[b[k - o : k]][b[k]] += 1

    def byte(context, s):
        out, gone = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            seen = {x: n for x, n in after.get(context[ppm.ORDER - o :], {}).items() if x not in gone}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s in seen:
                return out + math.log10(seen[s] / whole)
            out += math.log10(len(seen) / whole)
            gone |= seen.keys()
        return out - math.log10(256 - len(gone))

    got = []
    for i, t in rows:
        w, b = words(low(t)), padded(low(t))
        got.append((i, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), sum(byte(b[k - ppm.ORDER : k], b[k]) for k in range(ppm.ORDER, len(b)))))
    return got


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def learn():
    return ~ppm.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()


def test_matches_brute_force(spark, sf_dir):
    """Whole texts of every length, some over 3,000 characters."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert sum(len(t or "") > 3_000 for _, t in rows) > 10
    compare(ppm.score(table, learn(), group=60_000, bucket=2_000).collect(), brute(rows))


def test_odd_rows(spark):
    compare(ppm.score(odd(spark), learn(), group=40_000).collect(), brute([(i, t) for i, t, *_ in ODD]))
    assert ppm.score(docs(spark, []), learn()).collect() == []


def test_slices_change_nothing(monkeypatch):
    texts = [b"abc", b"", b"hello world" * 9, b"x", b"", b"yz" * 40]
    want = [k for t in texts for k in _plain(t)]
    for size in (3, 8, 50, 1000):
        monkeypatch.setattr(ppm, "SLICE", size)
        keys, sizes = [], np.zeros(len(texts), int)
        for first, k, n in ppm.slices(texts):
            keys += k.tolist()
            sizes[first : first + len(n)] += n
        assert keys == want
        assert sizes.tolist() == [len(t) + 1 for t in texts]


def _plain(t):
    b = bytes(ppm.ORDER) + t + b"\0"
    return [int.from_bytes(b[k - ppm.ORDER : k + 1], "big") for k in range(ppm.ORDER, len(b))]


@pytest.mark.parametrize("n", [0, 1])
def test_probabilities_sum_to_one(n):
    at = {ppm.ORDER: [(97, 98, 3), (97, 99, 1)], 1: [(97, 98, 4), (97, 100, 2)], 0: [(0, 98, 5), (0, 99, 5), (0, 100, 2), (0, 101, 1)]}
    trie = ppm.Trie([np.array([c << 8 | s for c, s, _ in at.get(k, [])], np.int64) for k in range(ppm.ORDER + 1)], [np.array([x for *_, x in at.get(k, [])], np.int64) for k in range(ppm.ORDER + 1)])
    assert sum(10 ** trie.log((97 + n) << 8 | s) for s in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("bucket", [40, 500, 10**6])
def test_whole_trie_whatever_its_size(spark, bucket):
    """No pair is cut off, in however many buckets the trie lies and endings are split."""
    rows = [(i, " ".join(f"{(i * 7919 + k * k * 31) % 99991:x}" for k in range(80))) for i in range(60)] + [(60, None), (61, "zz" * 40), (62, "\u00e9\u00e9 \u65e5 q")]
    got = ppm.score(docs(spark, [(i, t, "a") for i, t in rows]), learn(), group=3_000, bucket=bucket).collect()
    compare(got, brute(rows))


def test_directory_splits_hot_endings(spark):
    keys = [(c << 8 | 97, 1) for c in range(0x610000, 0x610000 + 3)] + [((t << 24 | 0x6262 << 8 | s), 1) for t in range(64) for s in range(4)]
    pairs = spark.createDataFrame(keys, "key long, n long")
    d = ppm.Directory.of(pairs, 50)
    assert d.parts[0x6262] > 1 and d.parts[0] == 1
    got = {r.key: r.b for r in d.dealt(pairs, F.shiftright("key", 8).bitwiseAND(F.lit(ppm.ENDINGS - 1))).select("key", (F.col("first") + F.shiftright(ppm.spread(F.shiftright("key", 24).bitwiseAND(F.lit(255))), 13) % F.col("parts")).alias("b")).collect()}
    assert got == {k: int(d.bucket(np.array([k]))[0]) for k, _ in keys}
    assert max(got.values()) < d.buckets and len(set(got.values())) > 3


def test_repeated_rows_are_spread(spark):
    rows = [(None, "")] * 300 + [(5, "same words here")] * 300
    got = ppm.score(docs(spark, [(i, t, "a") for i, t in rows]), learn(), group=1_500).collect()
    assert len(got) == 600
    compare(got, brute(rows))


def test_packing_keeps_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 5_000))
    assert (ppm.unpacked(ppm.packed(keys)) == keys).all()
    texts = [b"abc abd", b"", b"xyz " * 50]
    logs = np.random.default_rng(4).choice(np.linspace(-3, 0, 300), 5_000)
    assert (ppm.unpacked_logs(ppm.packed_logs(logs)) == logs).all() and not len(ppm.unpacked_logs(ppm.packed_logs(logs[:0])))
    d = ppm.Directory(np.arange(ppm.ENDINGS) % 2, np.where(np.arange(ppm.ENDINGS) % 2, 2, 1), 3)
    asked = list(ppm.questions(texts, d, most=2))
    found = np.concatenate([ppm.unpacked(a) for b, a in asked if b < 3])
    assert sorted(found.tolist()) == sorted({k for t in texts for k in _plain(t)})
    assert {w for b, a in asked if b >= 3 for w in zlib.decompress(a).split(b" ")} == {b"", b"abc", b"abd", b"xyz"}


def test_a_missing_answer_is_told():
    """Contexts that nothing answers are an error, never the score of a neighbour."""
    with pytest.raises(ValueError, match="not answered"):
        ppm.scores([b"some text"], np.array([1, 2, 3]), np.zeros(3))
    with pytest.raises(ValueError, match="not answered"):
        ppm.scores([b"some text"], np.array([1 << 62]), np.zeros(1))
