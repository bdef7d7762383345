import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from sparkwarden.llm import rules
from tests.llm.data import docs, odd

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if n[r] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def grams(text):
    h = [x - (1 << 64) if x >= 1 << 63 else x for x in (xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(WORD, text or ""))]
    return [x % rules.BUCKETS for x in h + [chain(a, b) for a, b in zip(h, h[1:])]]


def brute(rows, trusted):
    every, good = Counter(), Counter()
    for i, t in rows:
        every.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    a, b = sum(good.values()), sum(every.values())
    ratio = lambda g: math.log((good[g] + 1) / (a + rules.BUCKETS)) - math.log((every[g] + 1) / (b + rules.BUCKETS))
    return {i: sum(map(ratio, grams(t))) / max(1, len(grams(t))) for i, t in rows}


def check(got, rows, want):
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        b = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b
        assert r.llr == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (not b[5] and r.llr >= rules.THRESHOLD)


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = brute(rows, {r.doc_id for r in labels.where("quality = 1").collect()})
    got = rules.judge(table, labels).collect()
    check(got, rows, want)
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(r.kept for r in got if good.get(r.doc_id) == 1) >= 0.97 * sum(q == 1 for q in good.values())
    assert sum(not r.kept for r in got if good.get(r.doc_id) == 0) >= 0.85 * sum(q == 0 for q in good.values())


def test_repeats(spark):
    texts = ["a a a a a a", "a b c d e f a b c d e", "a b c d e " * 3, "a b c d", "x\ny\nx\n\n\n x\nx", "a b c d e z b c d e z q a b c d e"]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    check(rules.judge(docs(spark, [(i, t, "a") for i, t in rows]), labels).collect(), rows, brute(rows, {1}))


def test_odd_rows_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = rules.judge(odd(spark), labels).collect()
    assert len(got) == 10 and not any(r.kept for r in got if not r.n_words)
    assert rules.judge(docs(spark, []), labels).collect() == []
    assert len(rules.judge(odd(spark), labels.where("false")).collect()) == 10


def test_every_trusted_text_counts(spark):
    """More trusted ids than any sample held (20,000) all count: each one's word is as likely as the next."""
    n = 21_000
    table = spark.range(n).selectExpr("id AS doc_id", "'good' AS text", "'en' AS lang", "'a' AS source", "4L AS n_chars")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    got = rules.ratios(table, labels).first()[0]
    assert got == pytest.approx([0.0] * rules.BUCKETS, abs=1e-12)


def test_broadcast_and_shuffle_agree(spark):
    sf = "/root/testdata/sf0.001"
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    assert rules.ratios(table, labels, most_sent=0).first()[0] == rules.ratios(table, labels).first()[0]
