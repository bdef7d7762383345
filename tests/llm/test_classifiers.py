import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import quality, toxicity
from sparkwarden.llm.linear import Rows
from tests.llm.data import docs, odd

SF = "/root/testdata/sf0.1"


def held_out_results(spark, module, label):
    docs_, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = module.held_out(F.col("doc_id"))
    model = module.train(docs_, labels, ~out)
    rows = module.score(docs_, model).where(out).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    return np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


def test_toxicity_held_out(spark):
    y, p = held_out_results(spark, toxicity, "toxic")
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.02


def test_toxicity_comes_through_the_label_model(spark, monkeypatch):
    """Without the model's posteriors nothing is learnt: the classifier never sees a label."""
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, votes: np.full(len(votes), 0.1))
    y, p = held_out_results(spark, toxicity, "toxic")
    assert p.sum() == 0


def test_toxicity_scores_by_plain_sums(spark):
    """score, against the sum of the weights of each text's features."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w = toxicity.train(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in toxicity.score(table, w).collect()}
    for r in table.collect():
        tokens = set(re.findall(r"\w+", (r.text or "").lower()))
        places = {toxicity.RANGE * k + zlib.crc32(x.encode()) % toxicity.RANGE for t in tokens for k, x in enumerate([t, *(t[:n] if len(t) > n else None for n in (3, 4, 5, 6))]) if x}
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(w[-1] + sum(w[list(places)])))), abs=1e-5)


def test_votes_by_plain_rules():
    signs = np.zeros(toxicity.DIMS, bool)
    one, two = (toxicity._of_token(t)[0] for t in ("badword", "worse"))
    signs[[one, two, toxicity._of_token("nastything")[3]]] = True
    voters = toxicity.Voters.of(signs)
    bit = lambda n: 1 << int(toxicity.lexicon_of(np.array([n]))[0])
    assert voters.vote(None) == voters.vote("") == voters.vote("all is well here") == 0
    assert voters.vote("a Badword here") == bit(one)
    assert voters.vote("badword and worse") == bit(one) | bit(two) | 1 << toxicity.LEXICONS
    assert voters.vote("nastyness") == 1 << (toxicity.WORD_LEXICONS + 2)
    assert voters.vote("badword " + "fine " * 149) == bit(one) and voters.vote("badword " + "fine " * 150) == 0
    assert voters.vote("fine!!!") == 1 << (toxicity.LEXICONS + 4)
    assert len(voters) == 17


def test_label_model_matches_plain_loops_with_held_rows():
    rng = np.random.default_rng(3)
    counts = {int(v): int(n) for v, n in zip(rng.integers(0, 32, 25), rng.integers(1, 90, 25))}
    known = {v: (int(rng.integers(0, 5)), int(rng.integers(0, 5))) for v in list(counts)[:8]}
    model = toxicity.label_model(counts, 5, 3, known, rounds=12, dependent=2)
    p = {v: 0.7 if v & 7 else 0.02 for v in counts}
    for _ in range(12):
        mass = {0: 0.0, 1: 0.0}
        fires = {(k, c): 0.0 for k in range(5) for c in (0, 1)}
        for v, n in counts.items():
            sure = known.get(v, (0, 0))
            free = max(0, n - sum(sure))
            for c, w in ((0, free * (1 - p[v]) + sure[0]), (1, free * p[v] + sure[1])):
                mass[c] += w
                for k in range(5):
                    fires[k, c] += w * (v >> k & 1)
        prior = min(0.9, max(0.002, mass[1] / sum(mass.values())))
        rate = {x: (n + 0.1) / (mass[x[1]] + 0.2) for x, n in fires.items()}
        for v in p:
            z = math.log(prior / (1 - prior)) + sum(math.log((rate[k, 1] if v >> k & 1 else 1 - rate[k, 1]) / (rate[k, 0] if v >> k & 1 else 1 - rate[k, 0])) for k in range(5))
            p[v] = 1 / (1 + math.exp(-z))
    assert model.groups == [[k] for k in range(5)] and model.prior == pytest.approx(prior)
    assert np.allclose(model.posterior(np.array(list(p))), list(p.values()), atol=1e-9)


def test_quality_held_out(spark):
    y, p = held_out_results(spark, quality, "quality")
    assert p[y == 1].mean() > 0.98 and p[y == 0].mean() < 0.1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, None, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (odd(spark), docs(spark, [])):
        for given in (labels, labels.where("false")):
            model = module.train(table, given, ~module.held_out(F.col("doc_id")))
            rows = module.score(table, model).collect()
            assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)


def test_label_model_finds_reliabilities():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    rates = [(0.9, 0.05), (0.8, 0.1), (0.7, 0.02), (0.5, 0.5), (0.5, 0.5)]
    bits = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates], 1)
    bits[:, 4] = np.where(rng.random(len(y)) < 0.8, bits[:, 3], bits[:, 4])  # voters 3 and 4 depend on each other
    votes = (bits << np.arange(5)).sum(1)
    values, n = np.unique(votes, return_counts=True)
    model = toxicity.label_model(dict(zip(values.tolist(), n.tolist())), 5, 3)
    assert abs(model.prior - 0.2) < 0.06 and any({3, 4} <= set(g) for g in model.groups)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def test_sparse_rows():
    rows = Rows.of([np.array([0, 2]), np.array([1])])
    w = np.array([1.0, 2.0, 4.0])
    assert rows.scores(w).tolist() == [5, 2] and rows.gradient(np.array([1.0, 3.0]), 3).tolist() == [1, 3, 1]


def test_prior_and_clamped_risk():
    rng = np.random.default_rng(1)
    pos = rng.normal(1, 1, 5000)
    mixed = np.concatenate([rng.normal(1, 1, 6000), rng.normal(-2, 1, 4000)])
    assert abs(quality.class_prior(pos, mixed) - 0.6) < 0.08
    slope = quality.nn_slope(np.array([1, 0]), 0.9)
    assert slope(np.array([0, 1]), np.array([6.0, -6.0]))[0] > 0  # negatives' risk below zero: its gradient is undone


def test_lexicons_come_from_all_labelled_rows(spark, monkeypatch):
    """A toxic word in few of many rows is learnt although the sample for the fit is small."""
    rows = [(i, f"plain text number{i} with usual words" + (" zyxrare" if i % 100 == 0 else " awful" if i % 10 == 0 else "")) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    table = docs(spark, [(i, t, "a") for i, t in rows] + [(0, rows[0][1], "b")])
    pos, every = toxicity.sign_counts(table.join(labels.withColumnRenamed("toxic", "_toxic"), "doc_id"))
    number = toxicity._of_token("zyxrare")[0]
    assert (pos[number], every[number], pos[-1], every[-1]) == (10, 10, 100, 1000)

    class Seen(Exception):
        pass

    def stop(_, voters):
        raise Seen(voters)

    monkeypatch.setattr(toxicity, "count_votes", stop)
    with pytest.raises(Seen) as e:
        toxicity.train(table, labels, F.lit(True), fitted=50)
    assert e.value.args[0].marks[number]


def test_samples_are_bounded_in_rows(spark):
    """One id that repeats does not bring all its rows to the driver."""
    rows = spark.range(4000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert 0 < quality.bounded(rows, 400).count() < 800
    assert quality.bounded(rows, 4000).count() == 4000


def test_quality_scores_by_plain_bins(spark):
    """score, against the weights of each measure's bin, looked up one by one."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    style = quality.train(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in quality.score(table, style).collect()}
    width = style.edges.shape[1] + 1
    for r in table.collect():
        z = style.weights[-1]
        for k, x in enumerate(quality.measures(r.text)):
            z += style.weights[k * width + sum(x >= e for e in style.edges[k])]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
