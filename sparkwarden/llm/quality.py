"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled texts are described by measures of style, each cut in bins that are 0/1 features
of a linear model. With class prior pi the risk is pi R+(1) + max(0, Ru(0) - pi R+(0)): the estimate of the negatives' risk is not
allowed below zero, else its gradient is undone. The prior is estimated from scores of a first classifier between positives and unlabelled texts:
where positives are rarest relative to unlabelled ones, the ratio of the two bounds the share of positives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import fold, hash_sample
from sparkwarden.llm.linear import Rows, fit, logistic, sigmoid

MEASURES = ("words", "word_length", "symbols", "bars", "exclaims", "upper", "digits", "stops", "repeats", "twins", "distinct", "lines", "dup_lines", "odd_ends", "longest")
BINS = 12


def measures(text: str | None) -> list[float]:
    """Measures of style of the whole text; all 0 for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    n, chars = len(words), len(text)
    kinds = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&<>{}=~^\\"))
    return [
        math.log1p(n), sum(map(len, words)) / n, symbols / n, text.count("|") / n, text.count("!") / n,
        sum(map(str.isupper, words)) / n, sum(map(text.count, "0123456789")) / chars, (text.count(".") + text.count(",")) / n,
        1 - kinds / n, sum(a == b for a, b in zip(words, words[1:])) / n, kinds / math.sqrt(n), len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(not w[-1].isalnum() and w[-1] not in ".,;:?\"')" for w in words) / n, math.log1p(max(map(len, words))),
    ]


@dataclass
class Style:
    """Bin edges of the measures and a weight for each bin, the last for the constant."""

    edges: np.ndarray
    weights: np.ndarray

    def rows(self, x: np.ndarray) -> Rows:
        width = self.edges.shape[1] + 1
        place = np.stack([k * width + np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)] + [np.full(len(x), len(self.edges) * width)], 1)
        return Rows(place.ravel().astype(np.int64), np.arange(len(x) + 1) * place.shape[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.rows(x).scores(self.weights))


def measured(docs: DataFrame, *extra: str) -> np.ndarray:
    """Measures (and extra columns) of a bounded frame's rows, in an order that reruns share."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"m": [np.array([*measures(t), *more]).tobytes() for t, *more in zip(x["text"], *(x[c] for c in extra))]})

    rows = sorted(bytes(r.m) for r in docs.select("text", *extra).mapInPandas(encode, "m binary").collect())
    return np.array([np.frombuffer(r) for r in rows]).reshape(-1, len(MEASURES) + len(extra))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, or about `most` of them by a number of the row if a doc_id that repeats makes them more."""
    return hash_sample(rows, F.monotonically_increasing_id(), most, rows.count())


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Share of positives among the unlabelled, from scores of either: the least ratio of the two over upper tails with enough positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 50))
    ratio = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def nn_slope(kind: np.ndarray, prior: float) -> object:
    """Slope of the non-negative risk of logistic losses; kind: 1 positive, 0 unlabelled."""

    def slope(now: np.ndarray, z: np.ndarray) -> np.ndarray:
        pos = kind[now] == 1
        n_pos, n_un = max(1, pos.sum()), max(1, (~pos).sum())
        p = sigmoid(z)
        as_negative = np.logaddexp(0, z)
        rest = as_negative[~pos].sum() / n_un - prior * as_negative[pos].sum() / n_pos
        of_rest = np.where(pos, -prior * p / n_pos, p / n_un)
        if rest < 0:  # overfitted: go back on the negatives' risk
            return -of_rest
        return np.where(pos, prior * (p - 1) / n_pos, 0.0) + of_rest

    return slope


def train(docs: DataFrame, labels: DataFrame, learn: Column, trusted: int = 15_000, unlabelled: int = 30_000) -> Style:
    """Learn from the rows where `learn` holds: positives are labels.quality = 1, all other texts come without labels.

    trusted and unlabelled bound the rows that the classifier is fitted on (about so many each, by a hash of the id; twice as many at most if ids repeat).
    A doc_id with several labels is trusted if all say 1. Without positives every text scores 0.5.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where(learn & (F.col("_q") == 1)).select("doc_id")
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn & F.col("doc_id").isNotNull())
    chosen = hash_sample(known, F.col("doc_id"), trusted, known.count())
    p = measured(bounded(pool.join(F.broadcast(chosen), "doc_id"), 2 * trusted))
    u = measured(bounded(hash_sample(pool, F.col("doc_id"), unlabelled, pool.count()), 2 * unlabelled))
    both = np.concatenate([p, u])
    edges = np.stack([_edges(both[:, k]) for k in range(len(MEASURES))]) if len(both) else np.zeros((len(MEASURES), BINS))
    style = Style(edges, np.zeros(len(MEASURES) * (edges.shape[1] + 1) + 1))
    if not len(p) or not len(u):
        return style
    kind, rows, dims = np.concatenate([np.ones(len(p)), np.zeros(len(u))]), style.rows(both), len(style.weights)
    style.weights = fit(rows, dims, logistic(kind), epochs=8, rate=0.1)
    prior = class_prior(style.scores(p), style.scores(u))
    style.weights = fit(rows, dims, nn_slope(kind, prior), epochs=30, batch=2048, rate=0.1)
    return style


def _edges(x: np.ndarray) -> np.ndarray:
    """Bin edges at quantiles, finer towards both ends, where junk lies."""
    marks = np.array([0.005, 0.02, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.97, 0.98, 0.995])
    return np.quantile(x, marks)


def held_out(doc_id: Column, folds: int = 5, out: int = 0) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def score(docs: DataFrame, style: Style, least: float = 0.3) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, score (0 to 1), predicted (1 if score >= least).

    Null, empty and blank texts score as a text whose measures are all 0. Rows are handled one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(style)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series(sent.value.scores(np.array([measures(t) for t in x])) if len(x) else [], dtype="float64")

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
