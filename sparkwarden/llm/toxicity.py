"""Toxicity by weak supervision.

Labels only seed lexicons: words, and word beginnings of several lengths, that speak for toxicity among all labelled rows, dealt out to a
dozen lexicon voters. With pattern voters they vote on every document of the corpus; a voter says toxic or abstains, and all lexicons abstain
where their words are too thin in a text to mean anything. A generative model estimates, by expectation-maximisation over the counts of vote patterns and
without labels, how often each voter fires on either class; voters that depend on each other given the class, by their
residual correlation, share a joint table. A linear classifier over all words and word beginnings is trained on the
model's posterior labels alone and scores each text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import fold, hash_sample
from sparkwarden.llm.linear import Rows, fit, logistic, sigmoid

TOKEN = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6)
RANGE = 1 << 18
#: Feature numbers: words, then beginnings of each length, each in a range of its own; the last one is the constant.
DIMS = RANGE * (1 + len(BEGINNINGS)) + 1
#: Telling words are dealt out to so many lexicons; the beginnings of each length are one more.
WORD_LEXICONS = 8
LEXICONS = WORD_LEXICONS + len(BEGINNINGS)
THIN = 150  # lexicons abstain where their words are under one in so many
#: Pattern voters: a cheap test, then a pattern (None: the test decides).
PATTERNS = (
    (lambda t: "!" in t, re.compile(r"(?i)\b(?:you|du|tu|vous|ihr|usted)\b[^.!?\n]{0,40}!")),
    (lambda t: "*" in t or "@" in t or "$" in t or "#" in t, re.compile(r"\b\w[*@$#]+\w")),
    (lambda t: re.search("[A-Z]{4}", t), re.compile(r"(?:\b[A-ZÀ-Þ]{4,}\b[^\w\n]*){4}")),
    (lambda t: "!!!" in t or "???" in t or "?!" in t, None),
)
_numbers: dict[str, tuple[int, ...]] = {}


def _of_token(token: str) -> tuple[int, ...]:
    got = _numbers.get(token)
    if got is None:
        if len(_numbers) > 150_000:
            _numbers.clear()
        parts = [token, *(token[:n] for n in BEGINNINGS if len(token) > n)]
        slots = [0, *(k + 1 for k, n in enumerate(BEGINNINGS) if len(token) > n)]
        got = _numbers[token] = tuple(RANGE * s + zlib.crc32(p.encode("utf-8", "replace")) % RANGE for s, p in zip(slots, parts))
    return got


def numbers(text: str | None) -> set[int]:
    """Feature numbers of the whole text; a null or empty text has the constant only."""
    found: set[int] = {DIMS - 1}
    for token in set(TOKEN.findall(text.lower())) if text else ():
        found.update(_of_token(token))
    return found


def features(text: str | None) -> np.ndarray:
    """The numbers of a text, sorted."""
    return np.array(sorted(numbers(text)), np.int32)


class Sieve:
    """The numbers, among those of a mask, that a text's words have; each distinct word is looked up once."""

    def __init__(self, mask: np.ndarray) -> None:
        self.mask, self.known = mask, {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if not text:
            return found
        known = self.known
        for token in set(TOKEN.findall(text.lower())):
            got = known.get(token)
            if got is None:
                if len(known) > 300_000:
                    known.clear()
                got = known[token] = tuple(n for n in _of_token(token) if self.mask[n]) or ()
            if got:
                found.update(got)
        return found


def sample_rows(docs: DataFrame, *extra: str) -> list[tuple]:
    """(features, *extra) of the rows of a bounded frame."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"f": [features(t).tobytes() for t in x["text"]], **{c: x[c] for c in extra}})

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    rows = docs.select("text", *extra).mapInPandas(encode, f"f binary{', ' * bool(extra)}{fields}").collect()
    return sorted((bytes(r[0]), *r[1:]) for r in rows)


def telling(rows: Rows, target: np.ndarray, least: float = 3.0, lift: float = 3.0, likelihood: float = 10.8) -> np.ndarray:
    """Mask of the features that speak for toxicity: in at least `least` toxic rows, `lift` times the base rate, and beyond chance.

    target: each row's label or posterior. likelihood: least log-likelihood ratio statistic (10.8: one in a thousand by chance).
    """
    pos, all_rows = np.zeros(DIMS), np.zeros(DIMS)
    for k in range(0, len(rows), 1024):
        part = rows.take(np.arange(k, min(k + 1024, len(rows))))
        pos += part.gradient(target[k : k + 1024], DIMS)
        all_rows += np.bincount(part.values, minlength=DIMS)
    return marked(pos, all_rows, least, lift, likelihood)


def marked(pos: np.ndarray, all_rows: np.ndarray, least: float = 3.0, lift: float = 3.0, likelihood: float = 10.8) -> np.ndarray:
    """telling from each feature's toxic and total rows; the constant's are those of all rows."""
    base = float(np.clip(pos[-1] / max(1.0, all_rows[-1]), 1e-6, 1 - 1e-6))
    share = np.clip(pos / np.maximum(all_rows, 1), 1e-9, 1 - 1e-9)
    g = 2 * (pos * np.log(share / base) + (all_rows - pos) * np.log((1 - share) / (1 - base)))
    mask = (pos >= least) & (share >= lift * base) & (g > likelihood)
    mask[-1] = False
    return mask


def sign_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and total rows of each feature over all of rows(text, _toxic); exact copies count once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, every = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
        for x in batches:
            for t, toxic in zip(x["text"], x["_toxic"].tolist()):
                f = np.fromiter(numbers(t), np.int32)
                every[f] += 1
                if toxic == 1:
                    pos[f] += 1
        at = np.flatnonzero(every)
        yield pd.DataFrame({"f": at.astype(np.int32), "pos": pos[at], "n": every[at]})

    counts = rows.select("text", "_toxic").distinct().mapInPandas(count, "f int, pos long, n long")
    got = counts.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow()
    pos, every = np.zeros(DIMS), np.zeros(DIMS)
    at = got["f"].to_numpy()
    pos[at], every[at] = got["pos"].to_numpy(), got["n"].to_numpy()
    return pos, every


def lexicon_of(numbers: np.ndarray) -> np.ndarray:
    """The lexicon of each feature number."""
    group = numbers // RANGE
    return np.where(group == 0, (numbers * 2654435761 >> 7) % WORD_LEXICONS, WORD_LEXICONS + group - 1)


@dataclass
class Voters:
    """A bit for each lexicon, one for two or more telling words, one for each pattern."""

    marks: np.ndarray  # of each feature: the bit of its lexicon, 0 if in none
    known: dict[str, int] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, signs: np.ndarray) -> Voters:
        """Lexicons from the mask of telling features."""
        marks, at = np.zeros(DIMS, np.int32), np.flatnonzero(signs)
        marks[at] = 1 << lexicon_of(at)
        return cls(marks)

    def __len__(self) -> int:
        return LEXICONS + 1 + len(PATTERNS)

    def _bits(self, token: str) -> int:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = 0
            for n in _of_token(token):
                got |= int(self.marks[n])
            self.known[token] = got
        return got

    def vote(self, text: str | None) -> int:
        out = words = hits = 0
        if text:
            tokens = Counter(TOKEN.findall(text.lower()))
            for token, n in tokens.items():
                if bits := self._bits(token):
                    out |= bits
                    words += bits & ((1 << WORD_LEXICONS) - 1) > 0
                    hits += n
            out = out | (words >= 2) << LEXICONS if hits * THIN >= tokens.total() else 0
        for k, (hint, pattern) in enumerate(PATTERNS):
            if text and hint(text) and (pattern is None or pattern.search(text)):
                out |= 1 << (LEXICONS + 1 + k)
        return out


def count_votes(docs: DataFrame, voters: Voters) -> dict[int, int]:
    """Documents by vote pattern, at most 2 ** len(voters) of them, over all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[int] = Counter()
        for x in batches:
            n.update(sent.value.vote(t) for t in x["text"])
        yield pd.DataFrame({"votes": list(n), "n": list(n.values())}, dtype="int64")

    return {r.votes: r.n for r in docs.select("text").mapInPandas(count, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}


@dataclass
class LabelModel:
    """Class prior and, for each group of dependent voters, the chance of each joint vote in either class."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for group, t in zip(self.groups, self.tables):
            odds += np.log(t[1] / t[0])[_joint(votes, group)]
        return sigmoid(odds)


def _joint(votes: np.ndarray, group: list[int]) -> np.ndarray:
    return sum(((votes >> v) & 1) << k for k, v in enumerate(group))


def label_model(counts: dict[int, int], voters: int, lexicons: int, known: dict[int, tuple[int, int]] | None = None, rounds: int = 40, dependent: float = 0.2, largest: int = 6) -> LabelModel:
    """Fit the generative model to vote pattern counts; those of rows whose class is given, known (clean, toxic), are held to it.

    First all voters count as independent given the class. Pairs whose correlation within a class is above `dependent`
    are then joined, into groups of at most `largest` voters, and the model is fitted again with a joint table for each group.
    """
    known = known or {}
    votes = np.array(sorted(counts.keys() | known.keys()), np.int64)
    sure = np.array([known.get(v, (0, 0)) for v in votes.tolist()], float).reshape(-1, 2).T
    n = np.maximum(0, np.array([counts.get(v, 0) for v in votes.tolist()], float) - sure.sum(0))
    start = np.where(votes & ((1 << lexicons) - 1), 0.7, 0.02)

    def run(groups: list[list[int]]) -> tuple[LabelModel, np.ndarray]:
        p = start
        for _ in range(rounds):
            classes = (n * (1 - p) + sure[0], n * p + sure[1])
            tables = []
            for g in groups:
                t = np.stack([np.bincount(_joint(votes, g), c, 1 << len(g)) for c in classes]) + 0.1
                tables.append(t / t.sum(1, keepdims=True))
            share = float(np.clip(classes[1].sum() / max(1.0, n.sum() + sure.sum()), 0.002, 0.9))
            model = LabelModel(share, groups, tables)
            p = model.posterior(votes)
        return model, p

    p = run([[v] for v in range(voters)])[1]
    bits = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
    strength = np.zeros((voters, voters))
    for weight in (n * p + sure[1], n * (1 - p) + sure[0]):
        if weight.sum() < 1:
            continue
        mean = weight @ bits / weight.sum()
        cov = (bits * weight[:, None]).T @ bits / weight.sum() - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        strength = np.maximum(strength, np.abs(cov) / np.outer(spread, spread))
    groups = [[v] for v in range(voters)]
    for a, b in sorted(((a, b) for a in range(voters) for b in range(a) if strength[a, b] > dependent), key=lambda x: -strength[x]):
        ga, gb = (next(g for g in groups if v in g) for v in (a, b))
        if ga is not gb and len(ga) + len(gb) <= largest:
            groups = [g for g in groups if g is not ga and g is not gb] + [sorted(ga + gb)]
    return run(sorted(groups))[0]


def train(docs: DataFrame, labels: DataFrame, learn: Column, fitted: int = 24_000) -> np.ndarray:
    """Classifier weights, learnt from labels(doc_id, toxic) and docs(doc_id, text) of the rows where `learn` holds.

    Lexicons come from all labelled rows, and the label model counts the votes of all learnable documents. fitted bounds the labelled
    rows that the classifier is fitted on (about so many different texts, by hashes of id and text); its targets are the model's posteriors, never
    the labels. A doc_id with several labels counts as toxic if one says so. Without any toxic label every text scores near 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).where(learn)
    chosen = hash_sample(known.select("doc_id"), F.col("doc_id"), fitted, known.count())
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn & F.col("doc_id").isNotNull())
    pos, every = sign_counts(pool.join(known.hint("merge"), "doc_id"))  # labels have no bound: a shuffle at every size
    if not pos[-1]:
        w = np.zeros(DIMS)
        w[-1] = -5.0
        return w
    voters = Voters.of(marked(pos, every, lift=5.0))
    model = label_model(count_votes(pool, voters), len(voters), LEXICONS)
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("long")
    def votes(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.vote(t) for t in texts], dtype="int64")

    sample = pool.join(F.broadcast(chosen), "doc_id").select("text").distinct()  # exact copies count once
    sample = hash_sample(sample, F.col("text"), fitted, sample.count())  # ids may repeat
    got = sample_rows(sample.withColumn("_votes", votes("text")), "_votes")
    return fitted_weights([np.frombuffer(f, np.int32) for f, _ in got], model.posterior(np.array([v for _, v in got], np.int64)))


def fitted_weights(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of the linear classifier from feature rows and their soft labels; only features that speak for toxicity take part."""
    kept = telling(Rows.of(rows), target)
    kept[-1] = True
    place = np.cumsum(kept) - 1
    w = np.zeros(DIMS)
    w[kept] = fit(Rows.of([place[f[kept[f]]] for f in rows]), int(kept.sum()), logistic(target), epochs=30, rate=0.1, decay=1e-3)
    return w


def held_out(doc_id: Column, folds: int = 4, out: int = 2) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, score (0 to 1), predicted (1 if score >= least).

    Null and empty texts score what the classifier gives to no words at all. Rows are handled one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), Sieve(weights != 0)))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            w, sieve = sent.value
            yield pd.Series(sigmoid(np.array([float(w[-1]) + sum(w[sorted(sieve(t))].tolist()) for t in x], float)))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
