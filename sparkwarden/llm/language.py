"""Language ID by nearest centroid: TF-IDF of hashed byte n-grams, several clustered centroids per language, cosine.

A text is lower-cased, everything but letters becomes a single blank, and all 1- to 3-grams of its UTF-8
bytes are hashed into `dims` counters. Vectors are log(1 + tf) * idf, of length 1. Document frequencies come from all learnable documents;
centroids from a bounded sample of each language. A text is rejected if its cosine lies below what texts of its size that took no part
in the clustering reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import fold, fresh

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
SLICE = 1 << 20
#: Sizes (bytes of letters and blanks) from which a text falls in the next bin of the floor.
SIZES = (64, 256, 1024)


def gram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of hashed byte n-grams of the whole text; None for a text without letters."""
    if not text or not LETTER.search(text):
        return None
    raw = np.frombuffer(f" {OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8)
    counts, shift = np.zeros(dims, np.int64), np.uint32(32 - int(dims).bit_length() + 1)
    for s in range(0, len(raw), SLICE):
        one = raw[s : s + SLICE + 2].astype(np.uint32)
        for n in (1, 2, 3):
            m = min(len(one) - n + 1, SLICE)
            if m > 0:
                gram = sum((one[k : k + m] << np.uint32(8 * k) for k in range(n)), np.uint32(n << 24))
                counts += np.bincount((gram * np.uint32(2654435761)) >> shift, minlength=dims)
    return counts


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors, and the bin of SIZES of each text; zeros for texts without letters."""
    out, bins = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if (c := gram_counts(t, len(idf))) is not None:
            v = np.log1p(c) * idf
            out[k] = v / (np.linalg.norm(v) or 1.0)
            bins[k] = np.searchsorted(SIZES, (int(c.sum()) + 3) // 3, "right")
    return out, bins


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the unit centroids."""
    centres = [x.mean(0)]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ (c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]).T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    floor: np.ndarray = field(default_factory=lambda: np.zeros(len(SIZES) + 1))  # smallest cosine that is accepted, for each bin of SIZES

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the text is rejected as too far from every centroid."""
        x, bins = vectors(texts, self.idf)
        lettered = x.any(1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = x @ self.centres.T
        best = cos.argmax(1)
        top = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(float)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return langs, np.where(lettered, top, 0.0), ~lettered | (top < self.floor[bins])


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Documents in which each counter is above 0, over all documents with letters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dims, np.int64), 0
        for x in batches:
            for t in x["text"]:
                if (c := gram_counts(t, dims)) is not None:
                    df += c > 0
                    n += 1
        yield pd.DataFrame({"slot": np.arange(dims + 1), "n": np.append(df, n)})

    total = np.zeros(dims + 1, np.int64)
    for r in docs.select("text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[r.slot] = r.n
    return total[:dims], int(total[dims])


def train(docs: DataFrame, learn: Column, dims: int = 4096, centroids: int = 6, sample: int = 1500, share: float = 0.002, slack: float = 0.8, most_langs: int = 1000) -> Centroids:
    """Learn from text and non-null lang of the rows of docs where `learn` holds.

    sample bounds the different labelled texts that each language's centroids are clustered from, and as many others that the floors
    are fitted on; document frequencies cover every learnable row. Texts are chosen by a hash, at a share that follows from how many *different* texts a
    language has (counted by a sketch), so copies neither take places nor hide a language that has few. Of the latter texts in each bin of
    SIZES the floor is slack times the `share` quantile of their cosines with the nearest centroid. A language of under 50 different texts gives all to its centroids.
    The model holds at most `most_langs` languages, those with most different texts, ties by name: lang may be dirty.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learn.alias("learn")).where("learn and lang is not null and text is not null")
    df, n = document_frequencies(known, dims)
    idf = np.log((1 + n) / (1 + df)) + 1
    place = F.xxhash64(F.lit("sample"), F.col("text"))
    lettered = known.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", place.alias("place"))
    different = lettered.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    parts = [(r.lang, min(1_000_000, int(2_000_000 * sample / r.n) + 1), r.n < 50) for r in different]
    parts = known.sparkSession.createDataFrame(parts or [("", 0, True)], "lang string, share int, few boolean")
    chosen = lettered.join(F.broadcast(parts), "lang").where(F.pmod("place", F.lit(1_000_000)) < F.col("share"))  # at most most_langs rows
    chosen = chosen.select("lang", "text", (F.col("few") | (F.pmod(F.shiftright("place", 32), F.lit(2)) == 0)).alias("fit")).distinct()  # copies count once

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        v, _ = vectors(x["text"].tolist(), idf)
        v = v[v.any(1)]
        c = cluster(v, centroids) if len(v) else []
        return pd.DataFrame({"lang": x["lang"].iloc[0], "centre": [r.astype(np.float32).tobytes() for r in c]})

    found = chosen.where("fit").groupBy("lang").applyInPandas(fit, "lang string, centre binary").collect()
    rows = sorted(found, key=lambda r: (r.lang, bytes(r.centre)))
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in rows]) if rows else np.zeros((0, dims), np.float32)
    model = Centroids(idf, [r.lang for r in rows], centres)
    if rows:
        model.floor = floors(chosen.where("not fit"), model, share, slack)
    return model


def floors(texts: DataFrame, model: Centroids, share: float, slack: float, least: int = 20) -> np.ndarray:
    """The floor of each bin from texts(text), a bounded frame; a bin of under `least` texts takes that of all, and of too few texts in all the floor is 0."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for s in range(0, len(x), 256):
                v, bins = vectors(x["text"].iloc[s : s + 256].tolist(), sent.value.idf)
                yield pd.DataFrame({"bin": bins, "cos": (v @ sent.value.centres.T).max(1).astype(float)})[v.any(1)]

    got = texts.select("text").mapInPandas(near, "bin long, cos double").toPandas()
    cut_at = lambda x: slack * float(np.quantile(x, share)) if len(x) >= least else None
    every = cut_at(got["cos"]) or 0.0
    return np.array([cut_at(got["cos"][got["bin"] == k]) or every for k in range(len(SIZES) + 1)])


def held_out(doc_id: Column, folds: int = 4, out: int = 2) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected appended, row by row.

    A null text or one without letters is `und` with score 0 and rejected; so is every text if nothing could be learned.
    Columns of docs with those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            for_all = [sent.value.predict(x.iloc[s : s + 256].tolist()) for s in range(0, len(x), 256)] or [([], np.empty(0), np.empty(0, bool))]
            langs, score, far = zip(*for_all)
            yield pd.DataFrame({"lang_pred": sum(langs, []), "lang_score": np.concatenate(score), "lang_rejected": np.concatenate(far)})

    once = of.asNondeterministic()  # else a filter on a result has every text looked at twice, by two workers at a time
    name = fresh(docs, "found")
    return docs.select(*kept, once(F.col("text").cast("string")).alias(name)).select(*kept, f"{name}.*")
