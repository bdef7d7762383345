import hashlib
import os
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from sparkwarden.llm import bpe, language, mixing, pii, simhash


def test_stages_take_effect(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = dict(corpus_pipeline.STAGES)
    known = kept["language_id"](spark, docs, sf_dir)
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    far = {r.doc_id for r in language.identify(docs, model).where("lang_rejected").collect()}
    assert known.columns == columns and {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect()} - far
    single = kept["near_dedup"](spark, known, sf_dir)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(known, **simhash.COPIES).collect()}
    clean = kept["pii"](spark, single, sf_dir)
    assert clean.columns == columns and clean.count() == single.count()
    assert pii.find(clean).where("n_email + n_ip + n_phone > 0").count() == 0
    mixed = kept["mixing"](spark, clean, sf_dir)
    assert mixed.columns == columns
    words = mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == mixing.mixed_sizes(clean).agg(F.sum("taken")).first()[0]
    order = mixing.mixed_texts(clean, slots=True).orderBy("slot", "doc_id").collect()
    assert [(r.doc_id, r.text) for r in mixed.collect()] == [(r.doc_id, r.text) for r in order] and len({r.slot for r in order}) > 10
    assert [r.source for r in order[:60]] != sorted(r.source for r in order[:60])  # sources take turns
    done = kept["bpe"](spark, mixed, sf_dir)
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect())
    assert sorted(r.decoded_sha256 for r in done.collect()) == texts
    assert all(hashlib.sha256(bpe.decode(r.ids)).hexdigest() == r.decoded_sha256 for r in done.collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_near_dedup_against_plain_similarity(spark):
    """Held against all pairs: copies at 0.8 and over go, and whatever goes is near one that stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    holders = {}
    for i, s in texts.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in holders.values() for a, b in combinations(sorted(ids), 2))
    like = {p: n / len(texts[p[0]] | texts[p[1]]) for p, n in shared.items()}
    near = [p for p, s in like.items() if s >= 0.8]
    assert len(near) > 20
    assert sum(a in kept and b in kept for a, b in near) <= 0.03 * len(near)
    edge = [p for p in near if like[p] < 0.85]
    assert sum(a in kept and b in kept for a, b in edge) <= 0.1 * len(edge)
    best = {i: max((s for p, s in like.items() if i in p), default=0) for i in texts.keys() - kept}
    assert sum(s < 0.6 for s in best.values()) <= 0.02 * len(best)


def test_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.count() > 50
    (folder,) = {f.removeprefix("file:").rsplit("/", 2)[0] for f in done.inputFiles()}
    assert os.listdir(folder) == ["4_bpe"]
