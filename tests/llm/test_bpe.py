import hashlib
import random

from sparkwarden.llm import bpe
from tests.llm.data import ODD, docs, odd


def expected(text):
    ids = bpe.encoder().encode_ordinary(text or "")
    raw = (text or "").encode()
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def test_whole_texts_on_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    got = bpe.token_digests(table, chunk=700, overlap=40).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id]) for r in got)


def test_odd_rows(spark):
    got = bpe.token_digests(odd(spark), chunk=5_000, overlap=64).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected(x[1]) for x in ODD)


def test_stitching_without_meeting_boundaries(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "'ll", "'", "l", "7", "é", "!", "x" * 30, " " * 25]) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    for text in texts:
        starts = list(range(0, len(text), 16))
        chunks = [text[s : s + 16 + 5] for s in starts]
        assert bpe.encode_chunks(chunks, starts, [bpe.encode_chunk(c) for c in chunks]) == bpe.encoder().encode_ordinary(text), repr(text)


def test_empty_table_and_ids(spark):
    assert bpe.token_digests(docs(spark, []), ids=True).collect() == []
    (row,) = bpe.token_digests(docs(spark, [(1, "héllo  wörld", "a")]), ids=True).collect()
    assert bpe.decode(row.ids).decode() == "héllo  wörld"
