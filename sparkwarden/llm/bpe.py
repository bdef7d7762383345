"""Byte-level BPE over overlapping chunks of texts.

Each chunk is pre-tokenised and encoded by itself, in parallel. A chunk that begins inside a text may
begin inside a pre-token, but as soon as its boundaries meet a boundary of the chunk before, all
later ones are equal, since no match looks back. Stitching cuts both chunks there. Where no boundary meets,
the text from the last sure boundary on is pre-tokenised over more and more chunks until one does.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@cache
def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file; made once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _names(path: str) -> list[str]:
    return [str(k) for k in range(encoder(path).n_vocab + 1)]


def digests(ids: list[int], path: str = VOCABULARY) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded bytes."""
    shown = hashlib.sha256(",".join(map(_names(path).__getitem__, ids)).encode()).hexdigest()
    return len(ids), shown, hashlib.sha256(encoder(path).decode_bytes(ids)).hexdigest()


def boundaries(text: str, pattern: str = PATTERN) -> list[int]:
    """Where the pre-tokens of the text begin."""
    return [m.start() for m in regex.compile(pattern).finditer(text)]


def stitch(chunks: list[tuple[int, str, list[int]]], end: int, pattern: str = PATTERN) -> list[tuple[int, int, str | None]]:
    """Cut pre-tokenised chunks (start in the text, chunk, own boundaries) into runs of the whole text's pre-tokens.

    Gives (index of the chunk or -1, from, to, text of a bridge) without gap or overlap; the cuts fall on boundaries of the whole text.
    A boundary is sure if a chunk's text goes on behind the match that ends there: the last match may be cut short.
    """
    runs: list[tuple[int, int, int, str | None]] = []
    at = 0  # the text is settled up to here
    k = 0
    while k < len(chunks):
        start, text, own = chunks[k]
        stop = start + len(text)
        if k + 1 == len(chunks):
            runs.append((k, at, end, None))
            break
        sure = {start + b for b in own[:-1] if start + b >= at} | {at}
        nxt = k + 1
        common = [b for b in (chunks[nxt][0] + x for x in chunks[nxt][2]) if b in sure and b > chunks[nxt][0]]
        if common:
            cut_at = common[-1]
            runs.append((k, at, cut_at, None))
            at, k = cut_at, nxt
            continue
        last = max(sure)
        if last > at:
            runs.append((k, at, last, None))
        at = last
        bridge = text[at - start :]
        while True:  # pre-tokenise on from the last sure boundary until the next chunk's boundaries are met
            s2, t2, own2 = chunks[nxt]
            bridge += t2[stop - s2 :]
            stop = s2 + len(t2)
            more = boundaries(bridge, pattern)
            final = nxt + 1 == len(chunks)
            known = {at + b for b in (more if final else more[:-1])}
            met = [b for b in (s2 + x for x in own2) if b in known and b > s2 and b > at]
            if met:
                runs.append((-1, at, met[0], bridge[: met[0] - at]))
                at, k = met[0], nxt
                break
            if final:
                runs.append((-1, at, end, bridge))
                return runs
            nxt += 1
    return runs


def encode_chunks(chunks: list[str], starts: list[int], encoded: list[tuple[list[int], list[int], list[int]]], path: str = VOCABULARY) -> list[int]:
    """Ids of the whole text from its chunks; encoded: for each chunk boundaries, ids, and the number of ids before each boundary."""
    end = starts[-1] + len(chunks[-1])
    ids: list[int] = []
    for k, lo, hi, bridge in stitch([(s, c, e[0]) for s, c, e in zip(starts, chunks, encoded)], end):
        if bridge is not None:
            ids += encoder(path).encode_ordinary(bridge)
            continue
        own, own_ids, before = encoded[k]
        place = {starts[k] + b: n for b, n in zip(own, before)} | {starts[k] + len(chunks[k]): len(own_ids)}
        ids += own_ids[place[lo] : place[hi]]
    return ids


def encode_chunk(text: str, path: str = VOCABULARY) -> tuple[list[int], list[int], list[int]]:
    """Boundaries, ids, ids before each boundary."""
    own, ids, before, encode = boundaries(text), [], [], encoder(path).encode_ordinary
    for a, b in zip(own, [*own[1:], len(text)]):
        before.append(len(ids))
        ids += encode(text[a:b])
    return own, ids, before


def pack(values: list[int]) -> bytes:
    """Values of 0 or more in the least width that holds them all, led by that width in bytes."""
    a = np.asarray(values, np.int64)
    width = np.min_scalar_type(int(a.max(initial=0)))
    return bytes([width.itemsize]) + a.astype(width).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def token_digests(docs: DataFrame, path: str = VOCABULARY, chunk: int = 16_384, overlap: int = 512, ids: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    A null text counts as empty: no tokens, digests of the empty string. Rows are handled one by one, so
    repeated or null doc_ids give as many rows. Texts of at most `chunk` characters are one chunk; longer ones are cut
    in chunks of that length, each with `overlap` more characters, which tasks encode apart.
    """
    wanted = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def finish(doc_id, all_ids: list[list[int]]) -> pd.DataFrame:
        out = pd.DataFrame([digests(x, path) for x in all_ids], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        out.insert(0, "doc_id", np.asarray(doc_id, dtype=object))
        return out.assign(doc_id=out["doc_id"].astype("Int64"), **({"ids": all_ids} if ids else {}))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for x in batches:
            for k in range(0, len(x), 64):
                part = x.iloc[k : k + 64]
                yield finish([None if pd.isna(i) else int(i) for i in part["doc_id"]], [encode(t) for t in part["text"]])

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for row in x.itertuples(index=False):
                own, got, before = encode_chunk(row.part, path)
                yield pd.DataFrame([(row.row, row.doc_id, row.start, row.part, pack(np.diff(own, prepend=0)), pack(got), pack(np.diff(before, prepend=0)))], columns=["row", "doc_id", "start", "part", "own", "got", "before"]).astype({"doc_id": "Int64"})

    def together(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("start")
        encoded = [(unpack(own).cumsum().tolist(), unpack(got).tolist(), unpack(before).cumsum().tolist()) for own, got, before in zip(x["own"], x["got"], x["before"])]
        doc_id = x["doc_id"].iloc[0]
        return finish([None if pd.isna(doc_id) else int(doc_id)], [encode_chunks(x["part"].tolist(), x["start"].tolist(), encoded, path)])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInPandas(whole, wanted)
    cut_up = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    pieces = cut_up.select("row", "doc_id", F.posexplode(F.transform(starts, lambda k: F.substring("text", k * chunk + 1, F.lit(chunk + overlap)))).alias("start", "part"))
    pieces = pieces.withColumn("start", F.col("start").cast("long") * chunk)
    done = pieces.mapInPandas(apart, "row long, doc_id long, start long, part string, own binary, got binary, before binary")
    return short.unionByName(done.groupBy("row").applyInPandas(together, wanted))


def decode(ids: list[int], path: str = VOCABULARY) -> bytes:
    """The raw bytes of the ids, joined."""
    return encoder(path).decode_bytes(ids)
