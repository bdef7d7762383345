"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts is a table: every context of 0 to ORDER bytes with the counts of the bytes seen after it in the training texts.
A text's score adds the log-probability of each byte: from the longest context if the byte was seen there, else that context's
escape (method C: distinct successors over all their counts plus distinct) and the next shorter context, in which the bytes
already ruled out are excluded; below order 0 all bytes left are equally likely.

The counts cover all training texts, and every pair of every order counts. Neither the trie nor the vocabulary is ever whole in one
place: documents are dealt into groups, each asks for the keys and words it holds, and buckets answer. A bucket of the trie has all
pairs of some contexts' last two bytes; an ending with too many pairs is split by the byte before it, and each part gets the ending's order-2
pairs besides its own. So orders 3 to 5 derive from a bucket's own longest pairs. What all tasks share cannot grow with the corpus:
orders 0 and 1, at most 2 ** 16 + 2 ** 8 pairs, and the directory of the 2 ** 16 endings. A question is a packed list; buckets answer one
question after the other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, fold

ORDER = 5
END = b""  # the end of a text, as a token; no word is empty
SLICE = 1 << 20
PLACE = 15  # bits that number a text within a slice; with a key's 48 they fit a long
LOW = 1  # the longest order that all tasks share
ENDINGS = 1 << 16
PAIR, TWO, WORD = -3, -2, -1  # in place of a group: kinds of facts


def raw(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower() if text else b""


def slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts (long ones in parts): first text's number, keys of (context, byte) and how many keys each text of the run has here.

    A text is led in by ORDER zero bytes and ends with one; a key holds ORDER context bytes and the byte, 8 bits each.
    """
    k, size, run = 0, 0, []
    for n, t in enumerate(texts):
        for s in range(0, len(t) + 1, SLICE):
            last = s + SLICE >= len(t) + 1
            part = t[max(0, s - ORDER) : s + SLICE] + (b"\0" if last and s + SLICE > len(t) else b"")
            part = bytes(ORDER - min(s, ORDER)) + part
            if not run:
                k = n
            run.append((n, part))
            size += len(part)
            if size >= SLICE or n - k + 1 == 1 << PLACE:
                yield _keys(k, run)
                size, run = 0, []
    if run:
        yield _keys(k, run)


def _keys(first: int, run: list[tuple[int, bytes]]) -> tuple[int, np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(p for _, p in run), np.uint8).astype(np.int64)
    key = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        key += b[ORDER - k : len(b) - k] << (8 * k)
    sizes = np.array([len(p) - ORDER for _, p in run])
    keep = np.ones(len(key), bool)
    at = np.cumsum(sizes + ORDER)[:-1]
    for j in range(1, ORDER + 1):
        keep[at - j] = False
    counts = np.zeros(run[-1][0] - first + 1, np.int64)
    np.add.at(counts, [n - first for n, _ in run], sizes)
    return first, key[keep], counts


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts or summed weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[begin], np.diff(np.append(begin, len(keys))) if weights is None else (np.add.reduceat(weights, begin) if len(begin) else weights)


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n) of all (context, byte) pairs of the longest order, and (token, n) of all tokens, over docs(text)."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return tally(*(np.concatenate(x) for x in zip(*held)))

        for x in batches:
            for _, more, _ in slices([raw(t) for t in x["text"]]):
                held.append(tally(more))
                size += len(held[-1][0])
                if size > 3_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield pd.DataFrame(dict(zip(("key", "n"), held[0])))
                        held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("key", "n"), merged())))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[bytes] = Counter()
        for x in batches:
            for t in x["text"]:
                n.update(raw(t).split())
                n[END] += 1
                if len(n) > 500_000:
                    yield pd.DataFrame({"token": list(n), "n": list(n.values())})
                    n.clear()
        if n:
            yield pd.DataFrame({"token": list(n), "n": list(n.values())})

    by_key = docs.select("text").mapInPandas(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    by_token = docs.select("text").mapInPandas(words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return by_key, by_token


class Trie:
    """Sorted (context, byte) keys and counts of each order."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        order = [np.argsort(k) for k in keys]
        self.keys, self.counts = [k[o] for k, o in zip(keys, order)], [n[o] for n, o in zip(counts, order)]
        top, n = self.keys[ORDER], self.counts[ORDER]
        begin = np.flatnonzero(np.concatenate(([True], top[1:] >> 8 != top[:-1] >> 8))) if len(top) else np.empty(0, np.int64)
        kinds = np.diff(np.append(begin, len(top)))
        total = np.add.reduceat(n, begin) + kinds if len(top) else kinds
        self.logs = np.log10(n / np.repeat(total, kinds)).astype(np.float64)
        self.top = top if len(top) else np.array([-1])
        self.logs = self.logs if len(top) else np.zeros(1)
        self.rare: dict[int, float] = {}

    @classmethod
    def bucket(cls, low: list[tuple[np.ndarray, np.ndarray]], two: tuple[np.ndarray, np.ndarray], key: np.ndarray, n: np.ndarray) -> Trie:
        """A bucket's part: its longest pairs, the orders that follow from them, its order-2 pairs, and the shared low ones."""
        long = {ORDER: (key, n), LOW + 1: two}
        for order in range(ORDER - 1, LOW + 1, -1):
            long[order] = tally(long[order + 1][0] & ((1 << 8 * (order + 1)) - 1), long[order + 1][1])
        none = np.empty(0, np.int64)
        out = cls(*([long.get(k, (none, none))[j] for k in range(ORDER + 1)] for j in (0, 1)))
        for k, (keys, counts) in enumerate(low):
            out.keys[k], out.counts[k] = keys, counts
        return out

    def log(self, key: int) -> float:
        """log10 of the probability of the key's byte after its context, with escapes and exclusion."""
        symbol, context, out, gone = key & 255, key >> 8, 0.0, np.zeros(256, bool)
        for order in range(ORDER, -1, -1):
            node = (context & ((1 << 8 * order) - 1)) << 8
            lo, hi = np.searchsorted(self.keys[order], [node, node + 256])
            symbols, counts = self.keys[order][lo:hi] & 255, self.counts[order][lo:hi]
            left = ~gone[symbols]
            n, kinds = int(counts[left].sum()), int(left.sum())
            if not kinds:
                continue
            hit = np.flatnonzero(left & (symbols == symbol))
            if len(hit):
                return out + float(np.log10(counts[hit[0]] / (n + kinds)))
            out += float(np.log10(kinds / (n + kinds)))
            gone[symbols] = True
        return out - float(np.log10(256 - gone.sum()))

    def logs_of(self, keys: np.ndarray) -> np.ndarray:
        """log of each key."""
        at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
        logs = self.logs[at]
        for k in np.flatnonzero(self.top[at] != keys).tolist():
            key = int(keys[k])
            got = self.rare.get(key)
            if got is None:
                if len(self.rare) > 1_000_000:
                    self.rare.clear()
                got = self.rare[key] = self.log(key)
            logs[k] = got
        return logs


def low_orders(pairs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of orders 0 to LOW, sorted."""
    got = pairs.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    out = [tally(got["key"].to_numpy(), got["n"].to_numpy())]
    for order in range(LOW - 1, -1, -1):
        out.insert(0, tally(out[0][0] & ((1 << 8 * (order + 1)) - 1), out[0][1]))
    return out


@dataclass
class Directory:
    """For each pair of bytes that ends a context: its first bucket, and in how many it is split by the byte before."""

    first: np.ndarray
    parts: np.ndarray
    buckets: int

    @classmethod
    def of(cls, pairs: DataFrame, bucket: int) -> Directory:
        """Buckets of about `bucket` pairs, from the pairs of each ending: at most ENDINGS counts come to the driver."""
        got = pairs.groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(ENDINGS - 1)).alias("ending")).agg(F.count("*").alias("n")).toArrow()
        n = np.zeros(ENDINGS, np.int64)
        n[got["ending"].to_numpy()] = got["n"].to_numpy()
        small = n <= bucket
        parts = np.clip(-(-n // bucket), 1, 256)
        first = np.maximum(np.cumsum(np.where(small, n, 0)) - 1, 0) // bucket
        shared = int(first.max()) + 1
        own = np.where(small, 0, parts)
        first = np.where(small, first, shared + np.cumsum(own) - own)
        return cls(first, parts, shared + int(own.sum()))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        ending = keys >> 8 & (ENDINGS - 1)
        return self.first[ending] + (spread(keys >> 24 & 255) >> 13) % self.parts[ending]

    def dealt(self, pairs: DataFrame, ending: Column) -> DataFrame:
        """pairs with `first` and `parts` of their ending."""
        table = pd.DataFrame({"_e": np.arange(ENDINGS), "first": self.first, "parts": self.parts})
        return pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(table)), ending == F.col("_e")).drop("_e")  # ENDINGS rows


def spread(byte):
    """A number for a byte, over columns and arrays alike."""
    return byte * 0x9E3779B1


def word_bucket(word: bytes, buckets: int) -> int:
    return buckets + zlib.crc32(word) % buckets


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed steps, the bytes of one place beside each other."""
    steps = np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(steps[:, : ORDER + 1].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(ORDER + 1, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : ORDER + 1] = planes.T
    return np.cumsum(steps.view("<i8").ravel())


def distinct_keys(texts: list[bytes]) -> np.ndarray:
    found, held, size = np.empty(0, np.int64), [], 0
    for _, keys, _ in slices(texts):
        held.append(tally(keys)[0])
        size += len(held[-1])
        if size > 2_000_000:
            found, held, size = tally(np.concatenate([found, *held]))[0], [], 0
    return tally(np.concatenate([found, *held]))[0]


def packed_logs(logs: np.ndarray) -> bytes:
    """Logs as their distinct values and each one's number among them, compressed."""
    values, place = np.unique(logs, return_inverse=True)
    width = np.min_scalar_type(len(values))
    return zlib.compress(len(values).to_bytes(4, "little") + bytes([width.itemsize]) + values.tobytes() + place.astype(width).tobytes(), 1)


def unpacked_logs(data: bytes) -> np.ndarray:
    raw_data = zlib.decompress(data)
    n = int.from_bytes(raw_data[:4], "little")
    return np.frombuffer(raw_data, np.float64, n, 5)[np.frombuffer(raw_data, f"u{raw_data[4]}", offset=5 + 8 * n)]


def questions(texts: list[bytes], directory: Directory, most: int = 16_384) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed keys or words): all that the texts hold, in lists of at most `most`; buckets of words follow those of keys."""
    keys, buckets = distinct_keys(texts), directory.buckets
    b = directory.bucket(keys)
    order = np.argsort(b, kind="stable")
    keys, b = keys[order], b[order]
    ends = np.append(np.flatnonzero(b[1:] != b[:-1]) + 1, len(b))
    for s, e in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
        for k in range(s, e, most):
            yield int(b[s]), packed(keys[k : min(k + most, e)])
    words: dict[int, list[bytes]] = {}
    for w in sorted({END}.union(*(t.split() for t in texts))):
        words.setdefault(word_bucket(w, buckets), []).append(w)
    for bucket, held in words.items():
        for k in range(0, len(held), most):
            yield bucket, zlib.compress(b" ".join(held[k : k + most]), 1)


def answered(pairs: DataFrame, tokens: DataFrame, asked: DataFrame, directory: Directory) -> DataFrame:
    """(g, b, ask, reply) of each question asked(g, b, ask): the logs of its keys, or the counts of its words.

    A task sorts its buckets, reads each bucket's facts (g is PAIR, TWO or WORD) and then answers its questions as they come.
    """
    buckets = directory.buckets
    sent = pairs.sparkSession.sparkContext.broadcast(low_orders(pairs))  # at most 2 ** 16 + 2 ** 8 pairs
    none, zero = F.lit(b""), F.lit(0).cast("long")
    ending = F.shiftright("key", 8).bitwiseAND(F.lit(ENDINGS - 1))
    part = F.shiftright(spread(F.shiftright("key", 24).bitwiseAND(F.lit(255))), 13) % F.col("parts")
    by_key = directory.dealt(pairs, ending).select((F.col("first") + part).cast("int").alias("b"), F.lit(PAIR).alias("g"), "key", "n", none.alias("ask"))
    two = pairs.groupBy(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)).alias("key")).agg(F.sum("n").alias("n"))
    by_two = directory.dealt(two, ending).select(F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("parts") - 1).cast("int"))).alias("b"), F.lit(TWO).alias("g"), "key", "n", none.alias("ask"))
    by_word = tokens.select((F.crc32("token") % buckets + buckets).cast("int").alias("b"), F.lit(WORD).alias("g"), zero.alias("key"), "n", F.col("token").alias("ask"))
    every = by_key.unionByName(by_two).unionByName(by_word).unionByName(asked.select("b", "g", zero.alias("key"), zero.alias("n"), "ask"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, facts, book = -1, [], None
        out, size = [], 0
        for x in batches:
            for b, part in x.groupby("b"):
                if b != now:
                    now, facts, book = b, [], None
                told = (part["g"] < 0).to_numpy()
                if told.any():
                    facts.append(part[told])
                if told.all():
                    continue
                if book is None:
                    book = _book(sent.value, facts, b < buckets)
                    facts = []
                for g, ask in zip(part["g"][~told].tolist(), part["ask"][~told]):
                    if b < buckets:
                        reply = packed_logs(book.logs_of(unpacked(ask)))
                    else:
                        reply = zlib.compress(np.array([book.get(w, 0) for w in zlib.decompress(ask).split(b" ")], np.int64).tobytes(), 1)
                    out.append((g, b, ask, reply))
                    size += len(ask) + len(reply)
                    if size > 1 << 23:
                        yield pd.DataFrame(out, columns=["g", "b", "ask", "reply"])
                        out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["g", "b", "ask", "reply"])

    return every.repartition(max(1, buckets // 2), "b").sortWithinPartitions("b", "g").mapInPandas(answer, "g int, b int, ask binary, reply binary")


def _book(low: list[tuple[np.ndarray, np.ndarray]], facts: list[pd.DataFrame], of_keys: bool) -> Trie | dict[bytes, int]:
    every = pd.concat(facts) if facts else pd.DataFrame({"g": np.empty(0, np.int64), "key": np.empty(0, np.int64), "n": np.empty(0, np.int64), "ask": []})
    if not of_keys:
        return dict(zip(map(bytes, every["ask"]), every["n"].tolist()))
    own, two = (every[every["g"] == kind] for kind in (PAIR, TWO))
    return Trie.bucket(low, (two["key"].to_numpy(), two["n"].to_numpy()), own["key"].to_numpy(), own["n"].to_numpy())


def scores(texts: list[bytes], known: np.ndarray, log: np.ndarray) -> np.ndarray:
    """log10 probability of each whole text, its end included, from the logs of its (sorted) keys; ValueError if one of them is not there."""
    out = np.zeros(len(texts))
    for first, keys, sizes in slices(texts):
        # sorted by key, so that look-ups walk through the table in its order; the text's number rides in the low bits
        marked = np.sort(keys << PLACE | np.repeat(np.arange(len(sizes)), sizes))
        keys, place = marked >> PLACE, marked & ((1 << PLACE) - 1)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        found = np.searchsorted(known, keys[begin])
        if len(found) and (found[-1] == len(known) or (known[found] != keys[begin]).any()):
            raise ValueError("a context was not answered: the rows were dealt otherwise than when they were asked for")
        logs = log[found]
        each = np.repeat(logs, np.diff(np.append(begin, len(keys))))
        out[first : first + len(sizes)] += np.bincount(place, each, len(sizes))
    return out


def held_out(doc_id: Column, folds: int = 10, out: int = 0) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def score(docs: DataFrame, learn: Column, group: int = 6 << 20, bucket: int = 60_000) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `learn` holds. Null texts count as empty; an empty text is its end alone. Rows are
    handled one by one, so repeated rows are spread like any others; docs should be a table or cut, since a row's place in it is part of
    how rows are dealt. `group` is about how many bytes of text share their questions, `bucket` about how many pairs or words share
    an answering bucket; neither changes results.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs, tokens = (cut(x) for x in counted(own.where(learn)))
    total, distinct = tokens.agg(F.sum("n"), F.count("*")).first()
    total, floor = int(total or 0), 0.1
    whole = total + floor * (distinct + 1)
    directory = Directory.of(pairs, bucket)
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-max(size or 0, rows * 64) // group))
    dealt = own.withColumn("g", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def wanted(x: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(questions([raw(t) for t in x["text"]], directory)), columns=["b", "ask"])
        return out.assign(g=x["g"].iloc[0])[["g", "b", "ask"]]

    replies = answered(pairs, tokens, dealt.groupBy("g").applyInPandas(wanted, "g int, b int, ask binary"), directory)

    def judge(x: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        keys, logs, counts = [], [], {}
        for b, ask, reply in zip(told["b"].tolist(), told["ask"], told["reply"]):
            if b < directory.buckets:
                keys.append(unpacked(ask))
                logs.append(unpacked_logs(reply))
            else:
                counts.update(zip(zlib.decompress(ask).split(b" "), np.frombuffer(zlib.decompress(reply), np.int64).tolist()))
        keys, logs = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(keys)
        texts, rows = [raw(t) for t in x["text"]], []
        for t in texts:
            c = np.array([counts[w] for w in t.split()] + [counts[END]], float)
            rows.append((len(c), int((c > 0).sum()), total, float(np.log10((c + floor) / whole).sum())))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "train_tokens", "base_score"])
        return out.assign(doc_id=x["doc_id"].astype("Int64").to_numpy(), score=scores(texts, keys[order], logs[order]))[["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(judge, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
