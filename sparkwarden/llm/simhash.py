"""SimHash near-duplicates: close fingerprints through shards, in each of which vantage-point trees find the pairs.

Inside a shard the tree is built and queried at once: a vantage point cuts the points at a distance r, those within r go
to one branch, those beyond r - radius to the other, so points in the boundary's overlap meet both sides and, by the triangle inequality, no pair
is lost. r is where the two branches leave the least work; a branch in which no cut saves a tenth is a leaf, whose points are sorted by their distance
to one of them and compared up to the triangle bound. Dense groups (near copies by the thousand) are flooded there: a point that
has been reached is never compared again, and only a star of links leaves the task.

Shards. Random fingerprints of 64 bits lie at 32 +- 4 bits from any vantage point, so a cut by distance with an overlap of 4 bits leaves about 0.73 of
the points on either side and, level by level, more work than before (`vantage_shards` is that router, kept for comparison; figures are in the README). Shards
are therefore balls in the metric of blocks of bits: two fingerprints at distance <= radius agree wholly on some choice of blocks, so there they lie at
distance 0 from the same vantage point (the block's value). Every fingerprint goes to its shard of every choice of blocks. No pair is lost. For
wide radii no choice of blocks is small enough (`sampled_masks` bring such pairs together by chance only, and are kept for comparison); there texts meet at the first of their
shingles in a common order, fingerprints decide, and pairs that they leave apart are decided by the shingles themselves (`copies`): no pair at the similarity is lost.
A shard over `chunk` points is cut in chunks and each pair of chunks meets in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import components, cut, join_hot

BITS = 64
STEP = 1 << 15
LEAF = 128
#: Settings for near copies by similarity: 512 bits over shingles of five words.
COPIES = {"width": 5, "words": 8, "similarity": 0.8}
#: Deviations beyond what the similarity makes differ that still link: 0.93 of pairs at the very similarity lie within.
SLACK = 1.5
#: Buckets in which the shingles of all texts are counted.
BUCKETS = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent of the input's (shifts and multiplications of the SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(texts: list[bytes], seed: int, words: int) -> np.ndarray:
    """Hash bits of each text, as rows of bytes: XXH64 for one number, else XXH3's two, and further ones mixed from both."""
    if words == 1:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(t, seed) for t in texts), np.uint64, len(texts)).astype("<u8").view(np.uint8).reshape(-1, 8)
    two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<u8").reshape(-1, 2)
    more = [_mixed(two[:, 0] + np.uint64(k) * (two[:, 1] | np.uint64(1))) for k in range(1, words - 1)]
    return np.concatenate([two, *(m[:, None] for m in more)], 1).astype("<u8").view(np.uint8).reshape(len(texts), -1)


def _shingles(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words, joined, and where each shingle of `width` words (fewer: the whole) begins and ends in them."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(found) - width + 1)
    return b" ".join(found), starts[:n].tolist(), (ends[len(found) - n :] - 1).tolist()


def text_fingerprint(text: str | None, width: int = 4, seed: int = 42, words: int = 1) -> np.ndarray:
    """SimHash of one text over its shingles of `width` words, in `words` numbers of 64 bits; 0 for a text without words. One number takes XXH64 with the seed, more take XXH3."""
    joined, first, last = _shingles(text, width)
    n = len(first)
    if not n:
        return np.zeros(words, np.uint64)
    ones = np.zeros(BITS * words, np.int64)
    for k in range(0, n, STEP // words):
        raw = _digests([joined[s:e] for s, e in zip(first[k : k + STEP // words], last[k : k + STEP // words])], seed, words)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        for s in range(0, len(bits), 255):  # so many ones fit a byte
            ones += bits[s : s + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's different shingles, ascending."""
    joined, first, last = _shingles(text, width)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(first, last)), np.uint64, len(first)))


def names(words: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(words)]


def node(words: list[str]) -> Column:
    """The number that names a fingerprint: itself, or a hash of its numbers."""
    return F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, words: int = 1, *extra: str) -> DataFrame:
    """(doc_id, w0, ..., fp long, *extra) for each row; null and empty texts have fingerprint 0."""
    own = names(words)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fps = np.array([text_fingerprint(t, width, seed, words) for t in x["text"]], np.uint64).reshape(-1, words).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"], **dict(zip(own, fps.T)), **{c: x[c] for c in extra}})

    schema = "".join(f", {c} long" for c in (*own, *extra))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra).mapInPandas(prints, f"doc_id long{schema}").withColumn("fp", node(own))


def block_masks(count: int, radius: int, shard: int = 1024) -> list[int]:
    """Masks of the block metrics; shards of about `shard` points for `count` evenly spread fingerprints."""
    bits = 0 if count <= 2 * shard else math.ceil(math.log2(count / shard))
    if not bits:
        return [0]
    for blocks in range(radius + 1, 2 * radius + 2):
        width, kept = BITS // blocks, blocks - radius
        if bits <= kept * width or blocks == 2 * radius + 1:
            masks = []
            for chosen in combinations(range(blocks), kept):
                places = [b * width + k for k in range(width) for b in chosen][:bits]
                masks.append(sum(1 << p for p in places))
            return masks
    raise AssertionError


def differing(similarity: float) -> float:
    """Chance that a bit of two texts' fingerprints differs, from the Jaccard similarity of their shingles."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius_of(similarity: float, bits: int) -> int:
    """Bits that differ at the similarity, and SLACK deviations more."""
    p = differing(similarity)
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def sampled_masks(count: int, bits: int, similarity: float, shard: int = 1024, recall: float = 0.97, seed: int = 7) -> list[int]:
    """Masks of sampled bits: shards of about `shard` points, and so many that a pair at the similarity meets in one with the given chance."""
    kept = 0 if count <= 2 * shard else math.ceil(math.log2(count / shard))
    if not kept:
        return [0]
    times = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** kept))
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(bits, kept, replace=False)) for _ in range(times)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of points (rows of 64-bit numbers) that broadcast against each other."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def boundary(d: np.ndarray, radius: int, least: float = 0.9) -> int | None:
    """The distance at which a cut leaves the least work in both branches, their overlap included; None if that is no less than `least` of all."""
    within = np.cumsum(np.bincount(d))
    beyond = len(d) - np.concatenate((np.zeros(radius, np.int64), within))[: len(within)]  # further than r - radius
    work = within.astype(float) ** 2 + beyond.astype(float) ** 2
    best = int(work.argmin())
    return best if work[best] < least * len(d) ** 2 else None


class Links:
    """Pairs found in a shard, and what it took to find them."""

    def __init__(self, points: np.ndarray, radius: int) -> None:
        self.points, self.radius, self.compared = points, radius, 0
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def tree(self) -> None:
        """Cut by vantage points, branch after branch, down to leaves."""
        todo = [np.arange(len(self.points))]
        while todo:
            at = todo.pop()
            cut_at = None
            if len(at) > LEAF:
                d = distances(self.points[at], self.points[at[0]])
                self.compared += len(at)
                cut_at = boundary(d, self.radius)
            if cut_at is None:
                self.leaf(at)
            else:
                todo += [at[d <= cut_at], at[d > cut_at - self.radius]]

    def leaf(self, at: np.ndarray) -> None:
        ring = distances(self.points[at], self.points[at[:1]])
        order = at[np.argsort(ring, kind="stable")]
        ring = np.sort(ring, kind="stable")
        k = 0
        while k < len(order):
            e = min(k + 256, len(order))
            hi = int(np.searchsorted(ring, ring[e - 1] + self.radius, "right"))
            hit = self.near(order[k:e], order[k:hi])
            if hit.sum() <= 64 * (e - k):
                i, j = np.nonzero(hit)
                self.a.append(order[k + i])
                self.b.append(order[k + j])
                k = e
                continue
            dense = k + int(hit.sum(1).argmax())
            reached = self.flood(order, ring, dense)
            self.a.append(order[reached])
            self.b.append(np.full(int(reached.sum()), order[dense]))
            k -= int(reached[:k].sum())
            order, ring = order[~reached], ring[~reached]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.compared += len(i) * len(j)
        return distances(self.points[i][:, None], self.points[j][None]) <= self.radius

    def flood(self, order: np.ndarray, ring: np.ndarray, seed: int) -> np.ndarray:
        """Mask of all points of a leaf (sorted by their ring) that are reachable from the seed."""
        reached = np.zeros(len(order), bool)
        reached[seed] = True
        front, left = [seed], np.flatnonzero(~reached)
        while front and len(left):
            now, front = sorted(front)[:128], sorted(front)[128:]
            lo, hi = np.searchsorted(ring[left], [ring[now[0]] - self.radius, ring[now[-1]] + self.radius + 1])
            new = np.zeros(len(left), bool)
            for s in range(lo, hi, STEP):
                part = left[s : min(s + STEP, hi)]
                new[s : s + len(part)] = self.near(order[now], order[part]).any(0)
            if new.any():
                reached[left[new]] = True
                front += left[new].tolist()
                left = left[~new]
        return reached

    def roots(self) -> np.ndarray:
        """For each point the position of its component's smallest one."""
        root = np.arange(len(self.points))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.a, self.b))
        while True:
            new = root.copy()
            low = np.minimum(root[a], root[b])
            for side in (a, b):
                np.minimum.at(new, root[side], low)
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == root).all():
                return root
            root = new


def linked(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points (rows of uint64), the position of its component's representative."""
    found = Links(points, radius)
    found.tree()
    return found.roots()


def vantage_shards(points: np.ndarray, radius: int, shard: int) -> list[np.ndarray]:
    """Shards of a router that cuts by distance to vantage points alone, each boundary where both branches are most even: a point in the overlap goes to both."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        d = distances(points[at], points[at[0]])
        r = int(np.median(d)) + radius // 2
        inner, outer = at[d <= r], at[d > r - radius]
        if len(at) <= shard or max(len(inner), len(outer)) == len(at):
            out.append(at)
        else:
            todo += [inner, outer]
    return out


def links(prints: DataFrame, radius: int = 4, shard: int = 1024, chunk: int = 2048, most_chunks: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints prints(w0, ...) within `radius` bits, directly or over others.

    A hot shard is cut in up to most_chunks chunks; its size only decides in how many tasks it is compared.
    """
    own = sorted(c for c in prints.columns if c[0] == "w" and c[1:].isdigit())
    count = prints.count()
    masks = block_masks(count, radius, shard)
    part = lambda m: [F.col(w).bitwiseAND(F.lit(_signed(m >> BITS * k & (1 << BITS) - 1))) for k, w in enumerate(own)]
    key = lambda m: part(m)[0] if len(own) == 1 else F.xxhash64(*part(m))
    keyed = prints.select(*own, F.explode(F.array(*(F.struct(F.lit(t).alias("t"), key(m).alias("key")) for t, m in enumerate(masks)))).alias("s")).select(*own, "s.t", "s.key")
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > chunk).select("t", "key", F.least(F.lit(most_chunks), F.ceil(F.col("count") / chunk)).cast("int").alias("chunks"))
    dealt = keyed.join(hot, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*own), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunks = 1 or own <> other")
    dealt = dealt.select(*own, "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    a, b = names(len(own), "a"), names(len(own), "b")

    def star(x: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(np.stack([x[w].to_numpy() for w in own], 1).view(np.uint64), axis=0)
        to = linked(points, radius)
        moved = np.flatnonzero(to != np.arange(len(points)))
        ends = [points[at].view(np.int64).T for at in (moved, to[moved])]
        return pd.DataFrame({c: v for columns, values in zip((a, b), ends) for c, v in zip(columns, values)})

    found = dealt.groupBy("t", "key", "i", "j").applyInPandas(star, ", ".join(f"{c} long" for c in (*a, *b)))
    return found.select(node(a).alias("a"), node(b).alias("b"))


def needed(n: int, similarity: float) -> int:
    """So many of n shingles at least are shared by two texts at the similarity."""
    return math.ceil(similarity * n - 1e-9)


def frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Buckets of shingles (by the last bits of their hashes) that hold clearly more of all texts' shingles than others do: in them are the shingles of many texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for x in batches:
            for t in x["text"]:
                held.append(shingle_set(t, width) & np.uint64(BUCKETS - 1))
                size += len(held[-1])
                if size > 1 << 20:
                    n += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            n += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "n": n[at]})

    total = cut(texts.select("text").mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (total.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    return np.array(sorted(r.bucket for r in total.where(F.col("n") > mean + 8 * math.sqrt(mean) + 8).select("bucket").collect()), np.uint64)  # at most BUCKETS


def prefixes(texts: DataFrame, width: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(h, print, n) for the first shingles of each of texts(print, text), n its number of different ones: in the order of their hashes, those of the buckets `last` behind all others,
    so many that two texts at the similarity have one of them in common."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # of exact copies in a task one is enough
        for x in batches:
            found, of, sizes = [np.empty(0, np.uint64)], [], []
            for key, t in zip(x["print"].tolist(), x["text"]):
                if key in seen:
                    continue
                seen.add(key)
                own = shingle_set(t, width)
                if not len(own):
                    continue
                most = len(own) - needed(len(own), similarity) + 1
                late = np.isin(own & np.uint64(BUCKETS - 1), last)
                found.append(np.concatenate((own[~late], own[late]))[:most])
                of += [key] * most
                sizes += [len(own)] * most
            yield pd.DataFrame({"h": np.concatenate(found).view(np.int64), "print": np.array(of, np.int64), "n": np.array(sizes, np.int32)})

    return texts.select("print", "text").mapInPandas(firsts, "h long, print long, n int")


def met(h: np.ndarray, key: np.ndarray, n: np.ndarray, fp: np.ndarray, points: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Among rows that are sorted by h and key: edges (fp, fp) that connect what lies within the radius, and rows (a, b) of pairs of one h that these leave apart and whose sizes allow the similarity."""
    ends = np.flatnonzero(np.diff(h)) + 1
    edges, apart = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
    for s, e in zip([0, *ends.tolist()], [*ends.tolist(), len(h)]):
        if e - s < 2:
            continue
        root = linked(points[s:e], radius) if e - s > 2 else np.array([0, int(distances(points[s], points[s + 1]) > radius)])
        moved = np.flatnonzero(root != np.arange(e - s))
        edges.append(np.stack((fp[s + moved], fp[s + root[moved]]), 1))
        if (root == root[0]).all():
            continue
        for k in range(0, e - s, 256):
            i, j = np.arange(k, min(k + 256, e - s)), np.arange(k, e - s)
            low, high = np.minimum(n[s + i][:, None], n[s + j][None]), np.maximum(n[s + i][:, None], n[s + j][None])
            a, b = np.nonzero((i[:, None] < j[None]) & (root[i][:, None] != root[j][None]) & (low >= similarity * high - 1e-9))
            apart.append(np.stack((s + i[a], s + j[b]), 1))
    return np.unique(np.concatenate(edges), axis=0), np.concatenate(apart)


def copies(texts: DataFrame, prints: DataFrame, words: int, width: int, radius: int, similarity: float, chunk: int = 2048, most_chunks: int = 64, group: int = 20_000) -> DataFrame:
    """Edges (a, b) between the fingerprints fp of prints(print, w0, ..., fp) that connect, directly or over others, every two of texts(print, text) whose shingles have the Jaccard similarity.

    No such pair is lost. Two sets of n and m shingles at similarity s share s * n and s * m of them at least, so however all shingles are ordered, they share one of their first n - s * n + 1
    and m - s * m + 1. Texts meet at each of those (frequent shingles are ordered last, or many would meet). There fingerprints within the radius link, through vantage-point trees.
    A pair that these leave apart is counted at each shingle where it meets: both of its texts' shingles up to the nearer end of the two beginnings are known, so a pair at the similarity
    meets at as many as the rest can't make up for. Those that do are few, and their whole sets are compared. Which shingles are frequent decides in what order they come, and which pairs below the similarity meet too.
    """
    own = names(words)
    w = Window.partitionBy("h")
    rows = prefixes(texts, width, similarity, frequent(texts, width)).select("*", F.min("print").over(w).alias("low"), F.max("print").over(w).alias("high"))
    rows = cut(rows.where("low <> high").select("h", "print", "n"))
    of = cut(prints.select("print", "fp", *own).distinct())
    parts = -(-rows.count() // group)
    many = rows.groupBy("h").count().where(F.col("count") > chunk).select("h", F.least(F.lit(most_chunks), F.ceil(F.col("count") / chunk)).cast("int").alias("chunks"))
    dealt = rows.join(F.broadcast(many), "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunks = 1 or own <> other")
    dealt = dealt.select("h", "print", "n", F.pmod(F.xxhash64("h"), F.lit(max(1, parts))).alias("t"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["h", "print"]).sort_values(["h", "print"])
        key, n, fp = (x[c].to_numpy() for c in ("print", "n", "fp"))
        edges, apart = met(x["h"].to_numpy(), key, n, fp, np.stack([x[c].to_numpy() for c in own], 1).view(np.uint64), radius, similarity)
        open_ = pd.DataFrame({"a": key[apart[:, 0]], "b": key[apart[:, 1]], "na": n[apart[:, 0]], "nb": n[apart[:, 1]]}).value_counts().rename("times").reset_index()
        return pd.concat([pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1], "na": 0, "nb": 0, "times": 0}), open_])

    found = cut(dealt.join(of, "print").groupBy("t", "i", "j").applyInPandas(meet, "a long, b long, na int, nb int, times long"))
    edges = found.where("na = 0").select("a", "b")
    need = lambda n: F.ceil(similarity * n - 1e-9)
    both = F.ceil(similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = found.where("na > 0").groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"))
    pairs = cut(pairs.where(F.col("times") > both - F.greatest(need(F.col("na")), need(F.col("nb")))).select("a", "b", both.alias("both")))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct())
    count = wanted.count()
    if not count:
        return edges

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for x in batches:
            x = x[~x["print"].isin(seen)].drop_duplicates("print")
            seen.update(x["print"].tolist())
            yield pd.DataFrame({"print": x["print"], "x": [shingle_set(t, width).view(np.int64) for t in x["text"]]})

    few = F.broadcast(wanted) if count <= 1_000_000 else wanted
    sets = cut(texts.join(few, "print", "left_semi").select("print", "text").mapInPandas(whole, "print long, x array<long>").dropDuplicates(["print"]))
    side = lambda c: sets.select(F.col("print").alias(c), F.col("x").alias(f"{c}x"))
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("ax", "bx")) >= F.col("both")).select("a", "b")
    for c in "ab":
        alike = alike.join(of.select(F.col("print").alias(c), F.col("fp").alias(f"{c}fp")), c)
    return edges.unionByName(alike.select(F.col("afp").alias("a"), F.col("bfp").alias("b")))


def grouped(prints: DataFrame, words: int, radius: int, texts: DataFrame | None = None, width: int = 4, similarity: float | None = None) -> DataFrame:
    """prints(doc_id, w0, ..., fp, ...) with component_id (smallest doc_id) and root, which names the component even if no doc_id does."""
    nodes = cut(prints.groupBy("fp", *names(words)).agg(F.min("doc_id").alias("rep")))
    edges = links(nodes.select(*names(words)), radius) if similarity is None else copies(texts, prints, words, width, radius, similarity)
    roots = components(edges).withColumnRenamed("node", "fp")
    placed = cut(nodes.join(roots, "fp"))
    least = placed.groupBy("root").agg(F.min("rep").alias("low"))
    inside = join_hot(placed.select("fp", "root"), least, "root").select("fp", "low", "root")
    named = cut(nodes.join(inside, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return join_hot(prints, named, "fp")


def _print() -> Column:
    """A hash that tells texts apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), _print().alias("print"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, words: int = 1, similarity: float | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Fingerprints link within `radius` bits, or within those of a Jaccard similarity if one is given (see COPIES). Null, empty and blank texts have
    fingerprint zero and link like any other. Repeated doc_ids give repeated rows; a null doc_id is never a component_id unless the whole
    component has none. Other columns are ignored.
    """
    texts = _keyed(docs)
    prints = cut(fingerprints(texts, width, seed, words, *(["print"] if similarity else [])))
    found = grouped(prints, words, radius_of(similarity, BITS * words) if similarity else radius, texts, width, similarity)
    shown = F.concat(*(F.lower(F.lpad(F.hex(w), 16, "0")) for w in names(words)))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, words: int = 1, similarity: float | None = None) -> DataFrame:
    """The documents without near copies: of each component a row with the smallest doc_id stays, or with a null one if none has another.

    Rows of one doc_id with different texts are told apart by a hash of the text: each goes or stays with its own component, and of
    several in one component one stays. Columns of any name come through as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _print().alias("print"), F.struct("*").alias("doc"))
    texts = _keyed(docs)
    prints = cut(fingerprints(texts, width, seed, words, "print"))
    found = grouped(prints, words, radius_of(similarity, BITS * words) if similarity else radius, texts, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print"))
    kept = found.groupBy("root").agg(first.alias("first")).select("first.*")
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "none", "print")
    rows = rows.withColumns({"none": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    by = ["id", "none", "print"]  # texts are sent once for both
    return rows.join(kept, by, "left_semi").dropDuplicates(by).select("doc.*")
