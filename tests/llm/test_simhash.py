import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkwarden.llm import simhash
from sparkwarden.llm.common import join_hot
from tests.llm.data import docs, odd


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    """Smallest reachable id by plain search: fps {id: fingerprint}."""
    ids, out = sorted(fps), {}
    for i in ids:
        if i in out:
            continue
        front, out[i] = [i], i
        while front:
            k = front.pop()
            for j in ids:
                if j not in out and (fps[k] ^ fps[j]).bit_count() <= radius:
                    out[j] = i
                    front.append(j)
    return out


def test_matches_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r.doc_id: fingerprint(r.text) for r in table.collect()}
    got = simhash.near_duplicates(table).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == classes(fps)


def test_shards_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(centre)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                centre ^= 1 << b
    dense = rng.getrandbits(64)
    fps |= {dense ^ 1 << a ^ 1 << b for a in range(20) for b in range(64)}
    fps = dict(enumerate(sorted(fps)))
    want = classes(fps)
    signed = {i: int(np.uint64(v).astype(np.int64)) for i, v in fps.items()}
    df = spark.createDataFrame([(v,) for v in signed.values()], "w0 long")
    for shard, chunk in ((4, 16), (64, 50), (1024, 300)):
        edges = simhash.links(df, shard=shard, chunk=chunk)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        groups = {}
        for i, v in signed.items():
            groups.setdefault(roots.get(v, v), []).append(i)
        assert {i: min(g) for g in groups.values() for i in g} == want


def tree_points(rng, words=1):
    """Random points, chains and dense groups, as distinct rows of uint64."""
    points = {rng.getrandbits(64 * words) for _ in range(700)}
    for size in (3, 40, 600):
        at = rng.getrandbits(64 * words)
        for _ in range(size):
            points.add(at)
            for b in rng.sample(range(64 * words), rng.randint(1, 3)):
                at ^= 1 << b
    centre = rng.getrandbits(64 * words)
    points |= {centre ^ 1 << a ^ 1 << b for a in range(8) for b in range(64)}
    rows = sorted(points)
    rng.shuffle(rows)
    return rows, np.array([[v >> 64 * k & 2**64 - 1 for k in range(words)] for v in rows], np.uint64)


def test_trees_find_all_components():
    for seed, words, radius in ((1, 1, 4), (2, 1, 2), (3, 2, 9), (4, 1, 0)):
        rows, points = tree_points(random.Random(seed), words)
        want = classes(dict(enumerate(rows)), radius)
        assert {k: int(r) for k, r in enumerate(simhash.linked(points, radius))} == want


def test_a_tree_cuts_where_it_saves_work():
    """Clusters far apart fall into branches; random points do not."""
    rng = random.Random(8)
    clusters = np.array([[c ^ 1 << a ^ 1 << b] for c in (rng.getrandbits(64) for _ in range(12)) for a in range(10) for b in range(20, 40)], np.uint64)
    found = simhash.Links(np.unique(clusters, axis=0), 4)
    found.tree()
    n = len(found.points)
    assert found.compared < 0.3 * n * n / 2
    loose = np.array([[rng.getrandbits(64)] for _ in range(2000)], np.uint64)
    assert simhash.boundary(simhash.distances(loose, loose[0]), 4) is None


def test_vantage_shards_lose_no_pair():
    rows, points = tree_points(random.Random(9))
    shards = simhash.vantage_shards(points, 4, 200)
    assert set(np.concatenate(shards).tolist()) == set(range(len(rows)))
    together = [set(s.tolist()) for s in shards]
    near = np.argwhere(np.triu(simhash.distances(points[:, None], points[None]) <= 4, 1))
    assert all(any(i in s and j in s for s in together) for i, j in near.tolist())


def test_near_copies_by_similarity(spark):
    """Copies with a few words changed are found from a similarity of 0.8; texts that share half of their shingles or less are left alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, pairs = [], []
    for k in range(400):
        text = [word() for _ in range(rng.randint(80, 300))]
        other = list(text)
        for at in rng.sample(range(len(text)), rng.randint(0, max(1, len(text) // rng.choice([8, 20, 40])))):
            other[at] = word()
        a, b = shingles(text), shingles(other)
        pairs.append((2 * k, 2 * k + 1, len(a & b) / len(a | b)))
        rows += [(2 * k, " ".join(text), "a"), (2 * k + 1, " ".join(other), "a")]
    for k in range(100):  # half of the text is a passage that another text holds too
        passage = [word() for _ in range(60)]
        for j in (0, 1):
            rows.append((1000 + 2 * k + j, " ".join([word() for _ in range(45)] + passage + [word() for _ in range(45)]), "a"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), **simhash.COPIES).collect()}
    found = lambda lo, hi: np.mean([got[a] == got[b] for a, b, s in pairs if lo <= s < hi])
    assert found(0.8, 0.85) > 0.9 and found(0.85, 0.9) > 0.97 and found(0.9, 1.01) > 0.98
    assert found(0, 0.6) < 0.02 and found(0, 0.7) < 0.1
    assert all(got[i] == i for i, _, _ in rows if i >= 1000)
    assert len({got[i] for i, _, _ in rows}) == len({min(i, got[i]) for i, _, _ in rows})


def test_short_texts_by_similarity():
    """Between 0.8 and 0.85 as good as all copies link, in texts of twenty words as in long ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    prints = lambda t: simhash.text_fingerprint(" ".join(t), 5, 42, simhash.COPIES["words"])
    radius, near = simhash.radius_of(0.8, 64 * simhash.COPIES["words"]), []
    while len(near) < 150:
        text = [word() for _ in range(rng.choice([25, 60, 200]))]
        other = list(text)
        for at in rng.sample(range(len(text)), max(1, len(text) // 40)):
            other[at] = word()
        a, b = shingles(text), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            near.append(int(np.bitwise_count(prints(text) ^ prints(other)).sum()) <= radius)
        elif len(text) == 25:  # a change at the end touches fewer shingles
            other = text[:-1] + [word()] if rng.random() < 0.5 else text + [word(), word()]
            a, b = shingles(text), shingles(other)
            if 0.8 <= len(a & b) / len(a | b):
                near.append(int(np.bitwise_count(prints(text) ^ prints(other)).sum()) <= radius)
    assert np.mean(near) > 0.95


def test_sampled_masks_bring_pairs_together():
    rng = random.Random(4)
    for count in (5_000, 10**6):
        masks = simhash.sampled_masks(count, 128, 0.8)
        p = simhash.differing(0.8)
        met = 0
        for _ in range(400):
            diff = sum(1 << b for b in range(128) if rng.random() < p)
            met += any(not diff & m for m in masks)
        assert met > 0.93 * 400


def test_one_row_of_each_group_stays(spark):
    """Rows of one id with different texts each follow their own component; identical rows become one."""
    a, b = "one two three four five six seven eight", "other words make up this second text here"
    rows = [(5, a, "a"), (5, b, "a"), (5, b, "a"), (3, a, "b"), (None, a, "c"), (None, a, "c"), (9, None, "a"), (8, "", "a")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs(spark, rows), **simhash.COPIES).collect())
    assert kept == [(False, 3, a), (False, 5, b), (False, 8, "")]
    nulls = [(None, a, "c"), (None, a, "c"), (None, b, "c"), (None, a + " nine", "d"), (None, "", "c"), (None, None, "c"), (7, b, "x")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs(spark, nulls)).collect())
    assert [k[:2] for k in kept] == [(False, 7), (True, 0), (True, 0), (True, 0)] and [k[2] for k in kept if k[0]][0] == ""


def test_masks_cover_every_choice_of_differing_bits():
    rng = random.Random(1)
    for count in (10, 5_000, 10**6, 10**8, 10**11):
        masks = simhash.block_masks(count, 4)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 10
    blank = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert blank == {2}
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    kept = simhash.keep_one(odd(spark))
    assert kept.columns[0] == "doc_id" and [r.doc_id for r in kept.collect()].count(1) == 1


def test_hot_keys_join_apart(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, 8).when(F.col("id") % 50 != 2, F.col("id")).alias("k"), "id")
    named = spark.range(0, 3000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("name"))
    for how in ("inner", "left"):
        got, plain = join_hot(rows, named, "k", how), rows.join(named, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        assert "Union" in got._jdf.queryExecution().analyzed().toString()
    assert join_hot(rows.where("k > 8"), named, "k").count() == rows.where("k > 8").join(named, "k").count()
    assert join_hot(rows.limit(0), named, "k").count() == 0


def test_no_near_copy_is_lost(spark):
    """Every two texts at the similarity link, among so many that they are not all compared; a passage that hundreds share neither hides copies nor makes them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} or {tuple(t)}
    passage, rows, pairs = [word() for _ in range(60)], [], []
    while len(pairs) < 2_000:
        text = [word() for _ in range(rng.choice([3, 24, 50, 120]))]
        at = rng.randrange(len(text))
        other = rng.choice([text[:at] + [word()] + text[at + 1 :], text + [word(), word()], text[:at] + text[at + 2 :], text])
        if rng.random() < 0.1:
            text, other = passage + text, passage + other
        a, b = shingles(text), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.86 or text == other:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            rows += [(pairs[-1][0], " ".join(text), "a"), (pairs[-1][1], " ".join(other).upper(), "a")]
    alike = [(10_000 + k, " ".join([*passage, word(), word()]), "a") for k in range(300)]  # of each other
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows + alike), **simhash.COPIES).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert len({got[i] for i, _, _ in alike}) == 1
    assert sum(got[a] == a for a, _ in pairs) > 1_700  # pairs don't run into one another
