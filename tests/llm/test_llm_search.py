"""Hard negatives, centroid clustering and fingerprint comparison against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataweave.llm import geometric_kmeans, rtree_negatives, simhash_tiles

DOCS = "doc_id long, text string, print long, component string, low int"
VECTORS = "vec_id long, embedding array<float>, label int, v string, tile int, cluster int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, "v", 1, 2) for i, e, label in rows], VECTORS)


# fingerprints

def plain_print(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    part = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    names = {}
    for p, i in zip(part, ids):
        if i is not None:
            names[p] = min(names.get(p, i), i)
    return [names.get(p) for p in part]


def near_rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[draw.choice(words) for _ in range(200)] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one two"), (None, "é ü Ñ z"), (None, "x y"), (5, "x Y"), (9, "q " * 30000)]
    for i in range(60):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 30])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((100 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize("radius,tile", [(3, 7), (0, 64), (9, 5)])
def test_simhash_against_all_pairs(spark, radius, tile):
    rows = near_rows()
    prints = [plain_print(t, 3) for _, t in rows]
    wanted = plain_components(prints, [i for i, _ in rows], radius)
    got = simhash_tiles.near_duplicates(docs(spark, rows), n=3, radius=radius, tile=tile)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    wanted = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, wanted)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    assert len({c for _, _, c in wanted}) < len({p for _, p, _ in wanted}) or radius == 0


def test_simhash_of_nothing(spark):
    assert simhash_tiles.near_duplicates(docs(spark, [])).collect() == []


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = simhash_tiles.fingerprint(text, 3)
    monkeypatch.setattr(simhash_tiles, "_HASHED", 64)
    assert simhash_tiles.fingerprint(text, 3) == whole == plain_print(text.decode(), 3)


def test_tile_pairs_far_apart_are_not_compared(spark):
    from strataweave.scratch import Scratch

    few = [(1 << i) - 1 for i in range(0, 64, 7)]  # population counts 0, 7, 14, ..
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in few], "print long")
    assert simhash_tiles.links(frame, 3, Scratch(spark, "t"), tile=1).collect() == []
    links = simhash_tiles.links(frame, 7, Scratch(spark, "t"), tile=1).collect()
    assert len(links) == len(few) - 1


def test_group_of_near_copies_gives_few_links():
    draw = np.random.default_rng(1)
    group = np.unique(np.uint64(0xF0F0F0F0) ^ (np.uint64(1) << draw.integers(0, 64, 5000, dtype=np.uint64)))
    many = np.concatenate([group, draw.integers(0, 1 << 63, 500, dtype=np.uint64)])
    found = simhash_tiles.joining_links(many, None, 3)
    assert len(group) - 1 <= len(found) < len(many)


# centroids

def plain_kmeans(rows, k, rounds, seed, dim):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    out = []
    for i, d, c in last:
        sha = hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
        out.append((i, c, d, sum(x for _, x, y in last if y == c), sum(x for _, x, _ in last), sha))
    return sorted(out, key=repr)


def clustered(spark, rows, dim, k=5, rounds=6):
    frame = vectors(spark, rows).where(F.size("embedding") == dim)
    grid = frame.select("vec_id", geometric_kmeans.grid(F.col("embedding"), 1024).alias("v"), "label").where("v IS NOT NULL")
    return geometric_kmeans.kmeans(grid, k, rounds, 3, dim)


def vector_rows(n, dim, seed=2):
    draw = random.Random(seed)
    spots = [[draw.uniform(-1, 1) for _ in range(dim)] for _ in range(7)]
    as_float = lambda x: float(np.float32(x))
    rows = [(i, [as_float(s + draw.gauss(0, 0.15)) for s in draw.choice(spots)], draw.randrange(3)) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(n, n + n // 2)]  # a third are one vector
    rows += [(7, rows[9][1], 0), (7, rows[7][1], 0), (None, rows[4][1], 1), (9001, None, 1), (9002, rows[1][1][:-1], 2),
             (9003, [float("nan")] + rows[1][1][1:], 1), (9004, [float("inf")] + rows[1][1][1:], 1),
             (9005, [None] + rows[1][1][1:], 1), (9006, [], 0), (9007, rows[2][1], None), (9100, rows[5][1], 2)]
    return rows


def test_kmeans_against_plain_rounds(spark):
    rows = vector_rows(120, 6)
    got = clustered(spark, rows, 6)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_kmeans(rows, 5, 6, 3, 6)


def test_kmeans_of_few_or_no_rows(spark):
    few = vector_rows(20, 6)[:2] + [(1, vector_rows(20, 6)[1][1], 0)]
    assert sorted(map(tuple, clustered(spark, few, 6).collect()), key=repr) == plain_kmeans(few, 5, 6, 3, 6)
    empty = clustered(spark, [], 6)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_components_out_of_range_are_held(spark):
    got = clustered(spark, [(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 1)], 2, k=1, rounds=0).collect()
    assert len(got) == 2 and max(r.distance for r in got) <= 2 * (1 << 28) ** 2


def test_bounds_fall_by_less_than_the_drift_and_by_enough():
    draw = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        k, dim = 4, int(draw.integers(1, 6))
        old = draw.normal(0, 50, (k, dim))
        new = old + draw.normal(0, 10, (k, dim))
        radius = draw.uniform(0, 60, k)
        fall = geometric_kmeans.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        for i in range(k):
            others = [j for j in range(k) if j != i]
            assert fall[i] <= max(drift[others]) + 1e-6
            less += fall[i] < 0.9 * max(drift[others])
            points = draw.normal(0, 1, (300, dim))
            points *= (radius[i] * draw.uniform(0, 1, (300, 1))) / np.linalg.norm(points, axis=1, keepdims=True)
            points += old[i]
            for j in others:
                real = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert real.max() <= fall[i] + 1e-6
    assert less > 100


def test_most_vectors_are_not_scanned():
    draw = np.random.default_rng(4)
    spots = draw.integers(-1000, 1000, (5, 8))
    points = (spots[draw.integers(0, 5, 2000)] + draw.integers(-60, 60, (2000, 8))).astype(np.int64)
    old = spots + 20
    cluster, upper, lower = geometric_kmeans.scan(points, old)
    radius = np.array([upper[cluster == c].max(initial=0) for c in range(5)])
    drift = np.linalg.norm(spots - old, axis=1)
    loosen = geometric_kmeans.loosening(old, spots, radius)
    got, up, low, scanned = geometric_kmeans.reassign(points, cluster, upper, lower, spots, drift, loosen)
    right, exact, rest = geometric_kmeans.scan(points, spots)
    assert (got == right).all() and (up >= exact - 1e-6).all() and (low <= rest + 1e-6).all()
    assert scanned < 200


# hard negatives

def plain_negatives(rows, every, p, n, low, high, dim):
    kept = [(i, label, [math.floor(256 * x) for x in e]) for i, e, label in rows
            if i is not None and label is not None and e is not None and len(e) == dim
            and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor % every:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, b) for b, (i, _, w) in enumerate(kept) if b != a]
        for s, i, b in sorted(t for t in score if kept[t[2]][1] == label)[:p]:
            fits = sorted(t[:2] for t in score if kept[t[2]][1] != label and low * -s <= 100 * -t[0] <= high * -s)
            out += [(anchor, i, rank, j, -s, -t) for rank, (t, j) in enumerate(fits[:n], 1)]
    return sorted(out)


def mined(spark, rows, every, **more):
    frame = vectors(spark, rows).select("vec_id", "label", geometric_kmeans.grid(F.col("embedding"), 256).alias("v"), "tile")
    return rtree_negatives.mine(frame, F.col("vec_id") % every == 0, **more)


@pytest.mark.parametrize("tile,leaf,block", [(16, 4, 3), (1024, 64, 1024)])
def test_negatives_against_all_pairs(spark, tile, leaf, block):
    rows = vector_rows(150, 6)
    got = mined(spark, rows, 10, tile=tile, leaf=leaf, block=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10, 5, 5, 80, 100, 6)


def test_negatives_with_other_windows(spark):
    rows = vector_rows(60, 3, seed=8)
    got = mined(spark, rows, 4, positives=2, negatives=3, low=10, high=95, tile=8, leaf=2, block=5)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 4, 2, 3, 10, 95, 3)


def test_negatives_of_nothing(spark):
    assert mined(spark, [], 1).collect() == []
    assert mined(spark, [(1, None, 1), (2, [], 0)], 1).collect() == []
    alone = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)]
    assert mined(spark, alone, 1).collect() == []
    assert mined(spark, alone, 1000).collect() == []


def test_far_boxes_are_not_opened():
    draw = np.random.default_rng(6)
    values = (draw.integers(-900, 900, (12, 4))[draw.integers(0, 12, 4000)] + draw.integers(-9, 9, (4000, 4))).astype(np.int32)
    values = values[rtree_negatives.packed(values, 64)]
    anchors = pa.table({
        "anchor": [0, 1], "label": [0, 0], "own_tile": [9, 9], "place": [0, 0], "v": [values[5].tolist(), values[999].tolist()],
        "windows": [[{"low": float("-inf"), "high": float("inf")}]] * 2,
    })
    found = rtree_negatives.Search(anchors, True, 5, 64)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 16001, 4), pa.int32()), pa.array(values.ravel()))
    found.take(0, pa.table({
        "place": pa.array(np.arange(4000)), "vec_id": pa.array(np.arange(4000)), "label": pa.array(np.zeros(4000, np.int64)), "v": flat}))
    for i, row in enumerate((5, 999)):
        scores = values.astype(np.int64) @ values[row].astype(np.int64)
        wanted = sorted(zip((-scores).tolist(), range(4000)))[:5]
        assert sorted((-s, -i) for s, i, _, _ in found.best[i]) == wanted
    assert found.opened < 2 * 63 / 3


def test_leaves_are_a_packing():
    values = np.random.default_rng(7).integers(-50, 50, (1000, 5))
    order = rtree_negatives.packed(values, 32)
    assert sorted(order.tolist()) == list(range(1000))
