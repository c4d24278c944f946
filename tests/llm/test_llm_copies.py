"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataweave.llm import block_naming, debruijn, odd_sketch
from strataweave.llm.components import components
from strataweave.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def words(text):
    return (text or "").encode().split()


EDGES = [
    (1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "a"), (6, "A b c"), (None, "a b c d e f"), (7, "a b c d e f"),
    (8, "x " * 9000), (9, "x " * 9000 + "y"), (10, "é ü ñ z   q"), (11, "é ü ñ z   q"), (4, "a"),
]


@pytest.mark.parametrize("size", [3, 2048])
def test_exact_groups(spark, size):
    got = block_naming.exact_groups(docs(spark, EDGES), size).collect()
    assert len(got) == len(EDGES)
    by_text = {}
    for i, t in EDGES:
        by_text.setdefault(t or "", []).append(i)
    for r in got:
        group = next(g for t, g in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group)
        assert r.keep_id == max((i for i in group if i is not None), default=None)
    for t, group in by_text.items():  # one row stays, repeated rows or not
        sha = hashlib.sha256(t.encode()).hexdigest()
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_names_when_hashes_collide(spark, monkeypatch):
    real = block_naming.F.xxhash64
    monkeypatch.setattr(block_naming.F, "xxhash64", lambda c: block_naming.F.length(c).cast("long"))
    rows = [(i, t) for i, t in enumerate(["abc", "abd", "abc", "abcabd", "abdabc", "abcabd", "ab", ""])]
    got = {r.doc_id: r.keep_id for r in block_naming.exact_groups(docs(spark, rows), 3).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 5, 4: 4, 5: 5, 6: 6, 7: 7}
    assert real is not block_naming.F.xxhash64


def test_drop_exact_copies(spark):
    frame = docs(spark, EDGES).selectExpr("*", "1 AS row", "2 AS name", "3 AS keep_id")
    left = block_naming.drop_exact_copies(frame, 4)
    assert left.columns == frame.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in EDGES})
    empty = spark.createDataFrame([], DOCS)
    assert block_naming.exact_groups(empty).collect() == [] and block_naming.drop_exact_copies(empty).collect() == []


def near_truth(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n, 0) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for length in (12, 30, 60, 120, 400):
        base = random.choices(vocabulary, k=length)
        for copy in range(9):
            text = list(base)
            for _ in range(copy * length // 150):
                text[random.randrange(length)] = random.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "One two"), (n + 3, "one  TWO"), (n + 4, "K one two")]
    return rows


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_near_duplicates(spark, block):
    rows = near_rows()
    got = odd_sketch.near_duplicates(docs(spark, rows), 4, 80, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_truth(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_edges(spark):
    got = odd_sketch.near_duplicates(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {(r.doc_id): r for r in got}
    assert by[1].kept and by[2].kept and by[1].n_shingles == 0
    assert by[4].component_id == 4 and by[5].component_id == 4 and by[None].component_id == 7
    assert by[9].component_id == 9  # two shingles against one: the sets decide
    assert odd_sketch.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    frame = docs(spark, EDGES).selectExpr("*", "1 AS id", "2 AS bucket")
    left = odd_sketch.drop_near_copies(frame)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}


def test_near_copies_without_ids_or_with_repeated_ids(spark):
    """A near copy takes no other row with it that has no id or the same id; null ids are linked as well."""
    base = [f"w{i}" for i in range(60)]
    alone = [f"x{i}" for i in range(60)]
    text, near, lone, close = " ".join(base), " ".join([*base, "end"]), " ".join(alone), " ".join([*alone, "end"])
    rows = [(5, text), (None, near), (None, "a clean row of its own"), (None, "another clean row"),
            (8, near), (8, "clean with a repeated id"), (None, lone), (None, close), (None, None)]
    frame = docs(spark, rows).withColumn("position", F.lit(1)).repartition(3)
    got = odd_sketch.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("5", "5", True), ("None", "5", False), ("8", "5", False), ("8", "8", True)]
        + [("None", "None", True)] * 4 + [("None", "None", False)]
    )
    left = odd_sketch.drop_near_copies(frame)
    assert left.columns == frame.columns
    texts = sorted(str(r.text) for r in left.collect())
    assert len(texts) == 6 and (lone in texts) != (close in texts)
    assert set(texts) - {lone, close} == {text, "a clean row of its own", "another clean row", "clean with a repeated id", "None"}


def test_most_bits_is_loose_enough():
    import numpy as np

    random_ = np.random.default_rng(1)
    base = random_.integers(0, 1 << 32, (4000, odd_sketch.SAMPLES), dtype=np.uint32)
    other = base.copy()
    differ = random_.random(base.shape) < 0.2
    other[differ] = random_.integers(0, 1 << 32, int(differ.sum()), dtype=np.uint32)
    bits = np.bitwise_count(odd_sketch.odd_sketches(base) ^ odd_sketch.odd_sketches(other)).sum(axis=1)
    assert bits.max() <= odd_sketch.most_bits(80)


def test_components(spark):
    random.seed(5)
    pairs = [(i, i + 1) for i in range(300)] + [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(250)]
    pairs += [(5000, i) for i in range(4000, 4400)] + [(7, 7), (9999, 9999)]
    frame = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")
    got = {r.id: r.component for r in components(frame, Scratch(spark, "test")).collect()}
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(want[a], want[b])
            if (want[a], want[b]) != (low, low):
                want[a] = want[b] = low
                moved = True
    assert got == want


def repeats_truth(rows, k):
    seen, gone = set(), {}
    out = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone[i] = set()
        for at in range(len(w) - k + 1):
            window = tuple(w[at : at + k])
            if window in seen:
                gone[i] |= set(range(at, at + k))
            seen.add(window)
        out[i] = (len(w), len(gone[i]), b" ".join(x for j, x in enumerate(w) if j not in gone[i]).decode())
    return out


def passage_rows():
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(30)]
    shared = [random.choices(vocabulary, k=n) for n in (6, 9, 25)]
    rows = []
    for i in range(40):
        text = random.choices(vocabulary, k=random.randrange(0, 30))
        for passage in shared:
            if random.random() < 0.5:
                at = random.randrange(len(text) + 1)
                text[at:at] = passage[: random.randrange(4, len(passage) + 1)]
        rows.append((i, "  ".join(text)))
    rows += [(50, "a " * 60), (51, "a b " * 30), (52, "a b " * 31), (53, None), (54, ""), (None, "a " * 70), (55, rows[5][1])]
    return rows


@pytest.mark.parametrize("k,m", [(5, 2), (6, 3), (20, 5)])
def test_remove_repeats(spark, k, m):
    rows = passage_rows()
    got = debruijn.remove_repeats(docs(spark, rows).repartition(3), k, m).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == repeats_truth(rows, k)
    texts = {i: words(t) for i, t in rows}
    for r in got:  # spans point at equal words that start earlier
        for s in r.spans:
            n = s.last - s.first
            assert texts[r.doc_id][s.first : s.last] == texts[s.source_id][s.at : s.at + n]


def test_remove_repeats_edges(spark):
    assert debruijn.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (2, "p q r s t u"), (3, None)]
    got = sorted((r.doc_id, r.n_removed) for r in debruijn.remove_repeats(docs(spark, rows), 4, 2).collect())
    assert got == [(1, 0), (1, 0), (2, 6), (3, 0)]


def test_remove_repeats_of_rows_without_an_id_or_with_repeated_ids(spark):
    """Every text loses its own repeats only, and a passage at the same place of another one is a repeat."""
    rows = [(None, "a b c d e f x1 x2 x3 x4"), (None, "a b c d e f y1 y2 y3 y4"), (None, "z1 z2 z3 z4 z5 z6 z7 z8"),
            (3, "a b c d e f"), (3, "q1 q2 q3 q4 q5 q6"), (2, "q1 q2 q3 q4 q5 q6 q7")]
    got = debruijn.remove_repeats(docs(spark, rows).coalesce(1), 4, 2).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept_text) for r in got) == sorted([
        ("None", 10, rows[0][1]), ("None", 10, "y1 y2 y3 y4"), ("None", 8, rows[2][1]), ("3", 6, ""), ("3", 6, ""), ("2", 7, rows[5][1]),
    ])
    assert {s.source_id for r in got for s in r.spans} == {None, 2}


def test_long_text_is_cut_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    long = rows.withColumn("text", F.concat(F.repeat(F.lit("abcdefg "), 8 << 20), "text"))  # 64 MB each
    got = {r.doc_id: (r.group_size, r.kept) for r in block_naming.exact_groups(long.unionByName(long.where("doc_id = 2").withColumn("doc_id", F.lit(3)))).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (2, True)}


def test_texts_that_are_not_utf8_stay_apart(spark):
    rows = spark.createDataFrame([(1, b"a\xff"), (2, b"a\xfe"), (3, b"a\xff"), (4, b"61FF"), (5, b"")], "doc_id long, text binary")
    got = block_naming.exact_groups(rows.withColumn("text", F.col("text").cast("string")), 2)
    assert {r.doc_id: r.keep_id for r in got.collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


HELPERS = ["row", "_sha", "_id", "_keep", "_their", "_tag", "_none", "_known", "_digest", "position", "gone", "_gone", "_salt",
           "_key", "_hash", "_base", "_cut", "name", "parts", "keep", "part", "slab", "_own_row", "_position", "ROW", "_slice"]


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, None, 3, 3]])
def test_helper_columns_never_touch_the_callers(spark, ids):
    from strataweave.llm import mixing, template_leaks

    texts = ["one two three four five six", "a b c d e f g h", "one two three four five six", "q r s t u v w x"]
    columns = [c for c in HELPERS if c.lower() not in {x.lower() for x in HELPERS[: HELPERS.index(c)]}]
    frame = spark.createDataFrame(list(zip(ids, texts, ["s"] * 4)), "doc_id long, text string, source string")
    for number, c in enumerate(columns):
        frame = frame.withColumn(c, F.concat(F.lit(f"{number}-"), "text"))
    items = spark.createDataFrame([(1, "nothing of this kind is said in any text")], "item_id long, text string")
    for run in (
        block_naming.drop_exact_copies, odd_sketch.drop_near_copies, lambda d: template_leaks.drop_leaks(d, items), mixing.mix
    ):
        got = run(frame)
        assert got.columns[: len(frame.columns)] == frame.columns
        rows = got.collect()
        assert rows
        for r in rows:
            for number, c in enumerate(columns):
                assert r[c] == f"{number}-{r.text}", (run, c)
