"""Language, severity and language-model scores: exact recursions, held-out rows, brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import crf_language, cross_entropy, ordinal_toxicity

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_forward_backward_is_exact():
    random = np.random.default_rng(2)
    emission, pair = random.random((9, 3)) + 0.05, random.random((3, 3)) + 0.05
    bounds = np.array([0, 5, 5, 9])
    got, pairs = crf_language.forward_backward(emission, bounds, pair, chunk=99)
    want, joint = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in zip(bounds, bounds[1:]):
        total = 0.0
        own, jown = np.zeros((9, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            if not path:
                continue
            p = pair[:, path[0]].sum() * emission[a, path[0]]
            for t in range(1, len(path)):
                p *= pair[path[t - 1], path[t]] * emission[a + t, path[t]]
            total += p
            for t, y in enumerate(path):
                own[a + t, y] += p
                if t:
                    jown[path[t - 1], y] += p
        if total:
            want += own / total
            joint += jown / total
    assert np.allclose(got, want) and np.allclose(pairs, joint)
    for chunk in (1, 2, 3, 4):  # the chain of chunks changes nothing
        assert np.allclose(crf_language.forward_backward(emission, bounds, pair, chunk)[0], want)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = crf_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.select("lang_pred", "lang", "score", crf_language.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in rows if r.h]
    assert len(rows) == docs.count() and len(held) > 150
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_of_switched_text_and_edges(spark):
    en, de = "the cat and the dog with this house", "der hund und die katze mit dem haus"
    train = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(100, 160)]
    edges = [(1, None), (2, ""), (3, "12 34 !?"), (4, " ".join([en] * 40 + [de] * 10)), (None, en), (5, "¿ ¡ €"), (6, "der"),
             (7, "the " * 30000), (4, en)]
    rows = [(i, t, lang, "s", 0) for i, t, lang in train] + [(i, t, None, "s", 0) for i, t in edges]
    got = crf_language.identify(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id < 100}
    for i in (1, 2, 3, 5):
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert by[6].lang_pred == "de" and by[7].lang_pred == "en" and by[None].lang_pred == "en"
    switched = next(r for r in got if r.doc_id == 4 and len(r.spans) > 1)
    assert [s.lang for s in switched.spans] == ["en", "de"] and switched.spans[1].first == 320
    assert switched.lang_pred == "en"
    nothing = spark.createDataFrame([(1, "a b", None, "s", 0)], DOCS)
    assert [(r.lang_pred, r.score) for r in crf_language.identify(nothing).collect()] == [("und", 0.0)]
    assert crf_language.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_language_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", F.when(crf_language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in crf_language.identify(docs, rows=20).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in crf_language.identify(wrong, rows=20).collect()}
    assert a == b


def test_severity_on_rows_not_trained_on(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang = 'en'")
    train, test = known.where("doc_id % 3 > 0"), known.where("doc_id % 3 = 0")
    model = ordinal_toxicity.fit(docs, train.select("doc_id", "toxic"))
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    rows = ordinal_toxicity.score(test, model).select("toxic", "p_toxic", "severity").collect()
    assert sum((r.p_toxic >= 0.5) == bool(r.toxic) for r in rows) / len(rows) > 0.97
    assert all(r.p_toxic <= r.severity <= 2 for r in rows)
    small = ordinal_toxicity.fit(docs, train.select("doc_id", "toxic"), rows=5)
    assert len(small.keys) <= ordinal_toxicity.FEATURES


def test_severity_orders_grades():
    grades = np.tile([0, 1, 2], 100)
    rows = np.concatenate([np.flatnonzero(grades >= 1), np.flatnonzero(grades >= 2)])
    columns = np.concatenate([np.zeros(200, int), np.ones(100, int)])
    w, t = ordinal_toxicity._sparse_fit(rows, columns, grades, 2, 2)
    assert w[0] > 0 and w[1] > 0 and t[0] < t[1]
    p = 1 / (1 + np.exp(-(np.array([0, w[0], w[0] + w[1]])[:, None] - t)))
    assert np.array_equal(np.round(p.sum(axis=1)), [0, 1, 2])


def test_severity_edges(spark):
    docs = spark.createDataFrame(
        [(i, "you idiot" if i % 2 else "kind words", "en", "s", 0) for i in range(40)]
        + [(100, None, None, None, None), (101, "", None, None, None), (None, "idiot!!", None, None, None),
           (102, "kind " * 40000 + "(Idiot)", None, None, None), (3, "kind", "en", "s", 0)],
        DOCS,
    ).withColumn("severity", F.lit("mine"))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(None, 1), (7, None), (8, 5), (9, 1)], "doc_id long, toxic int"
    )
    model = ordinal_toxicity.fit(docs, labels)
    got = ordinal_toxicity.score(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "severity"], "severity", "p_toxic"]
    rows = got.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.p_toxic for r in rows if r.doc_id != 3}
    assert by[102] > 0.5 and by[None] > 0.5 and by[100] < 0.5 and by[100] == by[101] and by[0] < 0.5 < by[1]
    assert [r.p_toxic for r in ordinal_toxicity.score(docs, ordinal_toxicity.fit(docs, labels.limit(0))).collect()] == [0.0] * len(rows)
    none = docs.limit(0)
    assert ordinal_toxicity.score(none, ordinal_toxicity.fit(none, labels)).collect() == []


def brute_scores(rows, marked, size):
    split = [(i, [w.lower() for w in (t or "").encode().split()]) for i, t in rows]
    counts = Counter(w for _, ws in split for w in ws)
    vocabulary = [w for w, _ in counts.most_common(size - 2)]
    of = {w: n + 2 for n, w in enumerate(vocabulary)}
    models = []
    for only in (marked, None):
        pairs, given, single = Counter(), Counter(), Counter()
        for i, ws in split:
            if only is not None and i not in only:
                continue
            before = 0
            for w in ws:
                now = of.get(w, 1)
                pairs[before, now] += 1
                given[before] += 1
                single[now] += 1
                before = now
        models.append((pairs, given, single, sum(single.values())))

    def loss(model, a, b):
        pairs, given, single, total = model
        unigram = (single[b] + 1) / (total - 1 + size)
        return -math.log((pairs[a, b] + cross_entropy.PULL * unigram) / (given[a] + cross_entropy.PULL))

    out = {}
    for i, ws in split:
        ids = [of.get(w, 1) for w in ws]
        each = [sum(loss(m, a, b) for a, b in zip([0, *ids], ids)) for m in models]
        out[i] = (len(ids), *([x / len(ids) for x in each] if ids else [None, None]))
    return out


def test_cross_entropy_against_brute_force(spark):
    base = ["a a a a b b b c c d", "a b A B a b", "c c a d z", "b a a c", "q r s a a b"]
    rows = [(i, t) for i, t in enumerate(base)] + [(9, None), (10, ""), (11, "a " * 50000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("mark", F.lit(1)).repartition(3)
    targets = spark.createDataFrame([(0,), (2,), (2,), (None,), (77,)], "doc_id long")
    small = cross_entropy.score(docs, targets, size=6, chunk_bytes=20_000)  # the long text is a chunk
    got = {r.doc_id: r for r in small.collect()}
    want = brute_scores(rows, {0, 2}, 6)
    assert got.keys() == want.keys()
    for i, (n, target, background) in want.items():
        assert got[i].n_tokens == n
        if not n:
            assert got[i].score is None and got[i].target_loss is None
            continue
        assert got[i].target_loss == pytest.approx(target, rel=1e-4)
        assert got[i].background_loss == pytest.approx(background, rel=1e-4)
        assert got[i].score == pytest.approx(target - background, abs=1e-4)
    assert cross_entropy.score(docs.limit(0), targets).collect() == []
    assert len(cross_entropy.score(docs, targets.limit(0)).collect()) == len(rows)


def test_cross_entropy_counts_every_word(spark):
    """Words beyond the thousand most frequent tell target from background."""
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{i % 40}x{j} common{j}" for j in range(60))) for i in range(160)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    marked = {i for i, _ in rows if i % 2 and i < 120}
    got = {r.doc_id: r for r in cross_entropy.score(docs, spark.createDataFrame([(i,) for i in marked], "doc_id long")).collect()}
    every = len({w for _, t in rows for w in t.split()})
    assert every > 2000
    want = brute_scores(rows, marked, every + 1)  # the other token stands for one word only
    for i, (n, target, background) in want.items():
        assert got[i].n_tokens == n
        assert got[i].target_loss == pytest.approx(target, rel=1e-9)
        assert got[i].background_loss == pytest.approx(background, rel=1e-9)
    assert max(got[i].score for i, _ in rows if i % 2) < min(got[i].score for i, _ in rows if not i % 2)


def test_samples_are_bounded_by_rows(spark):
    """Ten thousand rows under one id do not reach the driver."""
    rows = spark.range(10_000).selectExpr(
        "1L AS doc_id", "concat('word', id, ' and more') AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    docs = rows.unionByName(rows.selectExpr("2L AS doc_id", "concat('idiot ', text) AS text", "'de' AS lang", "source", "n_chars"))
    same = docs.unionByName(docs.where("text = 'word7 and more'").crossJoin(spark.range(500).select()))
    taken = crf_language.sample(same, rows=5)
    assert taken.count() == 10 and {r.lang for r in taken.collect()} == {"en", "de"}
    long = spark.createDataFrame([(5, "w " * 40_000, "fr", "s", 0), (6, "le chat", "fr", "s", 0)], DOCS)
    assert [r.text for r in crf_language.sample(long, rows=5).collect()] == ["le chat"]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    real = ordinal_toxicity._sparse_fit
    try:
        ordinal_toxicity._sparse_fit = lambda rows, columns, grades, *more: seen.append(len(grades)) or real(rows, columns, grades, *more)
        ordinal_toxicity.fit(same, labels, rows=5)
    finally:
        ordinal_toxicity._sparse_fit = real
    assert all(n <= 10 for n in seen)


def test_severity_against_brute_force(spark):
    """Features, shared weights and thresholds in plain Python, text by text."""
    docs = [(1, "You Idiot! idiotic, calm; calmly"), (2, None), (3, ""), (4, "calm days"), (5, "IDIOTS-and-idiots 123 über"), (5, "x")]
    words = ["idiot", "calm", "über", "and"]

    def key(word, n):
        found, _ = ordinal_toxicity._word_features([word.encode()])
        return int(found[0 if n is None else 1 + (n == 5)])

    weights = {key("idiot", None): 1.5, key("idiotic", 5): 0.75, key("calmly", 4): 0.5, key("über", None): 2.0, key("and", None): 0.25}
    order = sorted(weights)
    model = ordinal_toxicity.Model(np.array(order, np.uint64), np.array([weights[k] for k in order]), np.array([1.0, 2.5]))

    def plain(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        keys = set()
        for w in low:
            size = len(w.encode())
            keys |= {key(w, None)} | {key(w, n) for n in (4, 5) if size > n}
        score = sum(weights.get(k, 0.0) for k in keys)
        p = [1 / (1 + math.exp(t - score)) for t in (1.0, 2.5)]
        return sum(p), p[0]

    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    got = ordinal_toxicity.score(frame, model).select("doc_id", "text", "severity", "p_toxic").collect()
    assert len(got) == len(docs) and len(words) == 4
    for r in got:
        severity, toxic = plain(r.text)
        assert r.severity == pytest.approx(severity, rel=1e-12) and r.p_toxic == pytest.approx(toxic, rel=1e-12)


def test_ordinal_fit_is_near_the_best_likelihood():
    """No step along a weight or a threshold lowers the penalised loss by much."""
    random = np.random.default_rng(3)
    rows = np.repeat(np.arange(300), 3)
    columns = random.integers(0, 8, 900)
    pairs = np.unique(np.stack([rows, columns], axis=1), axis=0)
    rows, columns = pairs[:, 0], pairs[:, 1]
    truth = np.array([2.0, 1.0, 0, 0, 0.5, 0, 0, 1.5])
    score = np.bincount(rows, weights=truth[columns], minlength=300) + random.logistic(size=300)
    grades = (score > 1.5).astype(int) + (score > 3)

    def loss(w, t):
        z = np.bincount(rows, weights=w[columns], minlength=300)
        up = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(t[None, :] - z[:, None])), np.zeros((300, 1))], axis=1)
        p = up[np.arange(300), grades] - up[np.arange(300), grades + 1]
        return -np.log(p).sum() + 0.05 * w.sum()

    w, t = ordinal_toxicity._sparse_fit(rows, columns, grades, 8, 2, 0.05, 4000)
    best = loss(w, t)
    for i in range(8):
        for d in (-0.05, 0.05):
            other = w.copy()
            other[i] = max(0.0, other[i] + d)
            assert loss(other, t) > best - 0.3
    for j in range(2):
        for d in (-0.05, 0.05):
            moved = t.copy()
            moved[j] += d
            assert loss(w, moved) > best - 0.3
