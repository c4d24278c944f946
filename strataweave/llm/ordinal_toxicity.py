"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text (runs of letters, A-Z lower-cased) and their first four and five bytes; a feature
counts once per text, so a long text does not dilute what it contains. The grades 0 .. K share one weight per
feature across K ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k). The score is the expected severity, the
sum of these probabilities.

Training reads at most ``rows`` labelled rows of each outcome (a documented bound; the rows with the
smallest id hash). The ``features`` features that mark toxic rows best (log odds against their standard error)
are candidates; an L1 penalty picks from them and the model is fitted again on those. No feature speaks for a
text, so nothing can hide what else it contains. A first fit of toxic or not splits the toxic rows at the median
of its score into grades 1 and 2. Scoring reads every whole text.

Nulls: a null or empty text has no features and gets the base rate; a null label is no label; without
labelled rows of both outcomes, or features that mark toxic rows, the severity is 0. Rows that repeat an id are
scored on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.textops import Words, lists, map_batches, pieces, signed
from strataweave.scratch import Scratch

ROWS = 4000
FEATURES = 4096
PENALTY = 1.0  # of the fit that picks features
RELAXED = 0.05  # of the fits on the features picked
PREFIXES = (4, 5)


@dataclass
class Model:
    """Feature hashes in order, their weights, and the thresholds t_1 < .. < t_K."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, text number of each) of some texts."""
    words = Words(texts, lower=True, letters=True)
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    found, owner = [words.hashes()], [text]
    for n in PREFIXES:
        long = words.ends - words.starts > n
        cut = Words.__new__(Words)
        cut.data, cut.starts, cut.ends = words.data, words.starts[long], words.starts[long] + n
        found.append(cut.hashes() + np.uint64(n))
        owner.append(text[long])
    return np.concatenate(found), np.concatenate(owner)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bad, text) to (row, bad, words, features of all words)."""
    for batch in batches:
        for first, last, texts in pieces(batch.column(2)):
            keys, owner = _word_features(texts)
            order = np.argsort(owner, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=last - first))])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(first, last - first) for i in (0, 1)],
                 lists(signed(keys[order]), offsets, pa.int64())],
                ["row", "bad", "features"],
            )


def _sparse_fit(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n: int, k: int, penalty: float = PENALTY, rounds: int = 600
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (not negative) and thresholds of the cumulative-link model under an L1 penalty.

    Coordinate descent: each round moves the weight that gains most, by a Newton step, and the thresholds. A
    feature only enters if it speaks for ``penalty`` rows more than the features that are already in.
    """
    m = len(grades)
    here = np.arange(m)
    w = np.zeros(n)
    above = np.array([(grades >= j).mean() for j in range(1, k + 1)])
    t = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / (1 - np.clip(above, 1e-3, 1 - 1e-3)))
    order = np.argsort(columns, kind="stable")
    bounds = np.searchsorted(columns[order], np.arange(n + 1))
    z = np.zeros(m)
    for _ in range(rounds):
        upper = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))  # P(grade >= 1 .. k)
        up = np.concatenate([np.ones((m, 1)), upper, np.zeros((m, 1))], axis=1)
        a, b = up[here, grades], up[here, grades + 1]
        p = np.maximum(a - b, 1e-9)
        slope, curve = a + b - 1, a * (1 - a) + b * (1 - b)  # of -log P(grade) by w.x
        g = np.bincount(columns, weights=slope[rows], minlength=n)
        h = np.bincount(columns, weights=curve[rows], minlength=n) + 0.5
        step = np.clip(np.maximum(0.0, w - (g + penalty) / h) - w, -1.0, 1.0)
        best = int(np.argmax(step * step * h))
        gt = np.zeros(k + 2)
        np.add.at(gt, grades, a * (1 - a) / p)
        np.add.at(gt, grades + 1, -b * (1 - b) / p)
        ht = (upper * (1 - upper)).sum(axis=0) + 1.0
        dt = np.clip(-0.5 * gt[1:-1] / ht, -0.5, 0.5)
        if abs(step[best]) < 1e-3 and np.abs(dt).max() < 1e-3:
            break
        w[best] += step[best]
        z[rows[order[bounds[best] : bounds[best + 1]]]] += step[best]
        t = np.maximum.accumulate(t + dt + 1e-6 * np.arange(k))
    return w, t


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES) -> Model:
    """Train on ``labels(doc_id, toxic)`` joined with ``docs(doc_id, text)``; the bounds are parameters."""
    scratch = Scratch(docs.sparkSession, "llm-severity")
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf]))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(
        F.col("doc_id").alias("row"), F.col("toxic").cast("int").alias("bad")
    )
    chosen = []
    for outcome in (0, 1):  # rows with the smallest hashes: a top-k, not a sort
        chosen.append(known.where(F.col("bad") == outcome).orderBy(F.xxhash64("row"), "row").limit(rows))
    picked = scratch.save(chosen[0].unionByName(chosen[1]).dropDuplicates(["row"]))  # at most 2 * rows
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    # the sample is bounded by a parameter, so it is small for certain
    train = texts.join(F.broadcast(picked), F.col("_id") == F.col("row"))
    # rows that repeat an id are one text, so there are at most 2 * rows
    train = train.groupBy("row", "bad").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = scratch.save(map_batches(train, _features, "row long, bad int, features array<long>"))
    counts = table.groupBy("bad").count().collect()
    n = {r.bad: r["count"] for r in counts}
    if len(n) < 2:
        return empty
    by = table.select("bad", F.explode(F.array_distinct("features")).alias("key")).groupBy("key").agg(
        F.sum("bad").alias("with_bad"), F.count("*").alias("n")
    )
    good = F.col("n") - F.col("with_bad")
    odds = F.log((F.col("with_bad") + 0.5) / (n[1] + 1)) - F.log((good + 0.5) / (n[0] + 1))
    score = F.abs(odds) / F.sqrt(1 / (F.col("with_bad") + 0.5) + 1 / (good + 0.5))
    best = by.where("n >= 3").select("key", odds.alias("odds"), score.alias("score")).where("odds > 0 AND score > 1.5")
    best = best.orderBy(F.desc("score"), "key").limit(features).toPandas()  # at most ``features`` rows
    if best.empty:
        return empty
    best = best.sort_values("key", key=lambda c: c.astype("int64").to_numpy().view(np.uint64))
    keys = best["key"].to_numpy(np.int64).view(np.uint64)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(v.as_py() or [], dtype=np.int64).view(np.uint64) for v in batch.column(2)]
            columns = pa.array([_lookup(keys, np.unique(f)).tolist() for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), columns], ["bad", "columns"])

    small = map_batches(table, reduce, "bad int, columns array<int>").toPandas()  # at most 2 * rows rows
    bad = small["bad"].to_numpy().astype(int)
    lengths = small["columns"].map(len).to_numpy()
    rows_of = np.repeat(np.arange(len(small)), lengths)
    columns = np.concatenate([np.asarray(c, dtype=np.int64) for c in small["columns"]] or [np.zeros(0, np.int64)])
    weights, _ = _sparse_fit(rows_of, columns, bad, len(keys), 1)
    chosen_ = np.flatnonzero(weights > 0)
    if not len(chosen_):
        return empty
    # fit again on the features picked, almost without a penalty: it also shrank the weights of those
    place = np.full(len(keys), -1)
    place[chosen_] = np.arange(len(chosen_))
    rows_of, columns, keys = rows_of[place[columns] >= 0], place[columns[place[columns] >= 0]], keys[chosen_]
    weights, _ = _sparse_fit(rows_of, columns, bad, len(keys), 1, RELAXED, 2500)
    marks = np.bincount(rows_of, weights=weights[columns], minlength=len(bad))
    grades = np.where(bad == 1, 1 + (marks > np.median(marks[bad == 1])), 0)
    weights, cuts = _sparse_fit(rows_of, columns, grades, len(keys), int(grades.max()), RELAXED, 2500)
    return Model(keys, weights, cuts)


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions in ``keys`` (ascending) of the values that occur there."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return at[keys[at] == values] if len(keys) else np.zeros(0, np.int64)


def severity(texts: list[bytes], model: Model) -> np.ndarray:
    """P(grade >= k) for each text and k."""
    score = np.zeros(len(texts))
    if len(model.keys):
        found, owner = _word_features(texts)
        at = np.minimum(np.searchsorted(model.keys, found), len(model.keys) - 1)
        hit = model.keys[at] == found
        pairs = np.unique(owner[hit] * len(model.keys) + at[hit])  # a feature counts once per text
        np.add.at(score, pairs // len(model.keys), model.weights[pairs % len(model.keys)])
    above = score[:, None] - model.thresholds[None, :]
    return np.where(np.isneginf(above), 0.0, 1 / (1 + np.exp(-np.clip(above, -700, 700))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and severity (expected grade) and p_toxic (P(grade >= 1))."""
    own = [c for c in docs.columns if c not in ("severity", "p_toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*own).schema
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in pieces(batch.column(at).cast(pa.binary())):
                p = severity(texts, shared.value)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0])], [*own, "severity", "p_toxic"]
                )

    return map_batches(docs.select(*own), run, schema.add("severity", "double").add("p_toxic", "double"))
