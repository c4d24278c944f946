"""Repeated passages by compaction of the de Bruijn graph of all texts.

Every run of ``k`` words is an edge from its first to its last k - 1 words. An edge that occurs more than once
is repeated; the first occurrence (smallest id, then smallest start) is the source, and the words of every
other occurrence are removed. Edges are never listed one by one where they need not be:

1. Neighbouring edges that share their minimizer (the smallest hash among the ``m``-word runs inside) form one
   path, a row of (minimizer, coordinates, 128-bit hash of the whole path). Equal edges have equal
   minimizers, so a minimizer that occurs once proves that none of its edges is repeated: one count and one
   semi-join over about an eighth as many rows as there are words leave the repeated minimizers.
2. Equal paths of a minimizer stay compacted: their source is the smallest coordinate, found by an aggregate and
   joined back, and every other occurrence is a repeat as a whole.
3. Where a minimizer has several paths the graph branches (the borders of copied passages). One occurrence of
   each path is split into edges, which are counted and joined in the same way.
4. Per text, the joined rows are chained to spans of (words, source id, source start) as long as the source
   coordinates advance in step. Source and copy are compared by the 128-bit hash of their words.

Words are runs of characters other than space, tab, LF, VT, FF and CR, unchanged.

Nulls and ties: a null text has no words. Rows that repeat an id are one text if they are equal. Otherwise they, and
rows without an id, are texts of their own, told apart by a position; null ids come first. Texts shorter than ``k``
words keep all. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.positions import ids_are_unique, positioned
from strataweave.llm.textops import Words, map_batches, pieces, sequence_hashes, sequence_sums, signed, windows
from strataweave.scratch import Scratch

K = 20
M = 5
NO_ID = -(1 << 63)  # stands for a null id inside this module
PATHS = "mini long, id long, first int, last int, low long, high long"


def _paths(texts: list[bytes], k: int, m: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of edges with one minimizer: (text, minimizer hash, first edge, last edge, hash, hash)."""
    words = Words(texts)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64))
    if len(words) < k:
        return empty
    low, high = words.hashes(0), words.hashes(1)
    runs = windows(low, m)
    width = k - m + 1
    n = len(words) - k + 1  # edges, those across two texts included
    best = runs[:n].copy()
    at = np.zeros(n, np.int8)
    for shift in range(1, width):  # leftmost smallest of the runs inside each edge
        other = runs[shift : shift + n]
        less = other < best
        best[less] = other[less]
        at[less] = shift
    place = np.arange(n) + at
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    inside = text[:n] == text[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (text[1:n] != text[: n - 1])
    heads = np.flatnonzero(new & inside)
    if not len(heads):
        return empty
    breaks = np.flatnonzero(new | ~inside)  # a path ends before the next break
    nxt = np.append(breaks, n)[np.searchsorted(breaks, heads, side="right")]
    tails = nxt - 1
    a = sequence_hashes(sequence_sums(low, 0), heads, tails + k, 0)
    b = sequence_hashes(sequence_sums(high, 1), heads, tails + k, 1)
    owner = text[heads]
    begin = words.bounds[owner]
    return owner, best[heads], heads - begin, tails - begin, a, b


def paths(docs: DataFrame, k: int, m: int) -> DataFrame:
    """The compacted paths of ``docs(id, text)`` with binary texts; positions count words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, texts in pieces(batch.column(1)):
                owner, mini, head, tail, low, high = _paths(texts, k, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(mini)), pa.array(ids[first + owner]), pa.array(head.astype(np.int32)),
                     pa.array(tail.astype(np.int32)), pa.array(signed(low)), pa.array(signed(high))],
                    ["mini", "id", "first", "last", "low", "high"],
                )

    return map_batches(docs, run, PATHS)


def minimizers(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(mini, n): how often each minimizer occurs within one piece of the input, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                values, n = np.unique(_paths(texts, k, m)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n)], ["mini", "n"])

    return map_batches(docs.select("text"), run, "mini long, n long")


def split_paths(docs: DataFrame, k: int) -> DataFrame:
    """The edges of the listed paths of ``docs(id, text, paths)``: (id, first, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            listed = batch.column(2)
            for first, _, texts in pieces(batch.column(1)):
                words = Words(texts)
                sums = sequence_sums(words.hashes(0), 0), sequence_sums(words.hashes(1), 1)
                owner, at = [], []
                for i in range(len(texts)):
                    for path in listed[first + i].as_py():
                        starts = np.arange(path["first"], path["last"] + 1)
                        owner.append(np.full(len(starts), i))
                        at.append(starts)
                if not owner:
                    continue
                owner, at = np.concatenate(owner), np.concatenate(at)
                begin = words.bounds[owner] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + owner]), pa.array(at.astype(np.int32))]
                    + [pa.array(signed(sequence_hashes(s, begin, begin + k, lane))) for lane, s in enumerate(sums)],
                    ["id", "first", "low", "high"],
                )

    return map_batches(docs, run, "id long, first int, low long, high long")


def chain(copies: np.ndarray) -> np.ndarray:
    """Join rows (first, last, source, source first, ..) whose source advances in step; ordered by first."""
    if len(copies) < 2:
        return copies
    copies = copies[np.lexsort((copies[:, 1], copies[:, 0]))]
    first, last, source, at = copies.T[:4]
    shift = at - first
    new = np.ones(len(copies), bool)
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (first[1:] > last[:-1] + 1)
    heads = np.flatnonzero(new)
    joined = copies[heads]
    joined[:, 1] = np.maximum.reduceat(last, heads)
    return joined


def _table(copies: pa.StructArray) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in copies.flatten()], axis=1)


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, names: DataFrame | None = None) -> DataFrame:
    """(id, copies) for ``docs(id, text)`` with binary texts and ids that are not null.

    ``copies`` is an array of (first, last, source, at): the edges first..last of the text also start at
    word ``at`` .. of text ``source``, which is earlier. ``names(id, name)`` adds the name of ``source`` as a fifth.
    """
    scratch = Scratch(docs.sparkSession, "llm-debruijn")
    repeated = minimizers(docs, k, m).groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1").select("mini")
    repeated = scratch.save(repeated)
    rows = scratch.save(paths(docs, k, m).join(repeated, "mini", "left_semi"))
    scratch.drop(repeated)
    # equal paths of a bucket are one node sequence: its first occurrence is the source of the others
    whole = scratch.save(
        rows.groupBy("mini", "low", "high").agg(
            F.min(F.struct("id", "first", "last")).alias("source"), F.count("*").alias("n")
        )
    )
    sources = whole.where("n > 1").select("mini", "low", "high", "source")
    later = ~((F.col("id") == F.col("source.id")) & (F.col("first") == F.col("source.first")))
    columns = ["id", "first", "last", F.col("source.id").alias("from"), F.col("source.first").alias("at")]
    copies = rows.join(sources, ["mini", "low", "high"]).where(later).select(*columns)

    # buckets with several paths branch: one occurrence of each path is split into its edges
    branching = scratch.save(whole.groupBy("mini").count().where("count > 1").select("mini"))
    listed = whole.join(branching, "mini", "left_semi").select("source.*").groupBy("id").agg(
        F.collect_set(F.struct("first", "last")).alias("paths")
    )
    edges = scratch.save(split_paths(docs.join(listed, "id").select("id", "text", "paths"), k))
    first_edges = scratch.save(
        edges.groupBy("low", "high").agg(F.min(F.struct("id", "first")).alias("source"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    single = (
        edges.join(first_edges, ["low", "high"]).where(later).withColumn("last", F.col("first")).select(*columns)
    )
    copies = copies.unionByName(single)
    cells = ["first", "last", "from", "at"]
    if names is not None:
        copies = copies.join(names.toDF("from", "name"), "from")
        cells.append("name")
    # a text's own paths only: no more than its words
    return scratch.save(copies.groupBy("id").agg(F.collect_set(F.struct(*cells)).alias("copies")))


def remove_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_text, spans.

    ``kept_text`` is the words that stay, joined by one space; ``spans`` lists (first, last, source_id, at): words
    first..last - 1 repeat the words from ``at`` of the earlier text ``source_id`` (null where its id is null).
    """
    scratch = Scratch(docs.sparkSession, "llm-repeats")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unique = ids_are_unique(table)
    if not unique:
        table = positioned(table, scratch, nulls_first=True)
    table = table.select(
        F.col("doc_id" if unique else "position").alias("id"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("name"),
        F.col("text").cast("binary").alias("text"),
    )
    names = None if unique else table.select("id", "name").distinct()
    found = scratch.save(repeated_spans(table.select("id", "text"), k, m, names))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("source_id", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            for first, last, texts in pieces(batch.column(1)):
                counts, removed, kept, spans = [], [], [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    copies = listed[first + i]
                    rows = chain(_table(copies.values) if copies.is_valid else np.zeros((0, 5), np.int64))
                    stay = np.ones(len(words), bool)
                    for a, b, *_ in rows.tolist():
                        stay[a : b + k] = False
                    counts.append(len(words))
                    removed.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join(compress(words, stay.tolist()) if len(rows) else words))
                    spans.append([
                        {"first": a, "last": b + k, "source_id": None if (name or [s])[0] == NO_ID else (name or [s])[0], "at": x}
                        for a, b, s, x, *name in rows.tolist()
                    ])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)],
                    ["id", "n_words", "n_removed", "kept_text", "spans"],
                )

    out = map_batches(
        table.join(found, "id", "left").select(F.col("name").alias("id"), "text", "copies"),
        run,
        "id long, n_words long, n_removed long, kept_text string, "
        "spans array<struct<first:int,last:int,source_id:long,at:int>>",
    )
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_text", "spans")

