"""SimHash near-duplicates: every pair of fingerprints is decided, tile by tile.

A text's words (A-Z lower-cased) give shingles of ``n`` words, repeats included, joined by one space; a shorter text
is one shingle of all its words. A bit of the 64-bit fingerprint is set if it is set in over half of the shingles'
hashes (XXH64, seed 42). Fingerprints link at ``radius`` or fewer differing bits.

1. Distinct fingerprints are sorted by (population count, value) over the cluster and cut into tiles of equal size.
2. Two fingerprints within the radius have population counts at most the radius apart, so a tile is paired with
   itself and the tiles after it whose smallest count is within the radius of its largest; others are skipped.
   The partners of a tile follow from a table of 65 entries, one for each population count.
3. A task gets the two tiles of one pair and compares them exactly by exclusive-or and bit counts, in strips, and
   again skips the columns whose counts are out of reach. It emits only links that join two components of its pair,
   so a group of g near copies gives less than g links for each tile pair, not g * g.
4. Components of the links are named by the smallest id.

The comparison is exact: nothing is hashed into buckets and nothing can be missed. Its work is the square of the
number of distinct fingerprints, at about 2 ns a pair; copies of a text are one fingerprint.

Nulls and ties: null and empty texts have fingerprint zero and link like any other. Rows are not told apart by id:
rows that repeat an id are rows of their own. A null id is never the smallest; a component without ids has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.components import components
from strataweave.llm.textops import map_batches, ship
from strataweave.scratch import Scratch
from strataweave.skew import number_rows

TILE = 16384  # fingerprints, 128 KB
STRIP = 8  # rows of a tile that are compared at once
SEED = 42
_HASHED = 1 << 16  # shingles of one text that are counted at once


def fingerprint(text: bytes, n: int) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    total = max(len(words) - n + 1, 1)
    starts, ends = (ends - sizes)[:total], ends[-total:]
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _HASHED):
        spans = zip(starts[at : at + _HASHED].tolist(), ends[at : at + _HASHED].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, print) per row of ``docs(doc_id, text)``; ``print`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, print long")


def joining_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Fingerprints of ``a`` and ``b`` (or of ``a`` alone) within the radius, those that join two components."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    same = b is None
    b = a if same else b[np.argsort(np.bitwise_count(b), kind="stable")]
    # bit counts are uint8: without a sign, 0 - radius would wrap around
    ones, others = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    shift = 0 if same else len(a)
    part = np.arange(shift + len(b))
    found = []
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        low = np.searchsorted(others, ones[at] - radius)
        high = np.searchsorted(others, ones[at + len(strip) - 1] + radius, side="right")
        if same:
            low = max(low, at)
        near = np.bitwise_count(strip[:, None] ^ b[None, low:high]) <= radius
        for i in np.flatnonzero(near.any(axis=1)) + at:
            js = np.flatnonzero(near[i - at]) + low
            theirs = part[js + shift]
            if (theirs == part[i]).all():
                continue
            roots, first = np.unique(theirs, return_index=True)
            fresh = roots != part[i]
            found += [(int(a[i]), int(b[j])) for j in js[first[fresh]]]
            part[np.isin(part, roots)] = part[i]
    return found


def _last(tiles: DataFrame, column: str, first: bool) -> list[int]:
    """For each population count c: the last tile with ``column`` <= c, or the first with ``column`` >= c."""
    pick = F.min("tile") if first else F.max("tile")
    known = {r[column]: r.t for r in tiles.groupBy(column).agg(pick.alias("t")).collect()}  # at most 65 rows
    out = [0] * 65
    for c in range(65):
        out[c] = min((t for k, t in known.items() if k >= c), default=0) if first else max(
            (t for k, t in known.items() if k <= c), default=0)
    return out


def links(prints: DataFrame, radius: int, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``prints(print)`` within the radius that connect whatever is linked."""
    sorted_prints = number_rows(prints.select(F.bit_count("print").alias("ones"), "print"), ["ones", "print"])
    tiles = scratch.save(
        sorted_prints.groupBy(F.floor(F.col("position") / F.lit(tile)).alias("tile"))
        .agg(F.collect_list("print").alias("prints"), F.min("ones").alias("low"), F.max("ones").alias("high"))
    )

    def entry(table: list[int], count: Column) -> Column:
        return F.get(F.lit(table), F.least(F.greatest(count, F.lit(0)), F.lit(64)))

    upto = entry(_last(tiles, "low", False), F.col("high") + radius)
    since = entry(_last(tiles, "high", True), F.col("low") - radius)
    left = tiles.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", upto)).alias("b"), "prints")
    right = tiles.select(F.explode(F.sequence(since, F.col("tile"))).alias("a"), F.col("tile").alias("b"), "prints")

    def compare(first: pa.Table, second: pa.Table) -> pa.Table:
        a, b = (np.array(t.column("prints")[0].values, np.int64).view(np.uint64) for t in (first, second))
        same = first.column("a")[0].as_py() == first.column("b")[0].as_py()
        pairs = np.array(joining_links(a, None if same else b, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    ship(prints.sparkSession)
    return scratch.save(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs(doc_id, text)``; the fingerprint as 16 hex digits."""
    scratch = Scratch(docs.sparkSession, "llm-simhash")
    rows = scratch.save(fingerprints(docs, n))
    prints = scratch.save(rows.groupBy("print").agg(F.min("doc_id").alias("low")))
    joined = components(links(prints, radius, scratch, tile), scratch)
    part = prints.join(joined.withColumnRenamed("id", "print"), "print", "left")
    part = scratch.save(part.select("print", F.coalesce("component", "print").alias("part"), "low"))
    names = part.groupBy("part").agg(F.min("low").alias("component_id"))
    named = scratch.save(part.join(names, "part").select("print", "component_id"))
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
