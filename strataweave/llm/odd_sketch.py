"""Near-duplicates: MinHash bands propose, odd sketches sieve, full shingle sets decide.

A text's set is its distinct shingles of ``n`` words (A-Z lower-cased); a shorter text has its whole word
sequence as one shingle, a text without words has the empty set and is linked with nothing. Texts are linked
if 100 * intersection >= percent * union.

1. One pass over the texts gives the digest of the word sequence, the set size, the band keys of 128 MinHash
   values and an odd sketch: the samples (i, minhash_i) toggle bits of a 512-bit parity bitmap, so the XOR of
   two bitmaps is the bitmap of the samples that differ and its population count estimates the similarity.
2. Equal sequences form classes; only one representative (the smallest id) goes on.
3. Representatives that share a band key form a bucket. Buckets with the same members are handled once.
4. Members of a bucket are compared in blocks of bounded size, dealt anew for every bucket. Within a block a pair
   is skipped once both texts are in one component, the odd sketches sieve the rest, and the full sets decide.
   Only links that join two components leave a block, so a bucket of n texts emits less than n links, not n * n.
5. In a bucket of several blocks, members outside the component that most members belong to by now are compared
   with the members of all blocks. After that every pair of a bucket has been compared or is in one component.
6. Components of the links give the classes of near-duplicates.

A pair at similarity 0.8 shares no band with probability 5e-8; the sieve keeps pairs whose estimate is five
standard errors below 0.8. Nothing is capped.

Nulls and ties: a null text is empty. Rows are linked by a number of their own where ids are null or repeated; only
rows with the same id and the same text are one node. A component is named by its smallest id (null if it has none),
and of rows without an id, or with the same one, the first position is its smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.components import components
from strataweave.llm.positions import ids_are_unique, positioned, unused
from strataweave.llm.textops import Words, groups, lists, map_batches, mix, pieces, sequence_hashes, sequence_sums, signed
from strataweave.scratch import Scratch

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
BLOCK = 1024
_A = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within a text) of all texts, and the texts' bounds."""
    words = Words(texts, lower=True)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sums = sequence_sums(words.hashes())
    first, last = words.bounds[:-1], words.bounds[1:]
    count = np.where(last > first, np.maximum(last - first - n + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    starts = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    hashes = sequence_hashes(sums, starts, np.minimum(starts + n, last[owner]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of SAMPLES hash functions over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1))
    return best


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 64) parity bitmaps of (texts, SAMPLES) MinHash values."""
    slot = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bit = (slot % np.uint64(SKETCH_BITS)).astype(np.int64)
    count = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(count, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(count & 1, axis=1, bitorder="little").view(np.uint64)


def most_bits(percent: int) -> int:
    """Bits that the XOR of two sketches may have for a pair at the limit, five standard errors included."""
    similar = percent / 100
    worst = max(0.0, similar - 5.5 * np.sqrt(similar * (1 - similar) / SAMPLES))
    odd = (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - worst))) / 2
    return int(np.ceil(SKETCH_BITS * odd + 3 * np.sqrt(SKETCH_BITS * odd * (1 - odd))))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, sequence, n_shingles, bands, sketch) of ``docs(doc_id, text)``; the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in pieces(batch.column(1)):
                hashes, bounds = shingle_sets(texts, n)
                size = np.diff(bounds)
                samples = np.zeros((len(texts), SAMPLES), np.uint32)
                for i in np.flatnonzero(size):
                    samples[i] = minhash(hashes[bounds[i] : bounds[i + 1]])
                sums = np.cumsum(
                    mix(samples.astype(np.uint64) + np.uint64(1)).reshape(len(texts), BANDS, ROWS)
                    * np.arange(1, 2 * ROWS, 2, dtype=np.uint64),
                    axis=2, dtype=np.uint64,
                )[:, :, -1]
                keys = mix(sums + (np.arange(BANDS, dtype=np.uint64) << np.uint64(56)))
                sketch = odd_sketches(samples)
                empty = pa.array(size == 0)
                digests = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
                bands = lists(signed(keys.ravel()), np.arange(0, keys.size + 1, BANDS), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(digests, pa.binary()),
                        pa.array(size, pa.int64()),
                        pa.compute.if_else(empty, pa.scalar(None, bands.type), bands),
                        pa.array([None if s == 0 else r.tobytes() for s, r in zip(size, sketch)], pa.binary()),
                    ],
                    ["doc_id", "sequence", "n_shingles", "bands", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, sequence binary, n_shingles long, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of ``docs(id, text)`` with binary texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in pieces(batch.column(1)):
                hashes, bounds = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), lists(signed(hashes), bounds, pa.int64())],
                    ["id", "shingles"],
                )

    return map_batches(docs, run, "id long, shingles array<long>")


def joining_links(
    side: np.ndarray, root: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Pairs of positions whose sets are similar enough and that join two components, in order.

    ``side`` 0 and 1: only pairs across; all 0: all pairs. ``root`` are the components so far.
    """
    m = len(sets)
    cross = bool(side.any())
    root = np.unique(root, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    limit = most_bits(percent)
    found = []
    for i in range(m):
        later = np.arange(i + 1, m)
        later = later[root[later] != root[i]]
        if cross:
            later = later[side[later] != side[i]]
        small, large = np.minimum(size[later], size[i]), np.maximum(size[later], size[i])
        later = later[100 * small >= percent * large]  # the intersection cannot be larger than the smaller set
        if not len(later):
            continue
        bits = np.bitwise_count(sketch[later] ^ sketch[i]).sum(axis=1)
        for j in later[bits <= limit]:
            if root[i] == root[j]:
                continue
            a, b = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                found.append((i, int(j)))
                root[root == root[j]] = root[i]
    return found


def links(described: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b) of linked representatives that join two components; ``described`` is a written table."""
    classes = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sequence").agg(
        F.min("doc_id").alias("id")
    )
    heads = scratch.save(classes.select("id").distinct())
    mine = described.join(heads, described.doc_id == heads.id, "left_semi").where("n_shingles > 0")
    mine = mine.dropDuplicates(["doc_id"])  # rows that repeat an id are one node
    member = mine.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    bucket = scratch.save(
        member.groupBy("bucket")
        .agg(
            F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
            # wraps around without an error, other than a sum
            F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        )
        .where("n > 1")
        .groupBy("n", "low", "high", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = scratch.save(
        member.join(bucket, "bucket")
        .withColumn("blocks", blocks)
        .select("bucket", "blocks", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int").alias("own"), "id")
    )
    wanted = scratch.save(placed.select("id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    sets = full_sets(texts.join(wanted, "id", "left_semi"), n)
    known = scratch.save(mine.select(F.col("doc_id").alias("id"), "sketch", F.col("sequence").alias("s")).join(wanted, "id"))
    sets = scratch.save(sets.dropDuplicates(["id"]).join(known.select("id", "sketch"), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "own"]):
            ids = group.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            shingles = group.column("shingles").combine_chunks()
            bounds = shingles.offsets.to_numpy()
            flat = shingles.values.to_numpy().view(np.uint64)
            found = [flat[bounds[i] : bounds[i + 1]] for i in order]
            raw = group.column("sketch").to_pylist()
            sketch = np.frombuffer(b"".join(raw[i] for i in order), np.uint64).reshape(len(ids), -1)
            side, root = (group.column(c).to_numpy()[order] for c in ("side", "root"))
            pairs = joining_links(side, root, sketch, found, percent)
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_pydict({"a": ids[order][list(a)], "b": ids[order][list(b)]})

    def compare(rows: DataFrame) -> DataFrame:
        dealt = rows.join(sets, "id").select("bucket", "own", "side", "root", "id", "sketch", "shingles")
        dealt = dealt.repartition("bucket", "own").sortWithinPartitions("bucket", "own")
        return scratch.save(map_batches(dealt, run, "a long, b long").distinct())

    none = F.lit(0).alias("side")
    found = compare(placed.select("bucket", "own", none, F.col("id").alias("root"), "id"))
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return found
    known = components(found, scratch)
    several = scratch.save(
        several.join(known, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
    )
    most = F.max(F.struct("count", "root"))["root"]
    main = scratch.save(several.groupBy("bucket", "root").count().groupBy("bucket").agg(most.alias("main")))
    outside = scratch.save(several.join(main, "bucket").where("root <> main").drop("main"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")
    rows = several.join(outside.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "own", none, "root", "id")
    rows = rows.unionByName(outside.select("bucket", everywhere, F.lit(1).alias("side"), "root", "id"))
    return scratch.save(found.unionByName(compare(rows)))


def _near(docs: DataFrame, n: int, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs(doc_id, text)``, whose ids stand for one text each."""
    described = scratch.save(describe(docs, n))
    joined = components(links(described, docs, n, percent, scratch, block), scratch)
    rows = described.select("doc_id", "n_shingles", "sequence")
    heads = scratch.save(
        rows.where("n_shingles > 0").groupBy("sequence").agg(F.min("doc_id").alias("head"))
        .join(joined.withColumnRenamed("id", "head"), "head", "left")
        .select("sequence", F.coalesce("component", "head").alias("found"))
    )
    out = rows.join(heads, "sequence", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links; ``kept`` rows are the first of their component.
    """
    scratch = Scratch(docs.sparkSession, "llm-near")
    if ids_are_unique(docs):
        return _near(docs, n, percent, block, scratch).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    rows = positioned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, nulls_first=False)
    found = _near(rows.select(F.col("position").alias("doc_id"), "text"), n, percent, block, scratch)
    found = scratch.save(found.withColumnsRenamed({"doc_id": "position", "component_id": "first"}))
    names = rows.select("position", "doc_id").distinct()
    return found.join(names, "position").join(names.toDF("first", "component_id"), "first").select(
        "doc_id", "n_shingles", "component_id", (F.col("position") == F.col("first")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, the row with the smallest id of each component.

    Rows that repeat a kept id and its text stay together: exact copies are another operator's work.
    """
    scratch = Scratch(docs.sparkSession, "llm-near-drop")
    position = unused("position", docs.columns)
    if ids_are_unique(docs):
        rows, number = docs, F.col("doc_id").cast("long")
    else:
        rows, number = positioned(docs, scratch, nulls_first=False, name=position), F.col(position)
    found = _near(rows.select(number.alias("doc_id"), "text"), n, percent, BLOCK, scratch)
    other = unused("gone", [*docs.columns, position])
    gone = scratch.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct())
    return rows.join(gone, number == F.col(other), "left_anti").select(*docs.columns)
