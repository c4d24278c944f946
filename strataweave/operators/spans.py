"""Annotation spans on texts: duplicates, bounds, nesting and crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, skew_join

FEW = 256  # documents with at most this many distinct ranges are compared range by range


def clean_spans(spans: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Distinct (doc, start, end, tag) with 0 <= start < end, inside the text when its length is known."""
    out = spans.select("doc", "start", "end", "tag").where("start >= 0 AND start < end").distinct()
    if lengths is None:
        return out
    inside = skew_join(out, lengths.select("doc", "length"), "doc", hot_left=hot_keys(out, "doc"))
    return inside.where("end <= length").drop("length")


def span_structure(spans: DataFrame, few: int = FEW) -> DataFrame:
    """(doc, start, end, tag, nesting_level, crosses) of cleaned spans.

    ``nesting_level`` counts the other spans a span contains, ``crosses`` tells whether some
    span overlaps it without containment. Documents with few ranges compare them directly;
    documents with many use dyadic counts, whose work grows with ranges x log(length)^2 and
    never with pairs.
    """
    scratch = Scratch(spans.sparkSession, "spans")
    ranges = scratch.save(
        spans.groupBy("doc", F.col("start").cast("long"), F.col("end").cast("long")).agg(F.count("*").alias("w"))
    )
    wide = ranges.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > few).select("doc")
    wide = scratch.save(wide)
    hot = hot_keys(ranges, "doc")
    measured = _by_pairs(ranges.join(wide, "doc", "left_anti"))
    if not wide.isEmpty():
        dense = scratch.save(skew_join(ranges, wide, "doc", "left_semi", hot_left=hot))
        measured = measured.unionByName(_by_dyadic(dense, scratch))
    joined = spans.join(measured, ["doc", "start", "end"])
    return joined.select("doc", "start", "end", "tag", (F.col("inside") - 1).alias("nesting_level"), "crosses")


def _by_pairs(ranges: DataFrame) -> DataFrame:
    """Direct comparison inside a document; at most FEW^2 pairs per document."""
    other = ranges.select(
        "doc", F.col("start").alias("s"), F.col("end").alias("e"), F.col("w").alias("ow")
    )
    met = ranges.join(other, "doc").where("s < end AND e > start")
    contains = (F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end"))
    crossing = ((F.col("s") < F.col("start")) & (F.col("e") < F.col("end"))) | (
        (F.col("s") > F.col("start")) & (F.col("e") > F.col("end"))
    )
    return met.groupBy("doc", "start", "end").agg(
        F.sum(F.when(contains, F.col("ow")).otherwise(0)).alias("inside"), F.max(crossing).alias("crosses")
    )


def _shift(value, bits):
    return F.call_function("shiftright", value, bits)


def _nodes(low, high, levels):
    """Dyadic blocks (level, block) that exactly tile the integer range [low, high)."""

    def at(i):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        left = _shift(low + size - 1, i)
        right = _shift(high, i)
        block = lambda ok, p: F.when((left < right) & ok, F.struct(i.alias("level"), p.alias("block")))
        return F.array(block(left % 2 == 1, left), block(right % 2 == 1, right - 1))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def _by_dyadic(ranges: DataFrame, scratch: Scratch) -> DataFrame:
    top = ranges.agg(F.max("end")).first()[0]
    bits = max(int(top + 1).bit_length(), 1)
    levels = F.sequence(F.lit(0), F.lit(bits))
    zero, beyond = F.lit(0).cast("long"), F.lit(1 << bits).cast("long")

    def blocks(position):
        return F.transform(levels, lambda i: F.struct(i.alias("level"), _shift(position, i).alias("block")))

    # contained ranges: start >= s and end <= e, counted over (start block, end block) cells
    cells = (
        ranges.select("doc", "w", "end", F.explode(blocks(F.col("start"))).alias("a"))
        .select("doc", "w", "a", F.explode(blocks(F.col("end"))).alias("b"))
        .groupBy("doc", "a", "b")
        .agg(F.sum("w").alias("cell"))
    )
    asked = (
        ranges.select("doc", "start", "end", F.explode(_nodes(F.col("start"), beyond, levels)).alias("a"))
        .select("doc", "start", "end", "a", F.explode(_nodes(zero, F.col("end") + 1, levels)).alias("b"))
    )
    inside = asked.join(cells, ["doc", "a", "b"]).groupBy("doc", "start", "end").agg(F.sum("cell").alias("inside"))

    # crossings: a start strictly inside with a later end, or an end strictly inside with an earlier start
    strictly = F.explode(_nodes(F.col("start") + 1, F.col("end"), levels))
    probes = scratch.save(ranges.select("doc", "start", "end", strictly.alias("node")))
    late = ranges.select("doc", "end", F.explode(blocks(F.col("start"))).alias("node")).groupBy("doc", "node").agg(
        F.max("end").alias("reach")
    )
    early = ranges.select("doc", "start", F.explode(blocks(F.col("end"))).alias("node")).groupBy("doc", "node").agg(
        F.min("start").alias("since")
    )
    over = probes.join(late, ["doc", "node"]).where("reach > end").select("doc", "start", "end")
    under = probes.join(early, ["doc", "node"]).where("since < start").select("doc", "start", "end")
    crossed = over.unionByName(under).distinct().withColumn("_c", F.lit(True))
    return inside.join(crossed, ["doc", "start", "end"], "left").select(
        "doc", "start", "end", "inside", F.coalesce("_c", F.lit(False)).alias("crosses")
    )
