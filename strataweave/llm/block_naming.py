"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and get
integers in that order, so a name stands for one block content and no other. Then adjacent names are
paired, the distinct pairs are sorted and named, and so on until each text has one name. Texts are
equal if and only if they have as many blocks and the same last name.

Large texts never meet in one task: what is shuffled is one block or one pair of integers per row, and
equal blocks are collapsed before the shuffle. Blocks are sorted by (64-bit hash, content). Where no
hash has two contents, which the job establishes over all blocks, a text finds its blocks' names by the
hash; otherwise by hash and content, so names are free of collisions in any case.

Nulls and ties: a null text is empty; null ids are the smallest ids; rows that repeat id and text count
as rows of the group, and one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.positions import unused
from strataweave.scratch import Scratch

BLOCK_CHARS = 2048


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Sort the rows of every partition and number them; rows must be distinct in ``order``.

    The numbers are only used after the table has been written, so a repeated task cannot change them.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _blocks(text: Column, size: int) -> Column:
    """The text's blocks in order, cut in one pass; an empty text has one empty block.

    A text that is not valid UTF-8 is cut as hexadecimal digits behind an empty block, which no other text starts with.
    """
    def cut(whole: Column) -> Column:
        return F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    nothing = F.array(F.lit(""))
    return F.when(text == "", nothing).when(F.is_valid_utf8(text), cut(text)).otherwise(
        F.concat(nothing, cut(F.hex(text.cast("binary"))))
    )


def name_texts(docs: DataFrame, scratch: Scratch, size: int = BLOCK_CHARS) -> DataFrame:
    """(row, doc_id, text_sha256, parts, name) for ``docs(row, doc_id, text)``: equal (parts, name), equal texts."""
    text = F.coalesce("text", F.lit(""))
    blocks = _blocks(text, size)
    contents = docs.select(F.explode(blocks).alias("block")).select(F.xxhash64("block").alias("hash"), "block")
    tied = not contents.distinct().groupBy("hash").count().where("count > 1").isEmpty()

    rows = scratch.save(
        docs.select(
            "row",
            "doc_id",
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
            (blocks if tied else F.transform(blocks, lambda b: F.xxhash64(b))).alias("blocks"),
        ).withColumn("parts", F.size("blocks"))
    )
    first = rows.select("row", F.posexplode("blocks").alias("at", "block"))
    if tied:
        first = first.select("row", "at", F.xxhash64("block").alias("hash"), "block")
        keys = ["hash", "block"]
    else:
        first = first.withColumnRenamed("block", "hash")
        keys = ["hash"]
    named = scratch.save(_named(first.select(*keys).distinct(), keys))
    level = scratch.save(first.join(named, keys).select("row", "at", "name"))
    done = None
    while True:
        whole = level.groupBy("row").agg(F.count("*").alias("n"), F.min("name").alias("name"))
        whole = scratch.save(whole)
        ready = whole.where("n = 1").select("row", "name")
        done = ready if done is None else done.unionByName(ready)
        if whole.where("n > 1").isEmpty():
            break
        odd = F.col("at").bitwiseAND(1) == 1
        pairs = scratch.save(
            level.join(whole.where("n > 1").select("row"), "row", "left_semi")
            .groupBy("row", F.shiftright("at", 1).alias("at"))
            .agg(
                F.min(F.when(~odd, F.col("name"))).alias("left"),
                F.coalesce(F.min(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        named = scratch.save(_named(pairs.select("left", "right").distinct(), ["left", "right"]))
        level = scratch.save(pairs.join(named, ["left", "right"]).select("row", "at", "name"))
    return rows.drop("blocks").join(done, "row")


def _grouped(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """``docs(row, doc_id, text)`` as (row, doc_id, keep, group_size, text_sha256); keep is (doc_id, row) of what stays."""
    rows = scratch.save(name_texts(docs, scratch, size))
    groups = scratch.save(
        rows.groupBy("parts", "name").agg(
            F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
        )
    )
    return rows.join(groups, ["parts", "name"]).select("row", "doc_id", "keep", "group_size", "text_sha256")


def exact_groups(docs: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.
    """
    scratch = Scratch(docs.sparkSession, "llm-names")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _grouped(numbered, scratch, size).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with all its columns, of equal texts the row with the largest doc_id (of those the last one written)."""
    scratch = Scratch(docs.sparkSession, "llm-copies")
    number = unused("row", docs.columns)
    # written down because row numbers must not move between two reads
    rows = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    named = rows.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = _grouped(named, scratch, size).where(F.col("row") != F.col("keep.row"))
    # the copies grow with the documents, so they are joined by a shuffle at every size
    gone = scratch.save(copies.select(F.col("row").alias(number))).hint("merge")
    return rows.join(gone, number, "left_anti").select(*docs.columns)
