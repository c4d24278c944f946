"""Connected components of a link table that is not held anywhere whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that occurs in ``links(a, b)``; component is the smallest id.

    Every round hooks each node to its smallest neighbour, follows that pointer once more and
    contracts the links, so the number of nodes at least halves; a round is three small joins.
    Self links only list their id. Null ids are ignored. No links: an empty table.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").distinct()
    left = scratch.save(links.where("a <> b"))
    label = scratch.save(
        links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    )
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        further = hook.select(F.col("a").alias("to"), F.col("to").alias("then"))
        jump = scratch.save(hook.join(further, "to", "left").select("a", F.coalesce("then", "to").alias("to")))
        low = jump.withColumnsRenamed({"a": "component", "to": "low"})
        label = scratch.save(
            label.join(low, "component", "left").select("id", F.coalesce("low", "component").alias("component")),
            replaces=label,
        )
        left = scratch.save(
            left.join(jump, "a")
            .select(F.col("to").alias("a"), F.col("b"))
            .join(jump.withColumnsRenamed({"a": "b", "to": "other"}), "b")
            .select("a", F.col("other").alias("b"))
            .where("a <> b")
            .distinct(),
            replaces=left,
        )
        scratch.drop(hook)
        scratch.drop(jump)
    return label
