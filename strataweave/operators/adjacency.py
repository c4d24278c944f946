"""Graph views over an edge table and the per-node counts derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN_WEIGHT = 0.6
FAN_OUT_WEIGHT = 0.4


def simple_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges (other scopes, weights) collapse into one; self-loops stay."""
    return edges.select("src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def node_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Listed nodes and edge endpoints."""
    return (
        nodes.select("id")
        .unionByName(edges.select(F.col("src").alias("id")))
        .unionByName(edges.select(F.col("dst").alias("id")))
        .distinct()
    )


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dst) with a null dst for nodes without out-edges."""
    out = simple_edges(edges).withColumnRenamed("src", "id")
    return node_ids(nodes, edges).join(out, "id", "left")


def coupling(fan_in: Column, fan_out: Column) -> Column:
    return fan_in * F.lit(FAN_IN_WEIGHT) + fan_out * F.lit(FAN_OUT_WEIGHT)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): one aggregate over both edge ends, so one shuffle serves all."""
    e = simple_edges(edges)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = (
        e.select(F.col("src").alias("id"), zero.alias("i"), one.alias("o"))
        .unionByName(e.select(F.col("dst").alias("id"), one.alias("i"), zero.alias("o")))
        .unionByName(nodes.select("id", zero.alias("i"), zero.alias("o")))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in/out, coupling, instability, degree centrality and hub score of every node."""
    d = degrees(nodes, edges)
    n = d.agg(F.count("*")).scalar()
    total = F.col("fan_in") + F.col("fan_out")
    return d.withColumn("_n", n).select(
        "id",
        "fan_in",
        "fan_out",
        coupling(F.col("fan_in"), F.col("fan_out")).alias("coupling_score"),
        F.col("fan_in").alias("afferent"),
        F.col("fan_out").alias("efferent"),
        F.when(total > 0, F.col("fan_out") / total).otherwise(F.lit(0.0)).alias("instability"),
        F.when(F.col("_n") > 1, total / (2.0 * (F.col("_n") - 1)))
        .otherwise(F.lit(0.0))
        .alias("degree_centrality"),
        (F.col("fan_in") * 2 + F.col("fan_out")).alias("hub_score"),
    )


def value_at_percentile(df: DataFrame, score: str, percentile: float) -> DataFrame:
    """One row: the score at sorted position ``int(n * percentile / 100)``, last at most.

    Works on the histogram of the scores (score, rows), whose running total needs no sort of
    the rows themselves.
    """
    hist = df.groupBy(score).agg(F.count("*").alias("_rows"))
    n = hist.agg(F.sum("_rows")).scalar()
    index = F.least(F.floor(n * F.lit(float(percentile)) / F.lit(100.0)), n - 1)
    upto = _running_total(hist, score, "_rows")
    return upto.where(F.col("_upto") > index).agg(F.min(score).alias("threshold"))


def _running_total(hist: DataFrame, key: str, rows: str) -> DataFrame:
    """Running total of ``rows`` by ``key`` without one global window.

    Values are range-partitioned; each slice is summed on its own and shifted by the total of
    the slices before it (as many rows as slices).
    """
    from pyspark.sql import Window

    from strataweave.scratch import Scratch

    sliced = Scratch(hist.sparkSession, "running").save(
        hist.repartitionByRange(key).withColumn("_slice", F.spark_partition_id())
    )
    inside = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sliced.groupBy("_slice")
        .agg(F.sum(rows).alias("_s"))
        .select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))
    )
    return sliced.join(F.broadcast(shift), "_slice").select(
        key, (F.sum(rows).over(inside) + F.col("_shift")).alias("_upto")
    )


def at_or_above_percentile(df: DataFrame, score: str, percentile: float = 90) -> DataFrame:
    """Rows whose score reaches the percentile cut."""
    return df.where(F.col(score) >= value_at_percentile(df, score, percentile).scalar())
