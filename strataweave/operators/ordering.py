"""Reachability, topological order, layering and redundant edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.adjacency import node_ids, simple_edges
from strataweave.operators.chains import contract, expand_depths
from strataweave.operators.cycles import condense, with_scc
from strataweave.operators.spread import spread, waves
from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, number_rows, skew_join


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow: ``down`` (dependencies), ``up`` (dependents) or ``both``."""
    e = edges.select("src", "dst")
    rev = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "down":
        return e.distinct()
    if direction == "up":
        return rev.distinct()
    if direction == "both":
        return e.unionByName(rev).distinct()
    raise ValueError(f"unknown direction {direction!r}")


def traverse(
    edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None
) -> DataFrame:
    """(start, id, depth): breadth-first depth from every start in ``starts(id)``.

    A start that is in no edge returns itself at depth 0.
    """
    seeds = starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("value"))
    reached = spread(
        seeds.distinct(),
        oriented(edges, direction),
        "min",
        send=lambda v: v + 1,
        keys=["start"],
        max_rounds=max_depth,
    )
    return reached.withColumnRenamed("value", "depth")


def expand(edges: DataFrame, starts: DataFrame, degree: int, direction: str = "both") -> DataFrame:
    """Nodes within ``degree`` steps (clamped to 1..10) of any start, with the nearest depth."""
    degree = max(1, min(10, degree))
    seeds = starts.select("id", F.lit(0).cast("long").alias("value")).distinct()
    near = spread(
        seeds, oriented(edges, direction), "min", send=lambda v: v + 1, max_rounds=degree
    )
    return near.withColumnRenamed("value", "depth")


def _others(nodes: DataFrame, levels: list, inside: DataFrame) -> DataFrame:
    """Nodes that no contraction took out, those that an end of a chain is known by included."""
    ends = None
    for level in levels:
        for end in ("head", "tail"):
            found = level.members.select(F.col(end).alias("id"))
            ends = found if ends is None else ends.unionByName(found)
    return nodes.select("id").unionByName(ends).distinct().join(inside, "id", "left_anti")


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, wave) of the nodes a topological sort can emit, and the residual edges.

    ``wave`` is the longest path from a node without in-edges. Residual edges are all edges
    among nodes on or after a cycle.
    """
    scratch = Scratch(edges.sparkSession, "peel")
    links = scratch.save(simple_edges(edges))
    core, levels = contract(links)
    inside = None
    for level in levels:
        ids = level.members.select("id").unionByName(level.rings.select("id"))
        inside = ids if inside is None else inside.unionByName(ids)
    outside = nodes.select("id") if inside is None else _others(nodes, levels, inside)
    placed = scratch.save(expand_depths(waves(outside, core), levels, scratch))
    stuck = placed.where("wave IS NULL").select(F.col("id").alias("src"))
    return placed.where("wave IS NOT NULL"), links.join(stuck, "src", "left_semi").select("src", "dst")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave, position); wave and position are null on or after a cycle.

    Positions follow (wave, id). A wave can be most of the graph, so ids are numbered in range
    slices and not by one window.
    """
    emitted, _ = peel(nodes, edges)
    ordered = number_rows(emitted, ["wave", "id"])
    return node_ids(nodes, edges).join(ordered, "id", "left")


def residual_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return peel(nodes, edges)[1]


def is_dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: whether a topological order places every node."""
    return residual_edges(nodes, edges).agg((F.count("*") == 0).alias("is_dag"))


def topological_layers(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(id, layer): longest path from the roots, with all members of a cycle on one layer."""
    dag = condense(edges, components).select(
        F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")
    )
    owners = components.select(F.col("scc_id").alias("id")).distinct()
    placed, _ = peel(owners, dag)
    layer_of = placed.select(F.col("id").alias("scc_id"), F.col("wave").alias("layer"))
    scratch = Scratch(edges.sparkSession, "layers")
    layered = skew_join(components, layer_of, "scc_id", hot_left=hot_keys(components, "scc_id"))
    return scratch.save(layered.select("id", "layer"))


def transitive_edges(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, transitive): whether another path makes the edge redundant.

    Edges between components are judged on the acyclic condensation, where the answer is
    unique: (u, v) is redundant when another successor of u reaches v. Edges inside a cycle
    stay, self-loops are redundant. Only sources with several successors whose targets have
    several predecessors and lie at least two layers below are searched, and a search never
    passes the deepest layer it has to decide.
    """
    scratch = Scratch(edges.sparkSession, "transitive")
    dag = scratch.save(
        condense(edges, components).select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst"))
    )
    owners = components.select(F.col("scc_id").alias("id")).distinct()
    layer = peel(owners, dag)[0]
    src_wave = layer.select(F.col("id").alias("src"), F.col("wave").alias("ws"))
    dst_wave = layer.select(F.col("id").alias("dst"), F.col("wave").alias("wd"))
    hot_src, hot_dst = hot_keys(dag, "src"), hot_keys(dag, "dst")
    placed = skew_join(skew_join(dag, src_wave, "src", hot_left=hot_src), dst_wave, "dst", hot_left=hot_dst)
    many_out = dag.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    many_in = dag.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    doubtful = scratch.save(
        placed.where("wd >= ws + 2")
        .join(many_out, "src", "left_semi")
        .join(many_in, "dst", "left_semi")
        .select("src", "dst", "wd")
    )
    depth = doubtful.groupBy("src").agg(F.max("wd").alias("deep"))
    # first steps of every search, then all nodes met on the way down (not the first step itself)
    first = skew_join(placed.select("src", "dst", "wd"), depth, "src", hot_left=hot_src).where("wd < deep")
    seeds = first.select(
        F.col("src").alias("origin"), "deep", F.col("dst").alias("id"), F.lit(0).alias("value")
    )
    reached = spread(
        seeds,
        dag,
        "max",
        send=lambda v: F.lit(1),
        keys=["origin", "deep"],
        admit=lambda m: m.join(layer.withColumnRenamed("id", "dst"), "dst").where("me OR wave <= deep").select(m.columns),
    )
    redundant = doubtful.join(
        reached.where("value = 1").select(F.col("origin").alias("src"), F.col("id").alias("dst")).distinct(),
        ["src", "dst"],
        "left_semi",
    ).select(F.col("src").alias("src_scc"), F.col("dst").alias("dst_scc"), F.lit(True).alias("_r"))
    judged = with_scc(edges, components).join(redundant, ["src_scc", "dst_scc"], "left")
    return judged.select(
        "src",
        "dst",
        F.when(F.col("src") == F.col("dst"), True)
        .otherwise(F.coalesce("_r", F.lit(False)))
        .alias("transitive"),
    )
