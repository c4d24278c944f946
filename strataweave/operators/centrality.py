"""Centralities that need distances or repeated sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.adjacency import degrees, node_degrees, node_ids, simple_edges
from strataweave.operators.ordering import topological_layers, topological_order, traverse
from strataweave.operators.sketches import distances
from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, skew_join

# links that one bucket holds at most, unless there are as few buckets as cores
BUCKET_LINKS = 50_000_000
# a wave with less than one of so many rows that were reached is a small one
FEW_FRONTS = 4
# (start, node) pairs of nodes with a small reach that are searched at a time
SMALL_PAIRS = 50_000_000


def betweenness(
    nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, batches: int = 1
) -> DataFrame:
    """(id, betweenness, exact): directed, unweighted, divided by (n-1)(n-2).

    Shortest-path counts move outward from every source in waves of (source, node, paths), and
    dependencies move back over the same waves. ``batches`` splits the sources so that only a
    part of the source x node state is on disk at a time. With ``sources(id)`` only those start
    nodes are searched, the sum is scaled by n / sources, and ``exact`` is false.
    """
    scratch = Scratch(edges.sparkSession, "betweenness")
    ids = scratch.save(node_ids(nodes, edges))
    links = scratch.save(simple_edges(edges).where("src <> dst"))
    hot_src, hot_dst = hot_keys(links, "src"), hot_keys(links, "dst")
    n = ids.count()
    # only a node with an out-edge can be the source of a path through another node
    origin = links.select(F.col("src").alias("id")).distinct()
    scale = 1.0
    if sources is not None:
        picked = scratch.save(sources.select("id").distinct())
        scale = n / max(picked.count(), 1)
        origin = origin.join(picked, "id", "left_semi")
    total: DataFrame | None = None
    for b in range(batches):
        part = origin.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        sums = _dependencies(part, links, hot_src, hot_dst, scratch)
        total = sums if total is None else total.unionByName(sums)
    score = total.groupBy("id").agg(F.sum("part").alias("raw"))
    norm = float((n - 1) * (n - 2)) if n > 2 else 0.0
    value = F.coalesce("raw", F.lit(0.0)) * F.lit(scale / norm) if norm else F.lit(0.0)
    return ids.join(score, "id", "left").select(
        "id", value.alias("betweenness"), F.lit(sources is None).alias("exact")
    )


def _dependencies(origin, links, hot_src, hot_dst, scratch) -> DataFrame:
    """(id, part): summed path dependencies of one batch of sources."""
    outward = links.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    hot_out = None if hot_src is None else hot_src.withColumnRenamed("src", "id")
    waves = [
        scratch.save(origin.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))
    ]
    rows = [waves[0].count()]
    while True:
        front = waves[-1]
        sent = skew_join(
            front, outward, "id", hot_left=hot_keys(front, "id"), hot_right=hot_out
        )
        # what earlier waves have, in one scan; of few fronts only the rows of sources that still send
        seen = scratch.read(waves).select("s", "id")
        if FEW_FRONTS * rows[-1] < sum(rows):
            seen = seen.join(front.select("s"), "s", "left_semi")
        fresh = (
            sent.groupBy("s", F.col("to").alias("id"))
            .agg(F.sum("paths").alias("paths"))
            .join(seen, ["s", "id"], "left_anti")
        )
        wave = scratch.save(fresh)
        rows.append(wave.count())
        if rows[-1] == 0:
            scratch.drop(wave)
            break
        waves.append(wave)
    inward = links.select(F.col("dst").alias("id"), F.col("src").alias("from"))
    hot_in = None if hot_dst is None else hot_dst.withColumnRenamed("dst", "id")
    last = waves[-1].withColumn("delta", F.lit(0.0))
    gathered: list[DataFrame] = []
    for k in range(len(waves) - 1, 1, -1):
        share = last.select("s", "id", ((1.0 + F.col("delta")) / F.col("paths")).alias("give"))
        back = skew_join(
            share, inward, "id", hot_left=hot_keys(waves[k], "id"), hot_right=hot_in
        ).select("s", F.col("from").alias("id"), "give")
        got = back.groupBy("s", "id").agg(F.sum("give").alias("got"))
        # the inner side keeps only true predecessors: nodes of the wave before
        last = scratch.save(
            waves[k - 1]
            .join(got, ["s", "id"], "left")
            .select("s", "id", "paths", (F.coalesce("got", F.lit(0.0)) * F.col("paths")).alias("delta"))
        )
        gathered.append(last.where("delta > 0").groupBy("id").agg(F.sum("delta").alias("part")))
    if not gathered:
        return links.select(F.col("src").alias("id"), F.lit(0.0).alias("part")).limit(0)
    out = gathered[0]
    for more in gathered[1:]:
        out = out.unionByName(more)
    return out


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): (r-1)/sum(d) * (r-1)/(n-1) over the r nodes reached downstream."""
    ids = node_ids(nodes, edges)
    n = ids.agg(F.count("*")).scalar()
    starts = edges.select(F.col("src").alias("id")).distinct()
    reach = traverse(edges, starts, "down").groupBy(F.col("start").alias("id")).agg(
        F.count("*").alias("r"), F.sum("depth").alias("far")
    )
    return ids.join(reach, "id", "left").withColumn("n", n).select(
        "id",
        F.when(
            (F.col("far") > 0) & (F.col("n") > 1),
            (F.col("r") - 1) / F.col("far") * (F.col("r") - 1) / (F.col("n") - 1),
        )
        .otherwise(F.lit(0.0))
        .alias("score"),
    )


def closeness_sketched(nodes: DataFrame, edges: DataFrame, precision: int = 12, max_hops: int | None = None) -> DataFrame:
    """(id, score, reached): ``closeness`` of every node from distance sketches, whatever the size of its reach.

    Every node has a HyperLogLog sketch of the nodes it reaches within h hops, of 2 ** ``precision`` registers.
    A hop merges the sketches of a node's successors into its own, and the sum of distances follows from how much the
    estimates grow by the hop; see :mod:`strataweave.operators.sketches` for how no sketch is sent. An estimate has a
    standard error of about 1.04 / sqrt(2 ** ``precision``), 1.6 % by default; nodes that reach few others are searched
    again, exactly. The hops end when no register grows, which is after the longest shortest path, or after ``max_hops``.
    """
    scratch = Scratch(edges.sparkSession, "sketches")
    ids = scratch.save(node_ids(nodes, edges))
    n = ids.count()
    links = scratch.save(simple_edges(edges).where("src <> dst"))
    state = distances(ids, links, precision, max_hops, scratch)
    # a tenth more than what a sketch of this precision holds as a list, as these are estimates
    small = scratch.save(state.where((F.col("far") > 0) & (F.col("reached") <= (33 << precision) // 320)))
    pairs = small.agg(F.sum("reached")).first()[0]
    if pairs:
        near, batches = links, -(-pairs // SMALL_PAIRS)
        if max_hops is None:  # what they reach is small as well
            near = scratch.save(skew_join(links, small.select(F.col("id").alias("src")), "src", "left_semi", hot_left=hot_keys(links, "src")))
        for b in range(batches):
            part = small.select("id").where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
            reach = traverse(near, part, "down", max_depth=max_hops).groupBy(F.col("start").alias("id"))
            exact = scratch.save(reach.agg(F.count("*").alias("r"), F.sum("depth").alias("f")))
            state = scratch.save(
                state.join(exact, "id", "left").select("id", F.coalesce("r", "reached").alias("reached"), F.coalesce("f", "far").alias("far")),
                replaces=state,
            )
    others = F.col("reached") - 1
    return state.select(
        "id",
        F.when((F.col("far") > 0) & (F.lit(n) > 1), others / F.col("far") * others / F.lit(max(n - 1, 1))).otherwise(0.0).alias("score"),
        "reached",
    )


def eigenvector(nodes: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(id, score): power iteration over incoming edges, L2-normalised, fixed sweeps.

    Each sweep adds the node's own score (shifted iteration), which keeps bipartite parts from
    oscillating and leaves the dominant direction unchanged.

    Links are a table bucketed by source that the sweeps join without a shuffle, in as few buckets as their size and the
    cores allow: what a bucket sends to a node is summed before it is shuffled, so a sweep moves at most one row for
    each bucket and node, however many links there are.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "eigenvector")
    ids = scratch.save(node_ids(nodes, edges))
    links = scratch.save(simple_edges(edges))
    hot = hot_keys(links, "src")
    n = ids.count()
    if n == 0:
        return ids.withColumn("score", F.lit(0.0))
    buckets = max(spark.sparkContext.defaultParallelism, -(-links.count() // BUCKET_LINKS))
    outward = links.select(F.col("src").alias("id"), "dst")
    if hot is None:
        outward = scratch.save_bucketed(outward.repartition(buckets, "id"), "id", buckets)
        scratch.drop(links)
    else:
        hot = hot.withColumnRenamed("src", "id")
    raw, norm = scratch.save(ids.withColumn("score", F.lit(1.0 / n**0.5))), 1.0
    for _ in range(iterations):
        score = raw.select("id", (F.col("score") / norm).alias("score"))
        sent = skew_join(score, outward, "id", hot_right=hot).select(F.col("dst").alias("id"), "score")
        step = score.unionByName(sent).groupBy("id").agg(F.sum("score").alias("score"))
        raw = scratch.save(step, replaces=raw)
        norm = raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).scalar()
    return raw.select("id", (F.col("score") / norm).alias("score"))


def all_metrics(
    nodes: DataFrame, edges: DataFrame, components: DataFrame, batches: int = 1
) -> DataFrame:
    """One wide row per node: degrees, betweenness, order and layer."""
    base = node_degrees(nodes, edges).select(
        "id", "fan_in", "fan_out", "coupling_score", "instability", "degree_centrality"
    )
    middle = betweenness(nodes, edges, batches=batches).select("id", "betweenness")
    order = topological_order(nodes, edges).select("id", "position")
    layer = topological_layers(nodes, edges, components)
    return base.join(middle, "id").join(order, "id").join(layer, "id")


def hotspots(metrics: DataFrame, top: int = 5, unstable: float = 0.7) -> DataFrame:
    """(report, id, score): most unstable, most between and most coupled nodes."""
    def best(report, column, rows):
        return rows.orderBy(F.desc(column), "id").limit(top).select(
            F.lit(report).alias("report"), "id", F.col(column).cast("double").alias("score")
        )

    return (
        best("instability", "instability", metrics.where(F.col("instability") > unstable))
        .unionByName(best("betweenness", "betweenness", metrics))
        .unionByName(best("coupling", "coupling_score", metrics))
    )


__all__ = ["all_metrics", "betweenness", "closeness", "closeness_sketched", "degrees", "eigenvector", "hotspots"]
