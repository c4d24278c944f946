"""Community detection on the undirected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.adjacency import degrees, node_ids, undirected
from strataweave.operators.clusters import main_cluster
from strataweave.scratch import Scratch
from strataweave.skew import HOT_ROWS, hot_keys, skew_join

# of so many nodes the communities are broadcast in each round, and so many links make a bucket unless there are fewer than cores
FEW_NODES, BUCKET_LINKS = 500_000, 2_000_000
# less than one of so many nodes that move are few
FEW_MOVES = 100


def _outward(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, dst) of ``links(src, dst)`` as a table bucketed by id, which every round joins without a shuffle; its hot ids."""
    buckets = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = links.select(F.col("src").alias("id"), "dst").repartition(buckets, "id")
    outward = scratch.save_bucketed(rows, "id", buckets)
    return outward, hot_keys(outward, "id", HOT_ROWS)


def _sent(state: DataFrame, outward: DataFrame, hot: DataFrame | None, own: DataFrame | None = None) -> DataFrame:
    """What every neighbour says and ``own`` rows, by the id they are said to: shuffled once for all aggregates by it.

    Where an id hears from more neighbours than one task should take, aggregates combine before they shuffle.
    """
    sent = skew_join(state, outward, "id", hot_right=hot)
    sent = sent.select(F.col("dst").alias("id"), *[c for c in state.columns if c != "id"])
    if own is not None:
        sent = sent.unionByName(own)
    return sent.repartition("id") if hot is None else sent


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(id, community): every node takes its neighbours' commonest label at once, smallest on ties.

    In the first round all labels differ, so a node takes that of its smallest neighbour and nothing is sent. Once few nodes
    move, only their neighbours count again: all others hear what they heard before.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    ids = nodes.select("id").distinct()
    links = undirected(edges).where("src <> dst")
    links = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    outward, hot = _outward(links, scratch)
    state = scratch.save(ids.select("id", F.col("id").alias("community"), F.lit(True).alias("moved")))
    n = moving = state.count()
    for i in range(iterations):
        if i == 0:
            choice = outward.groupBy("id").agg(F.min("dst").alias("pick"))
        else:
            said = state.select("id", "community")
            sent = _sent(said, outward, hot) if moving * FEW_MOVES >= n else _around(state, outward)
            votes = sent.groupBy("id", "community").agg(F.count("*").alias("n"))
            choice = votes.groupBy("id").agg(
                F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("pick")
            )
        state = scratch.save(
            state.join(choice, "id", "left").select(
                "id",
                F.coalesce("pick", "community").alias("community"),
                (F.col("pick").isNotNull() & (F.col("pick") != F.col("community"))).alias("moved"),
            ),
            replaces=state,
        )
        moving = state.where("moved").count()
        if moving == 0:
            break
    return state.select("id", "community")


def _around(state: DataFrame, outward: DataFrame) -> DataFrame:
    """What the neighbours of nodes that moved hear; links go both ways."""
    touched = outward.join(state.where("moved").select("id"), "id", "left_semi").select(F.col("dst").alias("id")).distinct()
    said = state.select(F.col("id").alias("dst"), "community")
    return outward.join(touched, "id", "left_semi").join(said, "dst").select("id", "community")


def main_cluster_communities(nodes: DataFrame, edges: DataFrame, components: DataFrame, more_than: int = 10) -> DataFrame:
    """(id, community) as the grouping report has them: the largest cluster only, if it has enough nodes."""
    main = Scratch(edges.sparkSession, "main").save(main_cluster(components))
    main = main.where(main.agg(F.count("*") > more_than).scalar())
    return label_propagation(main, edges)


def louvain(
    nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, sweeps: int = 20
) -> DataFrame:
    """(id, community): local modularity moves, half of the nodes per round.

    Gain of moving into a community: ``k_in/m - resolution * total * k / (2 m^2)`` with m the
    distinct undirected edges and k the in plus out degree. A node moves only when the gain
    beats the one of its present community (counted without itself). Halves are chosen by a
    hash that changes with the round, so two neighbours rarely swap at once; the partition with
    the highest modularity seen is returned, so a run is deterministic and never worse than
    singletons.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    ids = scratch.save(node_ids(nodes, edges))
    links = scratch.save(undirected(edges).where("src <> dst"))
    n_links = links.count()
    m = n_links / 2.0
    start = ids.select("id", F.col("id").alias("community"))
    if m == 0:
        return start
    weight = degrees(nodes, edges).select("id", (F.col("fan_in") + F.col("fan_out")).alias("k"))
    # links around each node; those around a community are counted from them
    weight = weight.join(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ends")), "id", "left")
    # the number of the round is a column, so all rounds run the same compiled code
    state = start.join(weight.na.fill(0, ["ends"]), "id").withColumn("sweep", F.lit(0))
    state = scratch.save(state)
    few = state.count() <= FEW_NODES
    if few:
        outward, hot = _with_own(links, n_links, state, scratch), None
    else:
        outward, hot = _outward(links, scratch)
    best, best_score, still = None, 0.0, 0
    turn = F.pmod(F.xxhash64("id", F.shiftright("sweep", 1)), F.lit(2)) == F.col("sweep") % 2
    for _ in range(2 * sweeps):
        totals = state.groupBy("community").agg(F.sum("k").alias("total"))
        if few:
            mine, options = None, _asked(state, totals, outward, turn)
        else:
            mine = scratch.save(
                skew_join(state.select("id", "community", "k", "ends", "sweep"), totals, "community", hot_left=hot_keys(state, "community"))
            )
            options = _told(mine, outward, hot)
        scored = (
            options.withColumn("rest", F.col("total") - F.when(F.col("community") == F.col("current"), F.col("k")).otherwise(0))
            .withColumn(
                "gain",
                F.round(
                    F.col("k_in") / F.lit(m)
                    - F.lit(resolution) * F.col("rest") * F.col("k") / F.lit(2.0 * m * m),
                    12,
                ),
            )
        )
        at_home = F.col("community") == F.col("current")
        choice = scored.groupBy("id").agg(
            F.min_by("community", F.struct(-F.col("gain"), F.when(at_home, 0).otherwise(1), F.col("community"))).alias("pick"),
            F.first("current").alias("current"),
            F.first("k").alias("k"),
            F.first("ends").alias("ends"),
            F.first("sweep").alias("sweep"),
            F.sum(F.when(at_home, F.col("k_in")).otherwise(0)).alias("inner"),
        )
        picked = F.when(turn, F.col("pick")).otherwise(F.col("current"))
        nxt = scratch.save(
            choice.select(
                "id", picked.alias("community"), "k", "ends", (F.col("sweep") + 1).alias("sweep"),
                (picked != F.col("current")).alias("moved"), "current", "inner",
            )
        )
        if mine is not None:
            scratch.drop(mine)
        # links inside and around each community were counted on the way: the score of the state before
        per = nxt.groupBy("current").agg((F.sum("inner") / 2).alias("inner"), F.sum("ends").alias("ends"), F.max("moved").alias("moved"))
        score, moved = _score(per, m, F.max("moved"))
        best, best_score = _better(best, best_score, state, score, scratch)
        state = nxt
        still = 0 if moved else still + 1
        if still >= 2:  # neither half wants to move
            break
    best, _ = _better(best, best_score, state, _modularity_sum(state, links, m), scratch)
    return best.select("id", "community")


def _with_own(links: DataFrame, n_links: int, state: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, dst) of ``links`` and a row (id, id) for each node, bucketed by id into no more buckets than they need."""
    buckets = max(links.sparkSession.sparkContext.defaultParallelism, -(-n_links // BUCKET_LINKS))
    rows = links.toDF("id", "dst").unionByName(state.select("id", F.col("id").alias("dst")))
    return scratch.save_bucketed(rows.repartition(buckets, "id"), "id", buckets)


def _asked(state: DataFrame, totals: DataFrame, outward: DataFrame, turn: Column) -> DataFrame:
    """What each node may choose: its own community, and those of its neighbours if it is the node's turn.

    Links go both ways, so a node asks its neighbours: their communities are broadcast and no link is shuffled.
    """
    own = F.broadcast(state.select("id", F.col("community").alias("current"), "k", "ends", "sweep"))
    theirs = F.broadcast(state.select(F.col("id").alias("dst"), "community"))
    asked = outward.join(theirs, "dst").join(own, "id").where(turn | (F.col("community") == F.col("current")))
    options = asked.groupBy("id", "community").agg(F.count_if(F.col("id") != F.col("dst")).alias("k_in"))
    return options.join(own, "id").join(F.broadcast(totals), "community")


def _told(mine: DataFrame, outward: DataFrame, hot: DataFrame | None) -> DataFrame:
    """What each node may choose, from what its neighbours say."""
    with_links = lambda n: mine.select("id", "community", "total", F.lit(n).cast("long").alias("k_in"))
    options = _sent(with_links(1), outward, hot, own=with_links(0)).groupBy("id", "community").agg(
        F.sum("k_in").alias("k_in"), F.max("total").alias("total")
    )
    return options.join(mine.select("id", F.col("community").alias("current"), "k", "ends", "sweep").hint("merge"), "id")


def _better(best: DataFrame | None, best_score: float, state: DataFrame, score: float, scratch: Scratch):
    """The better of two partitions with its score, the earlier one if they are as good; the other is dropped."""
    if best is None:
        return state, score
    if score > best_score + 1e-12:
        scratch.drop(best)
        return state, score
    scratch.drop(state)
    return best, best_score


def _ends(links: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    return skew_join(
        skew_join(links, a, "src", hot_left=hot_keys(links, "src")), b, "dst", hot_left=hot_keys(links, "dst")
    )


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, internal, external, cohesion, modularity) on distinct undirected edges.

    ``cohesion`` is internal / (internal + external) edges; ``modularity`` is the community's
    term ``internal/m - (degree/2m)^2``.
    """
    links = undirected(edges).where("src <> dst")
    joined = _ends(links, labels)
    per = joined.groupBy(F.col("cs").alias("community")).agg(
        (F.count_if(F.col("cs") == F.col("cd")) / 2).cast("long").alias("internal"),
        F.count_if(F.col("cs") != F.col("cd")).alias("external"),
        F.count("*").alias("ends"),
    )
    m = links.agg(F.count("*") / 2).scalar()
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    per = sizes.join(per, "community", "left").withColumn("m", m)
    internal, external = F.coalesce("internal", zero), F.coalesce("external", zero)
    share = F.coalesce("ends", zero) / (2 * F.col("m"))
    return per.select(
        "community",
        "size",
        internal.alias("internal"),
        external.alias("external"),
        F.when(internal + external > 0, internal / (internal + external)).otherwise(0.0).alias("cohesion"),
        F.when(F.col("m") > 0, internal / F.col("m") - share * share).otherwise(0.0).alias("modularity"),
    )


def _modularity_sum(state: DataFrame, links: DataFrame, m: float) -> float:
    joined = _ends(links, state).groupBy("cs").agg(
        (F.count_if(F.col("cs") == F.col("cd")) / 2).alias("inner"), F.count("*").alias("ends")
    )
    return _score(joined, m)[0]


def _score(per: DataFrame, m: float, *more: Column) -> tuple:
    """Modularity from the ``inner`` links and the ``ends`` of links of every community, and ``more`` aggregates."""
    term = F.col("inner") / F.lit(m) - F.pow(F.col("ends") / F.lit(2.0 * m), F.lit(2.0))
    total, *rest = per.agg(F.sum(term), *more).first()
    return round(total or 0.0, 12), *rest


def community_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, internal, external, ratio) over directed edges leaving the members."""
    e = edges.select("src", "dst").distinct()
    joined = _ends(e, labels).groupBy(F.col("cs").alias("community")).agg(
        F.count_if(F.col("cs") == F.col("cd")).alias("internal"), F.count_if(F.col("cs") != F.col("cd")).alias("external")
    )
    return joined.withColumn(
        "ratio", F.col("internal") / F.greatest(F.col("external"), F.lit(1))
    )
