"""Strongly connected components, cycle edges and bounded cycle enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.adjacency import node_ids, simple_edges
from strataweave.operators.chains import contract, expand_components
from strataweave.operators.spread import spread, waves
from strataweave.scratch import Scratch
from strataweave.skew import HOT_ROWS, hot_keys, number_rows, skew_join

# graphs of so many edges are searched by some of them first, by so many a node
DENSE, PICKS = 200_000, 4
# a report of cycles looks at so many of the smallest starts first, then up to so many times as far
FIRST_STARTS, MORE_STARTS = 1000, 64


def _both_ways(edges: DataFrame) -> DataFrame:
    """The graph beside its reverse: ids become (way, id), so one pass follows both directions."""
    at = lambda way, c: F.struct(F.lit(way).alias("way"), F.col(c).alias("id"))
    forward = edges.select(at(0, "src").alias("src"), at(0, "dst").alias("dst"))
    return forward.unionByName(edges.select(at(1, "dst").alias("src"), at(1, "src").alias("dst")))


def _after_cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges among nodes that a cycle reaches: where it reaches the source, it reaches both ends."""
    reached = waves(edges.select(F.col("src").alias("id")).limit(0), edges).where("wave IS NULL")
    reached = scratch.save(reached.select(F.col("id").alias("src")))
    return scratch.save(edges.join(reached, "src", "left_semi").select("src", "dst"))


def _between(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges among nodes that a cycle reaches and that reach a cycle; the reverse is only searched after cycles."""
    turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if edges.isEmpty():
        return edges
    rest = _after_cycles(edges, scratch)
    return rest if rest.isEmpty() else turned(_after_cycles(turned(rest), scratch))


def _core_components(rest: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, value) of the nodes in components of two or more; ``value`` is a member of the component.

    The smallest id that reaches a node and the smallest id it reaches are spread in one pass. Where both are
    equal, that id owns the node's component. Nodes of one component always share both labels,
    so the remainder repeats on the edges whose ends agree on them.
    """
    rest = _between(rest, scratch)
    found: list[DataFrame] = []
    while not rest.isEmpty():
        doubled = _both_ways(rest)
        seeds = doubled.select(F.col("src").alias("id")).distinct().withColumn("value", F.col("id.id"))
        labels = spread(seeds, doubled, "min").groupBy("id.id").agg(
            F.max(F.when(F.col("id.way") == 0, F.col("value"))).alias("above"),
            F.max(F.when(F.col("id.way") == 1, F.col("value"))).alias("below"),
        )
        labels = scratch.save(labels)
        found.append(labels.where("above = below").select("id", F.col("above").alias("value")))
        left = labels.where("above <> below").select("id", F.struct("above", "below").alias("label"))
        if left.isEmpty():
            break
        ends = skew_join(rest, left.withColumnRenamed("id", "src"), "src", hot_left=hot_keys(rest, "src"))
        other = left.select(F.col("id").alias("dst"), F.col("label").alias("label_dst"))
        ends = skew_join(ends, other, "dst", hot_left=hot_keys(rest, "dst")).where("label = label_dst")
        rest = _between(scratch.save(ends.select("src", "dst")), scratch)
    members = None
    for more in found:
        members = more if members is None else members.unionByName(more)
    return members


def _cyclic(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, value) of the nodes in components of two or more; ``value`` is a member. ``links`` have no self-loops."""
    core, levels = contract(links)
    members = _core_components(core.where("src <> dst").select("src", "dst"), scratch)
    if members is None:
        members = links.select(F.col("src").alias("id"), F.col("src").alias("value")).limit(0)
    return scratch.save(expand_components(members, levels, scratch))


def _merge(links: DataFrame, part: DataFrame, share: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The graph with every component of ``part``, some of its edges, as one node; and (id, owner) of what was merged."""
    owners = _cyclic(part, scratch).withColumnRenamed("value", "owner")
    # what is hot among all edges shows among those picked by hash
    floor = max(1, int(share * HOT_ROWS / 2))
    out = links
    for end in ("src", "dst"):
        out = skew_join(out, owners.toDF(end, f"{end}_owner"), end, "left", hot_left=hot_keys(part, end, floor))
    a, b = F.coalesce("src_owner", "src").alias("src"), F.coalesce("dst_owner", "dst").alias("dst")
    return scratch.save(out.select(a, b).where("src <> dst").distinct()), owners


def _without_dense_parts(links: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """``links`` with strongly connected parts merged while there are many edges a node, and what was merged, in order.

    Components of some of the edges lie inside components of all edges. So a few edges a node, picked by hash, are
    searched first; where they hold most nodes together, few edges are left for the search of the rest, which
    misses none.
    """
    merged: list[DataFrame] = []
    n_links = links.count()
    while n_links >= least:
        n_nodes = max(links.agg(F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first())
        share = PICKS * n_nodes / n_links
        if share > 0.25:
            break
        picked = F.pmod(F.xxhash64("src", "dst", F.lit(len(merged))), F.lit(1 << 20)) < int(share * (1 << 20))
        part = scratch.save(links.where(picked))
        links, owners = _merge(links, part, share, scratch)
        merged.append(owners)
        before, n_links = n_links, links.count()
        if 2 * n_links > before:  # no cycles that some of the edges show
            break
    return links, merged


def scc(nodes: DataFrame, edges: DataFrame, dense: int = DENSE) -> DataFrame:
    """(id, scc_id, scc_size) with scc_id the smallest member.

    Of graphs with at least ``dense`` edges and many edges a node, the parts that a few of the edges hold together
    are merged first. Chains are contracted next, by pointer jumping, so a long path or ring takes rounds by the logarithm of its
    length. Everything of the rest that does not lie between cycles is dropped before labels are spread. At the
    end chain nodes get the component of the chain's ends, and merged nodes that of their owner.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    links, merged = _without_dense_parts(scratch.save(simple_edges(edges).where("src <> dst")), scratch, dense)
    members = _cyclic(links, scratch)
    for owners in reversed(merged):
        # an owner is one of its members
        owned = skew_join(owners, members.toDF("owner", "value"), "owner", "left", hot_left=hot_keys(owners, "owner", HOT_ROWS))
        owned = owned.select("id", F.coalesce("value", "owner").alias("value"))
        members = scratch.save(owned.unionByName(members.join(owners.select("id"), "id", "left_anti")))
    ids = node_ids(nodes, edges)
    sizes = members.groupBy("value").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    # a giant component is one row of sizes, met by many members
    members = skew_join(members, sizes, "value", hot_left=hot_keys(members, "value"))
    return scratch.save(
        ids.join(members, "id", "left").select(
            "id",
            F.coalesce("low", "id").alias("scc_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("scc_size"),
        )
    )


def with_scc(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges with the component id and size of both ends."""
    e = simple_edges(edges)
    a = components.select(
        F.col("id").alias("src"), F.col("scc_id").alias("src_scc"), F.col("scc_size").alias("src_size")
    )
    b = components.select(F.col("id").alias("dst"), F.col("scc_id").alias("dst_scc"))
    out = skew_join(e, a, "src", hot_left=hot_keys(e, "src"))
    return skew_join(out, b, "dst", hot_left=hot_keys(e, "dst"))


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src_scc, dst_scc): edges between different components, acyclic."""
    return (
        with_scc(edges, components)
        .where("src_scc <> dst_scc")
        .select("src_scc", "dst_scc")
        .distinct()
    )


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside a component of two or more nodes, and self-loops."""
    return with_scc(edges, components).where("src_scc = dst_scc").where(
        "src_size > 1 OR src = dst"
    ).select("src", "dst")


def scc_ranking(edges: DataFrame, components: DataFrame, min_size: int = 2) -> DataFrame:
    """(rank, scc_id, size, internal_edges, external_edges) of the cyclic components, largest first."""
    joined = with_scc(edges, components)
    # both ends of an edge in one pass
    inner = F.col("src_scc") == F.col("dst_scc")
    end = lambda c, inside: F.struct(F.col(c).alias("scc_id"), F.lit(inside).alias("inner"))
    ends = F.when(inner, F.array(end("src_scc", True))).otherwise(F.array(end("src_scc", False), end("dst_scc", False)))
    touched = joined.select(F.inline(ends))
    counts = touched.groupBy("scc_id").agg(
        F.count_if("inner").alias("internal_edges"), F.count_if(~F.col("inner")).alias("external_edges")
    )
    sizes = components.groupBy("scc_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    found = sizes.join(counts, "scc_id", "left").select(
        "scc_id",
        "size",
        F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"),
        F.coalesce("external_edges", F.lit(0)).alias("external_edges"),
    )
    ranked = number_rows(found, [F.desc("size"), F.col("scc_id")], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def largest_sccs(components: DataFrame, top: int = 5) -> DataFrame:
    """(scc_id, size, id): the members of the ``top`` largest cyclic components."""
    sizes = components.where("scc_size > 1").select("scc_id", F.col("scc_size").alias("size")).distinct()
    largest = sizes.orderBy(F.desc("size"), "scc_id").limit(top)
    return components.join(F.broadcast(largest), "scc_id").select("scc_id", "size", "id")  # top rows


def scc_summary(components: DataFrame) -> DataFrame:
    """One row: total_sccs, cyclic_sccs, largest_scc."""
    sizes = components.groupBy("scc_id").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("total_sccs"),
        F.count_if(F.col("size") > 1).alias("cyclic_sccs"),
        F.max("size").alias("largest_scc"),
    )


def enumerate_cycles(
    edges: DataFrame,
    components: DataFrame,
    max_length: int,
    max_cycles: int | None = None,
    self_loops: bool = False,
) -> DataFrame:
    """(cycle, length): simple cycles of at most ``max_length`` nodes, smallest node first.

    ``max_cycles`` is the report size: shortest cycles first, then by node order. Longer cycles, and of one length those
    that start at larger nodes, are only looked for while the ones before are too few, so the report is the same as
    if all had been listed.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    inner = with_scc(edges, components).where("src_scc = dst_scc AND src <> dst")
    inner = scratch.save(inner.select("src", "dst"))
    loops = simple_edges(edges).where("src = dst").select(F.array("src").alias("path")) if self_loops else None
    if max_cycles is None:
        return _cycles_up_to(inner, loops, max_length)
    found = scratch.save(_cycles_up_to(inner, loops, min(2, max_length)).orderBy("length", "cycle").limit(max_cycles))
    starts, n = None, 0
    for length in range(3, max_length + 1):
        lo, hi = 0, FIRST_STARTS
        while found.count() < max_cycles:
            if starts is None:
                starts = scratch.save(number_rows(inner.where("src < dst").select(F.col("src").alias("start")).distinct(), ["start"], "at"))
                n = starts.count()
            if lo >= n:
                break
            # all shorter cycles are found, and all of this length that start at smaller nodes
            part = starts.where((F.col("at") >= lo) & (F.col("at") < hi)).select("start")
            more = _cycles_up_to(inner, None, length, part).where(F.col("length") == length)
            found = scratch.save(found.unionByName(more.orderBy("cycle").limit(max_cycles)).orderBy("length", "cycle").limit(max_cycles))
            lo, hi = hi, hi * MORE_STARTS
    return found.orderBy("length", "cycle")


def _cycles_up_to(inner: DataFrame, loops: DataFrame | None, max_length: int, starts: DataFrame | None = None) -> DataFrame:
    """All simple cycles of at most ``max_length`` nodes, and the paths of ``loops``; with ``starts(start)`` those that start there.

    ``inner`` are edges inside components. Paths start at the smallest node of their cycle, so only larger nodes of
    the same component extend them. A path is kept only while its last node can still return to the start within
    the remaining steps (distances to the start are computed first, inside the component).
    """
    scratch = Scratch(inner.sparkSession, "cycles")
    hot = hot_keys(inner, "src")
    steps = inner.select(F.col("src").alias("last"), F.col("dst").alias("nxt"))
    begun = lambda df: df if starts is None else df.join(starts, "start", "left_semi")

    # home(start, id, value): steps from id back to start using nodes >= start only
    seeds = begun(inner.where("src > dst").select(
        F.col("dst").alias("start"), F.col("src").alias("id"), F.lit(1).alias("value")
    ))
    home = scratch.save(
        spread(
            seeds.distinct(),
            inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
            "min",
            send=lambda v: v + 1,
            keys=["start"],
            max_rounds=max(max_length - 2, 0),
            admit=lambda m: m.where("dst > start"),
        )
    ).select("start", F.col("id").alias("last"), F.col("value").alias("back"))

    paths = (
        begun(inner.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")))
        .join(home, ["start", "last"])
        .where(F.col("back") <= max_length - 1)
    )
    done: list[DataFrame] = [] if loops is None else [loops]
    for length in range(2, max_length + 1):
        paths = scratch.save(paths.select("start", "last", "path", "back"))
        done.append(paths.where("back = 1").select("path"))
        if length == max_length or paths.isEmpty():
            break
        grown = skew_join(
            paths.select("start", "last", "path"), steps, "last",
            hot_left=hot_keys(paths, "last"), hot_right=_rename(hot, "src", "last"),
        )
        grown = grown.where(
            (F.col("nxt") > F.col("start")) & ~F.array_contains("path", F.col("nxt"))
        ).select(
            "start", F.col("nxt").alias("last"), F.concat("path", F.array("nxt")).alias("path")
        )
        paths = grown.join(home, ["start", "last"]).where(
            F.col("back") <= max_length - length
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("path").alias("cycle"), F.size("path").cast("long").alias("length"))


def _rename(df: DataFrame | None, old: str, new: str) -> DataFrame | None:
    return None if df is None else df.withColumnRenamed(old, new)


def invalid_cycle_steps(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, src, dst): steps of a claimed cycle that are not edges; empty when all hold."""
    pairs = cycles.select(
        "cycle",
        F.explode(
            F.arrays_zip(
                F.col("cycle").alias("src"),
                F.concat(
                    F.slice("cycle", F.lit(2), F.size("cycle")), F.slice("cycle", 1, 1)
                ).alias("dst"),
            )
        ).alias("s"),
    ).select("cycle", "s.src", "s.dst")
    return pairs.join(simple_edges(edges), ["src", "dst"], "left_anti").select("cycle", "src", "dst")
