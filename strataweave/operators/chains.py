"""Graphs without their chains: paths through nodes with one way in and one way out become single edges.

Loops over a graph take as many rounds as its paths are long. A long path of nodes with one predecessor and one
successor carries no choice, so it is contracted by pointer jumping: every chain node points at its successor, and each
round doubles how far the pointers reach, so a chain of n nodes ends after log2(n) rounds. What the contraction leaves
may have chains again (two parallel chains become one edge), so it is repeated until few are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, skew_join

# so many chain nodes, or chains of so many steps, are hops that cost less than a contraction
FEW, SHORT = 64, 16


@dataclass
class Level:
    """What one contraction took out."""

    members: DataFrame  # (id, head, tail, offset): chain nodes, the nodes at the chain's ends, steps from the head
    rings: DataFrame  # (id, ring): nodes of cycles that nothing enters or leaves, and the smallest of them


def _degrees(edges: DataFrame) -> DataFrame:
    loop = (F.col("src") == F.col("dst")).alias("loop")
    ends = edges.select(
        F.inline(F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), loop),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), loop),
        ))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("loop").alias("loop"))


def _jump(inner: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, last, steps, low): the last chain node ahead of each, steps to it, and the smallest id up to there.

    ``links(id, next, steps)`` are edges between chain nodes. On a ring no node is the last one.
    """
    state = inner.join(links, "id", "left").select(
        "id", F.coalesce("next", "id").alias("last"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"),
        F.col("id").alias("low"),
    )
    state = scratch.save(state)
    rounds = max(1, (state.count() - 1).bit_length())
    for _ in range(rounds):
        # a pointer has arrived when what it points at points at itself
        ahead = state.select(
            F.col("id").alias("last"), F.col("last").alias("then"), F.col("steps").alias("more"), F.col("low").alias("low2")
        )
        step = state.join(ahead, "last").select(
            "id", F.col("then").alias("last"), (F.col("steps") + F.col("more")).alias("steps"),
            F.least("low", "low2").alias("low"), (F.col("then") != F.col("last")).alias("moved"),
        )
        step = scratch.save(step, replaces=state)
        state = step.drop("moved")
        state._scratch_path = step._scratch_path
        if step.where("moved").isEmpty():
            break
    return state


def _contract_once(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, Level] | None:
    """``edges(src, dst, steps)`` without the chains there are now, or None if there are few or only short ones."""
    inner = scratch.save(_degrees(edges).where("o = 1 AND i = 1 AND NOT loop").select("id"))
    if inner.count() < FEW:
        scratch.drop(inner)
        return None
    out = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi")
    into = edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = out.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    state = _jump(inner, links.select(F.col("src").alias("id"), F.col("dst").alias("next"), "steps"), scratch)
    if (state.agg(F.max("steps")).first()[0] or 0) < SHORT:
        return None
    leaving = out.join(inner.withColumnRenamed("id", "dst"), "dst", "left_anti")
    entering = into.join(inner.withColumnRenamed("id", "src"), "src", "left_anti")
    # a chain is named by its last node; its first one is entered from the head
    first = state.join(entering.select(F.col("dst").alias("id"), F.col("src").alias("head"), F.col("steps").alias("enter")), "id")
    first = first.select("last", "head", "enter", F.col("steps").alias("long"))
    chains = scratch.save(
        first.join(leaving.select(F.col("src").alias("last"), F.col("dst").alias("tail"), F.col("steps").alias("leave")), "last")
    )
    members = scratch.save(
        state.join(chains, "last").select(
            "id", "head", "tail", (F.col("enter") + F.col("long") - F.col("steps")).cast("long").alias("offset")
        )
    )
    rings = scratch.save(state.join(chains.select("last"), "last", "left_anti").select("id", F.col("low").alias("ring")))
    rest = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_anti").join(
        inner.withColumnRenamed("id", "dst"), "dst", "left_anti"
    )
    short = chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.col("enter") + F.col("long") + F.col("leave")).alias("steps"))
    core = rest.select("src", "dst", "steps").unionByName(short)
    return scratch.save(core.groupBy("src", "dst").agg(F.max("steps").cast("long").alias("steps"))), Level(members, rings)


def contract(edges: DataFrame) -> tuple[DataFrame, list[Level]]:
    """(src, dst, steps) of the graph without chains, and what was taken out, in order.

    ``edges(src, dst)`` are distinct. ``steps`` is the longest chain that an edge stands for. A chain that ends where
    it starts becomes a self-loop, and nodes with a self-loop are in no chain.
    """
    scratch = Scratch(edges.sparkSession, "chains")
    core = scratch.save(edges.select("src", "dst", F.lit(1).cast("long").alias("steps")))
    levels: list[Level] = []
    while (found := _contract_once(core, scratch)) is not None:
        core = found[0]
        levels.append(found[1])
    return core, levels


def expand_components(members: DataFrame, levels: list[Level], scratch: Scratch) -> DataFrame:
    """``members(id, value)`` of the core's cyclic components with the chain nodes and rings that are on cycles.

    A chain is on a cycle if its ends are one node or lie in one component.
    """
    for level in reversed(levels):
        members = scratch.save(members)
        head, tail = (members.toDF(end, f"{end}_value") for end in ("head", "tail"))
        ends = skew_join(level.members, head, "head", "left", hot_left=hot_keys(level.members, "head"))
        ends = skew_join(ends, tail, "tail", "left", hot_left=hot_keys(level.members, "tail"))
        owner = F.coalesce("head_value", "head")
        on = scratch.save(
            ends.where(owner.eqNullSafe(F.coalesce("tail_value", "tail"))).select("id", "head", owner.alias("value"))
        )
        alone = on.select(F.col("head").alias("id"), "value").where("id = value").distinct()
        fresh = on.select("id", "value").unionByName(alone.join(members, "id", "left_anti"))
        members = members.unionByName(fresh).unionByName(level.rings.select("id", F.col("ring").alias("value")))
    return members


def expand_depths(placed: DataFrame, levels: list[Level], scratch: Scratch) -> DataFrame:
    """``placed(id, wave)`` of the core with the waves of the chain nodes; null after a cycle, and on rings."""
    for level in reversed(levels):
        placed = scratch.save(placed)
        head = placed.toDF("head", "wave")
        inside = skew_join(level.members, head, "head", hot_left=hot_keys(level.members, "head"))
        none = level.rings.select("id", F.lit(None).cast("long").alias("wave"))
        placed = placed.unionByName(inside.select("id", (F.col("wave") + F.col("offset")).alias("wave"))).unionByName(none)
    return placed
