"""Fixed points over edges: values travel along edges until no node changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, skew_join

_KEEP = {"min": F.min, "max": F.max}
HOPS = 8  # hops per written table; the first tables hold fewer, for graphs that settle early
# edge tables of so many rows are bucketed, and so many rows make a bucket unless there are fewer buckets than cores
BUCKETED, BUCKET_ROWS = 200_000, 20_000_000


def _with_self(edges: DataFrame, ids: DataFrame, scratch: Scratch, steps: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Edges keyed by source, plus one self row per node that carries its state along.

    Edges are read once: every edge gives its own row and the self rows of both ends. With ``steps`` the rows
    have the edges' column of that name, 0 for self rows.
    """
    def row(a, b, me):
        long = [(F.lit(0).cast("long") if me else F.col("steps").cast("long")).alias("steps")] if steps else []
        return F.struct(F.col(a).alias("id"), F.col(b).alias("dst"), F.lit(me).alias("me"), *long)

    linked = edges.select(
        F.inline(F.array(row("src", "dst", False), row("src", "src", True), row("dst", "dst", True)))
    )
    none = [F.lit(0).cast("long").alias("steps")] if steps else []
    own = ids.select("id", F.col("id").alias("dst"), F.lit(True).alias("me"), *none)
    out = scratch.save(linked.unionByName(own).distinct())
    return out, hot_keys(out, "id")


def spread(
    seeds: DataFrame,
    edges: DataFrame,
    keep: str = "min",
    send: Callable[[Column], Column] = lambda v: v,
    keys: Sequence[str] = (),
    max_rounds: int | None = None,
    hops: int = HOPS,
    admit: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Propagate ``value`` from ``seeds(id, value[, keys])`` along ``edges(src, dst)``.

    A hop sends ``send(value)`` over the out-edges of the nodes that changed in the hop before
    and keeps the smallest (or largest) value per node. Self rows in the edge table carry the
    state through the same join, so a hop is one join and one aggregate with map-side combine;
    inside one job the edge exchange is shared by all ``hops`` and the state is already
    partitioned by id for the next join. The state is written once per ``hops``, which bounds
    lineage. ``keys`` separate independent propagations (e.g. one per start node). ``admit``
    may filter messages ``(keys, dst, value)``. ``max_rounds`` bounds the hops exactly.
    """
    scratch = Scratch(seeds.sparkSession, "spread")
    ident = [*keys, "id"]
    kind = seeds.schema["value"].dataType
    outward, hot_edges = _with_self(edges, seeds, scratch)
    merge = _KEEP[keep]
    state = seeds.select(*ident, "value", F.lit(True).alias("moved"))
    if keys:
        state = scratch.save(state)  # counted for hot ids before it is used
    done, todo = 0, 1
    while max_rounds is None or done < max_rounds:
        todo = min(2 * todo, hops)
        if max_rounds is not None:
            todo = min(todo, max_rounds - done)
        hot_state = hot_keys(state, "id") if keys else None
        step = state
        for _ in range(todo):
            sent = skew_join(step, outward, "id", hot_left=hot_state, hot_right=hot_edges)
            sent = sent.where(F.col("me") | F.col("moved"))
            kept = F.when(F.col("me"), F.col("value"))
            value = kept.otherwise(send(F.col("value")).cast(kind))
            if admit is not None:
                sent = admit(sent.select(*keys, F.col("dst"), "me", value.alias("value")))
                value = F.col("value")
            step = sent.groupBy(*keys, F.col("dst").alias("id")).agg(
                merge(value).alias("value"), F.max(kept).alias("old")
            )
            step = step.select(
                *ident, "value", (~F.col("value").eqNullSafe(F.col("old"))).alias("moved")
            )
        state = scratch.save(step, replaces=state)
        done += todo
        if state.where("moved").isEmpty():
            break
    return state.select(*ident, "value")


def _rows_of(linked: DataFrame, hot: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, int | None]:
    """Rows of :func:`_with_self` that rounds join; of many rows without hot ids a table bucketed by id, and its buckets."""
    rows = linked.count()
    if rows < BUCKETED or hot is not None:
        return linked, None
    buckets = max(linked.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    bucketed = scratch.save_bucketed(linked.repartition(buckets, "id"), "id", buckets)
    scratch.drop(linked)
    return bucketed, buckets


def waves(ids: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, wave): longest path from a node without in-edges; null on or after a cycle.

    A node is settled once all its predecessors are; its wave is the largest of theirs plus the steps of the
    edge, one unless ``edges`` has a column ``steps`` (then no edge may occur twice). A node sends once, in the hop after
    it was settled, and nodes count what they got, so all hops together send every edge once. Large edge tables are
    bucketed and joined without a shuffle. Whenever half of the open nodes are settled, edges that were used leave the table.
    """
    scratch = Scratch(edges.sparkSession, "waves")
    if "steps" not in edges.columns:
        edges = edges.select("src", "dst", F.lit(1).alias("steps"))
    outward, hot = _with_self(edges.select("src", "dst", "steps"), ids, scratch, steps=True)
    needs = outward.groupBy(F.col("dst").alias("id")).agg(F.count_if(~F.col("me")).alias("need"))
    none = F.lit(0).cast("long")
    state = scratch.save(needs.select("id", "need", none.alias("got"), none.alias("after"), (F.col("need") == 0).alias("fresh")))
    settled: list[DataFrame] = []
    carried = open_nodes = state.count()
    outward, buckets = _rows_of(outward, hot, scratch)
    todo = 1
    while True:
        step = state
        todo = min(2 * todo, hops)
        for _ in range(todo):
            front = step if buckets is None else step.hint("shuffle_hash")
            sent = skew_join(front, outward, "id", hot_right=hot).where("me OR fresh").select(
                F.col("dst").alias("id"), "me", F.when(F.col("me"), F.col("need")).alias("need"),
                F.when(F.col("me"), F.col("got")).otherwise(1).alias("got"), (F.col("after") + F.col("steps")).alias("after"),
            )
            if buckets is not None:
                sent = sent.repartition(buckets, "id")
            step = sent.groupBy("id").agg(
                F.max("need").alias("need"), F.sum("got").alias("got"), F.max("after").alias("after"),
                F.max(F.when(F.col("me"), F.col("got"))).alias("before"),
            )
            fresh = (F.col("got") == F.col("need")) & (F.col("before") < F.col("need"))
            step = step.select("id", "need", "got", "after", fresh.alias("fresh"))
        state = scratch.save(step, replaces=state)
        left = state.where("got < need").count()
        if left == 0 or left == open_nodes:
            break
        open_nodes = left
        if left <= carried / 2:
            # settled nodes that have sent are final and need not be carried on
            going = scratch.save(state.where("got < need OR fresh"))
            settled.append(scratch.save(state.where("got = need AND NOT fresh").select("id", "after")))
            kept = outward.where("NOT me").join(going.select("id"), "id", "left_semi")
            links = scratch.save(kept.select(F.col("id").alias("src"), "dst", "steps"))
            scratch.drop(state)
            state, carried = going, left
            outward, hot = _with_self(links, going.select("id"), scratch, steps=True)
            outward, buckets = _rows_of(outward, hot, scratch)
    out = state.select("id", F.when(F.col("got") == F.col("need"), F.col("after")).alias("wave"))
    for more in settled:
        out = out.unionByName(more.select("id", F.col("after").alias("wave")))
    return out
