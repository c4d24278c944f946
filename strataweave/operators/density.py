"""Density clustering of points in the plane, and the grid layout of its clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.clusters import connected_components
from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, number_rows, skew_join

# fixed values: layout steps in pixels
START, STEP_X, STEP_Y, INNER_X, INNER_Y = 200, 400, 300, 80, 60
SPLIT = 8  # a box that is neither surely near nor surely far is cut into SPLIT x SPLIT boxes


def _squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def _distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(_squared(x1, y1, x2, y2))


def _around(reach: int = 2) -> Column:
    """The cells that can hold a point within eps, the cell itself left out."""
    steps = [
        (dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)
        if (dx, dy) != (0, 0)
    ]
    return F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in steps])


def _neighbour_cells(cells: DataFrame, extra: list[str]) -> DataFrame:
    return cells.select(*extra, "cx", "cy", F.explode(_around()).alias("d")).select(
        *extra, "cx", "cy", F.struct((F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).alias("cell")
    )


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): cluster of every point of ``(id, x, y)``, null for noise.

    A point is core when ``min_samples`` others lie within ``eps``; clusters are numbered by
    their smallest core id, a border point joins the lowest cluster near it.

    Points fall into cells whose diagonal is ``eps``, so points of one cell are neighbours
    without being compared. A cell with more than ``min_samples`` points is all core; only
    points of the other cells are compared, with the cells around them. Each such cell holds at
    most ``min_samples`` points, so comparisons grow linearly with the points, however dense one
    place is. Whether two core cells touch is decided on shrinking bounding boxes.
    """
    scratch = Scratch(points.sparkSession, "dbscan")
    side = eps / math.sqrt(2.0) * (1.0 - 1e-9)
    placed = scratch.save(
        points.select(
            "id",
            F.col("x").cast("double").alias("x"),
            F.col("y").cast("double").alias("y"),
        ).withColumn("cell", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    )
    hot = hot_keys(placed, "cell")
    filled = scratch.save(placed.groupBy("cell").agg(F.count("*").alias("n")))
    dense = filled.where(F.col("n") > min_samples)
    thin = filled.where(F.col("n") <= min_samples)
    lone = scratch.save(
        skew_join(placed, thin.select("cell", "n"), "cell", hot_left=hot).select("id", "x", "y", "cell", "n")
    )
    around = _neighbour_cells(
        lone.select("id", F.col("x").alias("px"), F.col("y").alias("py"), "n", "cell.cx", "cell.cy"), ["id", "px", "py", "n"]
    ).select("id", "px", "py", "n", "cell")
    other = placed.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cell")
    near = skew_join(other, around, "cell", hot_left=hot)
    near = near.where(_distance(F.col("px"), F.col("py"), F.col("ox"), F.col("oy")) <= eps)
    met = near.groupBy("id").agg(F.count("*").alias("met"))
    thin_core = scratch.save(
        lone.join(met, "id", "left")
        .withColumn("core", F.col("n") - 1 + F.coalesce("met", F.lit(0)) >= min_samples)
        .select("id", "x", "y", "cell", "core")
    )
    dense_core = skew_join(placed, dense.select("cell"), "cell", "left_semi", hot_left=hot)
    core = scratch.save(
        dense_core.select("id", "x", "y", "cell").unionByName(thin_core.where("core").select("id", "x", "y", "cell"))
    )

    labels = _core_cell_labels(core, eps, scratch)  # (cell, label)
    core_hot = hot_keys(core, "cell")
    cored = skew_join(core.select("id", "x", "y", "cell"), labels, "cell", hot_left=core_hot)
    first = cored.groupBy("label").agg(F.min("id").alias("first"))
    number = _numbered(first)  # (label, cluster)
    numbered = scratch.save(labels.join(number, "label").select("cell", "cluster"))

    border = thin_core.where("NOT core")
    own = border.select("id", F.col("x").alias("px"), F.col("y").alias("py"), "cell")
    beside = _neighbour_cells(
        own.select("id", "px", "py", "cell.cx", "cell.cy"), ["id", "px", "py"]
    ).select("id", "px", "py", "cell")
    where_core = skew_join(
        core.select("cell", F.col("x").alias("ox"), F.col("y").alias("oy")), numbered, "cell", hot_left=core_hot
    )
    touching = skew_join(where_core, beside.unionByName(own.select("id", "px", "py", "cell")), "cell", hot_left=core_hot)
    touching = touching.where(_distance(F.col("px"), F.col("py"), F.col("ox"), F.col("oy")) <= eps)
    joined = touching.groupBy("id").agg(F.min("cluster").alias("cluster"))
    inside = skew_join(core.select("id", "cell"), numbered, "cell", hot_left=core_hot).select("id", "cluster")
    return placed.select("id").join(inside.unionByName(joined), "id", "left").select("id", "cluster")


def _numbered(first: DataFrame) -> DataFrame:
    """(label, cluster): clusters numbered from 0 by their first core id."""
    return number_rows(first, ["first"], "cluster").select("label", "cluster")


def _boxes(core: DataFrame, level: int) -> DataFrame:
    """Bounding boxes of the core points per cell, cut ``level`` times into SPLIT x SPLIT."""
    edges = core.groupBy("cell").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    if level == 0:
        return edges.withColumn("sub", F.struct(F.lit(0).cast("long").alias("sx"), F.lit(0).cast("long").alias("sy")))
    cuts = float(SPLIT**level)
    at = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * cuts), F.lit(int(cuts) - 1))).otherwise(0).cast("long")
    within = skew_join(core, edges, "cell", hot_left=hot_keys(core, "cell"))
    return within.select(
        "cell", "x", "y", F.struct(at("x", "x0", "x1").alias("sx"), at("y", "y0", "y1").alias("sy")).alias("sub")
    ).groupBy("cell", "sub").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def _span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.abs(b1 - a0), F.abs(a1 - b0))


def _ranged(pairs: DataFrame) -> DataFrame:
    """Smallest and largest possible distance between the points of two boxes."""
    c = F.col
    gx, gy = _gap(c("ax0"), c("ax1"), c("bx0"), c("bx1")), _gap(c("ay0"), c("ay1"), c("by0"), c("by1"))
    sx, sy = _span(c("ax0"), c("ax1"), c("bx0"), c("bx1")), _span(c("ay0"), c("ay1"), c("by0"), c("by1"))
    return pairs.withColumn("lo", F.sqrt(gx * gx + gy * gy)).withColumn("hi", F.sqrt(sx * sx + sy * sy))


def _side(boxes: DataFrame, s: str) -> DataFrame:
    return boxes.select(
        F.col("cell").alias(f"{s}cell"), F.col("sub").alias(f"{s}sub"),
        *[F.col(k).alias(f"{s}{k}") for k in ("x0", "x1", "y0", "y1")],
    )


def _core_cell_labels(core: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(cell, label): core cells joined wherever two of their points lie within eps.

    Two boxes are surely linked when even their farthest corners are within eps and surely not
    when their nearest edges are farther; undecided pairs are cut finer until none is left.
    Boxes shrink to single points, so the answer is exact.
    """
    boxes = scratch.save(_boxes(core, 0))
    cells = boxes.select("cell.cx", "cell.cy").withColumn("own", F.struct("cx", "cy"))
    beside = _neighbour_cells(cells, ["own"]).select(F.col("own").alias("acell"), F.col("cell").alias("bcell"))
    beside = beside.where("acell < bcell")
    pairs = beside.join(_side(boxes, "a"), "acell").join(_side(boxes, "b"), "bcell")
    linked = None
    level = 0
    while True:
        judged = scratch.save(_ranged(pairs).where(F.col("lo") <= eps))
        yes = judged.where(F.col("hi") <= eps).select("acell", "bcell").distinct()
        linked = yes if linked is None else linked.unionByName(yes)
        open_pairs = judged.where(F.col("hi") > eps).join(yes, ["acell", "bcell"], "left_anti")
        open_pairs = scratch.save(open_pairs.select("acell", "asub", "bcell", "bsub"))
        if open_pairs.isEmpty():
            break
        level += 1
        finer = scratch.save(_boxes(core, level))
        up = lambda s: F.struct(
            F.floor(F.col(f"{s}sub.sx") / SPLIT).alias("sx"), F.floor(F.col(f"{s}sub.sy") / SPLIT).alias("sy")
        )
        a = _side(finer, "a").withColumn("pa", up("a"))
        b = _side(finer, "b").withColumn("pb", up("b"))
        parents = open_pairs.withColumnRenamed("asub", "pa").withColumnRenamed("bsub", "pb")
        pairs = parents.join(a, ["acell", "pa"]).join(b, ["bcell", "pb"]).drop("pa", "pb")
    name = lambda c: F.concat_ws("_", F.col(f"{c}.cx"), F.col(f"{c}.cy"))
    links = linked.select(name("acell").alias("src"), name("bcell").alias("dst"))
    ids = boxes.select(name("cell").alias("id"), "cell")
    labels = connected_components(ids.select("id"), links)
    return ids.join(labels, "id").select("cell", F.col("component").alias("label"))


def distance_bounds(points: DataFrame) -> tuple[float, float]:
    """Smallest and largest distance between two points of ``(id, x, y)``.

    Both are found on boxes over a grid that is cut finer where a pair of boxes could still
    hold a better pair of points; the number of boxes kept is bounded by the cuts, not the rows.
    """
    scratch = Scratch(points.sparkSession, "bounds")
    spots = scratch.save(
        points.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("w"))
    )
    core = scratch.save(spots.select("x", "y", F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")).alias("cell")))
    far = _extreme(core, scratch)
    if not spots.where("w > 1").isEmpty():
        return 0.0, far
    return _nearest(spots, far, scratch), far


def _extreme(core: DataFrame, scratch: Scratch) -> float:
    """Largest distance: keep the box pairs whose farthest corners beat the best sure distance."""
    whole = _boxes(core, 0)
    pairs = _side(whole, "a").join(_side(whole, "b"), F.col("acell") == F.col("bcell"))
    best, level = 0.0, 0
    while True:
        judged = scratch.save(_ranged(pairs))
        best = max(best, judged.agg(F.max("lo")).first()[0] or 0.0)
        open_pairs = judged.where((F.col("hi") > best) & (F.col("hi") > F.col("lo")))
        open_pairs = scratch.save(open_pairs.select("acell", "asub", "bcell", "bsub"))
        if open_pairs.isEmpty():
            return best
        level += 1
        finer = scratch.save(_boxes(core, level))
        up = lambda s: F.struct(F.floor(F.col(f"{s}sub.sx") / SPLIT).alias("sx"), F.floor(F.col(f"{s}sub.sy") / SPLIT).alias("sy"))
        a, b = _side(finer, "a").withColumn("pa", up("a")), _side(finer, "b").withColumn("pb", up("b"))
        parents = open_pairs.withColumnRenamed("asub", "pa").withColumnRenamed("bsub", "pb")
        pairs = parents.join(a, ["acell", "pa"]).join(b, ["bcell", "pb"]).drop("pa", "pb")
        pairs = pairs.where("asub <= bsub")


def _nearest(spots: DataFrame, far: float, scratch: Scratch) -> float:
    """Smallest distance between distinct places: shrink the cell until few share one.

    With cells of side ``s``, a pair nearer than ``s`` lies in the same or adjacent cells. The
    side halves while some cell holds more than a handful of places, since the closest pair is
    then nearer than the side.
    """
    side = max(far, 1e-300)
    while True:
        cell = F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
        crowd = spots.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if crowd <= 8:
            break
        side /= 2.0
    placed = scratch.save(spots.select("x", "y", cell.alias("cell")))
    while True:
        here = placed.select("x", "y", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).alias("cell"))
        moves = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        asked = here.select(F.col("x").alias("px"), F.col("y").alias("py"), "cell.cx", "cell.cy", F.explode(moves).alias("d")).select(
            "px", "py", F.struct((F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).alias("cell")
        )
        apart = asked.join(here, "cell").where("px < x OR (px = x AND py < y)")
        found = apart.agg(F.min(_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")))).first()[0]
        if found is not None and found <= side:
            return found
        side = found if found is not None else side * 2.0


def optimal_eps(points: DataFrame, target: int | None = None, min_samples: int = 2, steps: int = 20) -> float:
    """The eps whose cluster count comes nearest to ``target`` (default: a tenth of the points).

    Binary search between the smallest and the largest distance, at most ``steps`` clusterings;
    the first eps with the smallest difference is kept, an exact hit ends the search.
    """
    n = points.count()
    if n < 2:
        return 150.0  # fixed value: eps when there is nothing to measure
    target = max(2, n // 10) if target is None else target
    low, high = distance_bounds(points)
    best, best_diff = (low + high) / 2, None
    for _ in range(steps):
        mid = (low + high) / 2
        found = dbscan(points, mid, min_samples).agg(F.countDistinct("cluster")).first()[0] if mid > 0 else 0
        diff = abs(found - target)
        if best_diff is None or diff < best_diff:
            best, best_diff = mid, diff
        if found == target:
            return mid
        if found > target:
            low = mid
        else:
            high = mid
    return best


def ungrouped_points(nodes: DataFrame, min_samples: int = 2) -> DataFrame:
    """(id, x, y) of the nodes without a group; nothing when fewer than ``min_samples``."""
    free = nodes.where("group_key IS NULL").select("id", "x", "y")
    return free.where(free.agg(F.count("*") >= min_samples).scalar())


def grid_layout(clusters: DataFrame, min_samples: int = 2) -> DataFrame:
    """(id, cluster, x, y): clusters on an outer grid, members on an inner grid around the centre.

    ``clusters(id, cluster)`` numbered from 0. Members are numbered in range slices, so a
    cluster that holds most points is not one window.
    """
    scratch = Scratch(clusters.sparkSession, "layout")
    rows = clusters.where("cluster IS NOT NULL").select("id", "cluster")
    sizes = scratch.save(rows.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples))
    sliced = scratch.save(
        rows.join(sizes.select("cluster"), "cluster", "left_semi")
        .repartitionByRange("cluster", "id")
        .withColumn("_s", F.spark_partition_id())
    )
    before = Window.partitionBy("cluster").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.groupBy("cluster", "_s").agg(F.count("*").alias("c")).select(
        "cluster", "_s", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift")
    )
    inside = Window.partitionBy("cluster", "_s").orderBy("id")
    members = sliced.join(shift, ["cluster", "_s"]).select(
        "cluster", "id", (F.row_number().over(inside) - 1 + F.col("shift")).alias("j")
    )
    order = _numbered(sizes.select(F.col("cluster").alias("label"), F.col("cluster").alias("first")))
    slots = order.select(F.col("label").alias("cluster"), F.col("cluster").alias("i")).join(sizes, "cluster")
    columns = sizes.agg(F.ceil(F.sqrt(F.count("*")))).scalar()
    slots = slots.withColumn("cols", columns).select(
        "cluster",
        "n",
        F.ceil(F.sqrt("n")).alias("inner"),
        (START + (F.col("i") % F.col("cols")) * STEP_X).alias("gx"),
        (START + F.floor(F.col("i") / F.col("cols")) * STEP_Y).alias("gy"),
    )
    return skew_join(members, slots, "cluster", hot_left=hot_keys(members, "cluster")).select(
        "id",
        "cluster",
        (F.col("gx") + (F.col("j") % F.col("inner") - F.col("inner") / 2) * INNER_X).alias("x"),
        (F.col("gy") + (F.floor(F.col("j") / F.col("inner")) - F.col("n") / F.col("inner") / 2) * INNER_Y).alias("y"),
    )
