"""Hard negatives from an R-tree that is packed by sorting and tiling.

An anchor's positives are its first rows of the same label by inner product. For each positive, the negatives are the
first rows of other labels whose score lies in a window below the positive's score: not as easy as anything far away,
not above the positive. Higher scores come first, ties by smaller id.

1. Sort-tile-recursive packing over the cluster: rows are ranked by the coordinate with the largest variance and cut
   into slabs, ranked within the slabs by the next coordinate and cut again, and ranked by the third and cut into tiles
   of equal size. Ranks come from range sorts with the id as tie-break, so equal vectors, even a third of all rows,
   spread over tiles. Inside a tile the same packing gives leaves. Every node has its minimum bounding box.
2. An anchor and a box give an interval of inner products, the sum of one interval for each coordinate.
3. Anchors, in the order of the tree, form blocks of bounded size with boxes of their own. A block meets the tiles in
   ranges, in one streaming task for each (block, range), the most promising tile first; a tile whose interval
   lies outside all score windows of a block is not sent.
4. In a tile every anchor and window walk the tree with a best-first queue. Boxes outside the window, or strictly below
   the k-th score so far, are not opened; the k-th scores go on from tile to tile.
5. A range gives at most k rows an anchor and window, and a limited window function over these gives the result.

The search is exact; blocks and ranges bound memory, not the work.

Nulls and ties: rows without label, id or vector, and vectors of another length than the most frequent one, take no
part. Rows that repeat an id are rows of their own (an anchor is never its own positive, a copy of it may be).
Of rows with the same score and id the first in the order of the tree comes first. No anchors, or none with positives
or negatives: no rows. Components are held within +-2**23, so that every sum is exact in a double.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.textops import groups, map_batches
from strataweave.scratch import Scratch
from strataweave.skew import number_rows

TILE, LEAF, FANOUT = 1024, 64, 8
BLOCK = 1024  # anchors that meet a range of tiles in one task
AXES = 3  # coordinates that the tiles are sorted by
LIMIT = 1 << 23
LOW, HIGH = -2, -1  # places of the rows that hold the corners of a tile's box
ROW = "tile long, place int, vec_id long, label long, v array<int>"


def _most_spread(values: np.ndarray, axes: int) -> np.ndarray:
    return np.argsort(-values.var(axis=0), kind="stable")[:axes]


def packed(values: np.ndarray, leaf: int, axes: int = AXES) -> np.ndarray:
    """An order of the rows such that runs of ``leaf`` rows are the leaves of a packed tree."""
    order = np.arange(len(values))
    axis = _most_spread(values, axes)
    slabs = [order]
    for depth, a in enumerate(axis):
        left = len(axis) - depth
        out = []
        for slab in slabs:
            slab = slab[np.argsort(values[slab, a], kind="stable")]
            parts = int(np.ceil((len(slab) / leaf) ** (1 / left))) if left > 1 else 1
            size = max(leaf, leaf * int(np.ceil(len(slab) / leaf / max(parts, 1))))
            out += [slab[i : i + size] for i in range(0, len(slab), size)]
        slabs = out
    return np.concatenate(slabs) if slabs else order


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(tile: int, place: np.ndarray, ids: np.ndarray, label: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    n, dim = values.shape
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(values.ravel(), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, tile)), pa.array(place, pa.int32()), pa.array(ids), pa.array(label), flat],
        ["tile", "place", "vec_id", "label", "v"],
    )


def pack(rows: DataFrame, scratch: Scratch, tile: int = TILE, leaf: int = LEAF, axes: int = AXES) -> DataFrame:
    """(tile, place, vec_id, label, v): ``rows(vec_id, label, v)`` in the order of the tree, and the tiles' boxes.

    Places count the rows of a tile from 0; the two corners of its box are rows at the places LOW and HIGH.
    """
    total = rows.count()
    spread = rows.select(F.posexplode("v")).groupBy("pos").agg(F.var_pop("col").alias("s"))
    axis = [r.pos for r in spread.orderBy(F.desc("s"), "pos").limit(axes).collect()]
    parts = max(1, round((total / tile) ** (1 / max(len(axis), 1))))
    ranked, size, key = rows.withColumn("slab", F.lit(0).cast("long")), max(total, 1), ["vec_id", "label", "v"]
    for depth, a in enumerate(axis):
        last = depth == len(axis) - 1
        size = tile if last else max(tile, -(-size // parts))
        ranked = number_rows(ranked.withColumn("x", F.get("v", F.lit(a))), ["slab", "x", *key])
        ranked = ranked.withColumn("slab", F.floor(F.col("position") / F.lit(size))).drop("x", "position")
    ranked = ranked.withColumnRenamed("slab", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["tile"]):
            values = _matrix(group.column("v"))
            ids, label = group.column("vec_id").to_numpy(), group.column("label").to_numpy()
            first = np.lexsort((label, ids))  # the result must not depend on the order of arrival
            order = first[packed(values[first], leaf, axes)]
            number = group.column("tile")[0].as_py()
            yield _rows(number, np.arange(len(order)), ids[order], label[order], values[order])
            box = np.stack([values.min(axis=0), values.max(axis=0)])
            none = np.zeros(2, np.int64)
            yield _rows(number, np.array([LOW, HIGH]), none, none, box)

    dealt = ranked.select("tile", "vec_id", "label", "v").repartition("tile").sortWithinPartitions("tile", "v")
    return scratch.save(map_batches(dealt, run, ROW))


class Tree:
    """A tile's rows with the boxes of its leaves and of the nodes above them."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, label: np.ndarray, values: np.ndarray, leaf: int):
        order = np.argsort(place, kind="stable")
        self.place, self.ids, self.label = place[order], ids[order], label[order]
        self.values = values[order].astype(np.float64)
        starts = np.arange(0, len(order), leaf)
        self.spans = [(s, min(s + leaf, len(order))) for s in starts.tolist()]
        low = np.minimum.reduceat(self.values, starts, axis=0)
        high = np.maximum.reduceat(self.values, starts, axis=0)
        lows, highs, self.children = [low], [high], [()] * len(starts)
        first = 0
        while len(low) > 1:
            cuts = np.arange(0, len(low), FANOUT)
            self.children += [tuple(range(first + c, first + min(c + FANOUT, len(low)))) for c in cuts.tolist()]
            first += len(low)
            low, high = np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.root = len(self.children) - 1

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that each anchor can have inside each node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Search:
    """The best rows so far of some anchors' windows; ``take`` goes through one more tile."""

    def __init__(self, anchors: pa.Table, same: bool, k: int, leaf: int):
        self.number = anchors.column("anchor").to_numpy()
        self.label = anchors.column("label").to_numpy()
        self.own = list(zip(anchors.column("own_tile").to_pylist(), anchors.column("place").to_pylist()))
        self.values = _matrix(anchors.column("v")).astype(np.float64)
        self.windows = [[(w["low"], w["high"]) for w in ws] for ws in anchors.column("windows").to_pylist()]
        self.heaps = [[[] for _ in ws] for ws in self.windows]  # heaps of (score, -id, -tile, -place)
        self.same, self.k, self.leaf = same, k, leaf
        self.opened = 0

    @property
    def best(self) -> list[list[tuple]]:
        """The best rows so far of every anchor, over all its windows."""
        return [[entry for heap in heaps for entry in heap] for heaps in self.heaps]

    def take(self, number: int, group: pa.Table) -> None:
        tree = Tree(
            group.column("place").to_numpy(), group.column("vec_id").to_numpy(), group.column("label").to_numpy(),
            _matrix(group.column("v")), self.leaf,
        )
        least, most = tree.intervals(self.values)
        for i, windows in enumerate(self.windows):
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for (low, high), best in zip(windows, self.heaps[i]):
                self._walk(tree, number, i, low, high, best, least[i], most[i], known)

    def _walk(self, tree, number, i, low, high, best, least, most, known) -> None:
        queue = [(-min(most[tree.root], high), tree.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if most[node] < low or least[node] > high:
                continue
            if len(best) == self.k and -bound < best[0][0]:
                return
            children = tree.children[node]
            if children:
                for c in children:
                    heapq.heappush(queue, (-min(most[c], high), c))
                continue
            if node not in known:
                self.opened += 1
                a, b = tree.spans[node]
                fits = np.flatnonzero((tree.label[a:b] == self.label[i]) == self.same) + a
                if self.same and self.own[i][0] == number:
                    fits = fits[tree.place[fits] != self.own[i][1]]
                known[node] = fits, tree.values[fits] @ self.values[i]
            fits, scores = known[node]
            floor = max(low, best[0][0]) if len(best) == self.k else low
            for at in np.flatnonzero((scores >= floor) & (scores <= high)).tolist():
                row = int(fits[at])
                entry = (int(scores[at]), -int(tree.ids[row]), -number, -int(tree.place[row]))
                if len(best) < self.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

    def result(self) -> Iterator[pa.RecordBatch]:
        found = [
            (number, w, -entry[1], entry[0], -entry[2], -entry[3])
            for number, heaps in zip(self.number.tolist(), self.heaps)
            for w, best in enumerate(heaps)
            for entry in best
        ]
        if found:
            names = ["anchor", "slot", "vec_id", "score", "tile", "place"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)


def _box(table: DataFrame, key: str) -> DataFrame:
    """(key, low, high): the corners of the box of each group's vectors."""
    cells = table.select(key, F.posexplode("v")).groupBy(key, "pos").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "a", "b")))  # one entry for each coordinate
    return cells.groupBy(key).agg(ordered.alias("c")).select(key, F.col("c.a").alias("low"), F.col("c.b").alias("high"))


def _interval(pick) -> Column:
    """The least or largest inner product of two boxes' points; ``pick`` is F.least or F.greatest."""
    corners = F.arrays_zip("low", "high", "block_low", "block_high")
    ends = F.transform(corners, lambda c: pick(
        c["low"].cast("double") * c["block_low"], c["low"].cast("double") * c["block_high"],
        c["high"].cast("double") * c["block_low"], c["high"].cast("double") * c["block_high"],
    ))
    return F.aggregate(ends, F.lit(0.0), lambda s, x: s + x)


def search(tree: DataFrame, anchors: DataFrame, same: bool, k: int, scratch: Scratch, leaf: int = LEAF) -> DataFrame:
    """(anchor, slot, vec_id, score, rank): the first ``k`` rows for each of an anchor's windows, numbered by slot.

    ``anchors(anchor, block, tile, place, label, v, windows)`` with windows array<struct<low, high>> of whole numbers;
    ``same``: rows of the anchor's label but itself, or rows of other labels.
    """
    corner = tree.select("tile", "place", "v")
    boxes = corner.where(F.col("place") == LOW).select("tile", F.col("v").alias("low")).join(
        corner.where(F.col("place") == HIGH).select("tile", F.col("v").alias("high")), "tile")
    asked = anchors.where(F.size("windows") > 0)
    reach = asked.groupBy("block").agg(
        F.min(F.array_min("windows.low")).alias("from"), F.max(F.array_max("windows.high")).alias("upto"))
    blocks = _box(asked, "block").withColumnsRenamed({"low": "block_low", "high": "block_high"}).join(reach, "block")
    blocks = scratch.save(blocks)
    size = blocks.agg(F.max("block")).first()[0]
    if size is None:
        return anchors.sparkSession.createDataFrame([], "anchor long, slot int, vec_id long, score long, rank int")
    # a task gets about as many tiles as there are tasks for a block
    ranges = F.lit(max(1, round(boxes.count() ** 0.5)))
    pairs = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(size))).alias("block")).join(blocks, "block")
    pairs = scratch.save(
        pairs.select(
            "block", "tile", F.pmod(F.xxhash64("tile"), ranges).cast("int").alias("range"),
            (-_interval(F.greatest)).alias("order"), _interval(F.least).alias("least"), "from", "upto",
        ).where("-order >= from AND least <= upto").select("block", "tile", "range", "order")
    )
    none = F.lit(None)
    rows = tree.where("place >= 0").join(pairs, "tile").select(
        "block", "range", "order", "tile", "place", "vec_id", "label", "v", none.cast("long").alias("own_tile"),
        none.cast("long").alias("anchor"), none.cast("array<struct<low:double,high:double>>").alias("windows"),
    )
    first = asked.join(pairs.select("block", "range").distinct(), "block").select(
        "block", "range", F.lit(float("-inf")).alias("order"), F.lit(-1).cast("long").alias("tile"), "place",
        none.cast("long").alias("vec_id"), "label", "v", F.col("tile").alias("own_tile"), "anchor",
        F.col("windows").cast("array<struct<low:double,high:double>>").alias("windows"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for group in groups(batches, ["block", "range", "tile"]):
            here = (group.column("block")[0].as_py(), group.column("range")[0].as_py())
            tile = group.column("tile")[0].as_py()
            if here != at:
                if found:
                    yield from found.result()
                at, found = here, Search(group, same, k, leaf)
                continue
            found.take(tile, group)
        if found:
            yield from found.result()

    dealt = first.unionByName(rows).repartition("block", "range").sortWithinPartitions("block", "range", "order", "tile")
    hits = map_batches(dealt, run, "anchor long, slot int, vec_id long, score long, tile long, place int")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "tile", "place")
    return scratch.save(
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("anchor", "slot", "vec_id", "score", "rank")
    )


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    tile: int = TILE, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows(vec_id, label, v)``.

    ``v`` is array<int>; ``anchor`` says by vec_id which rows are anchors. A negative's score is between ``low`` and
    ``high`` percent of its positive's.
    """
    scratch = Scratch(rows.sparkSession, "llm-rtree")
    part = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    part = scratch.save(part.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    usual = part.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if usual is None or not usual.n:
        return rows.sparkSession.createDataFrame([], none)
    held = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)))
    tree = pack(part.where(F.size("v") == usual.n).withColumn("v", held), scratch, tile, leaf)
    asked = number_rows(tree.where("place >= 0").where(anchor), ["tile", "place"], "anchor")
    asked = scratch.save(asked.withColumn("block", F.floor(F.col("anchor") / F.lit(block)).cast("int")))
    everything = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    friends = search(tree, asked.withColumn("windows", everything), True, positives, scratch, leaf)
    least = -F.floor(-F.col("score") * low / F.lit(100.0))
    most = F.floor(F.col("score") * high / F.lit(100.0))
    windows = friends.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "rank", least.cast("double").alias("low"), most.cast("double").alias("high")))).alias("w"))  # as many as positives
    windows = windows.select("anchor", F.transform(
        "w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    foes = search(tree, asked.join(windows, "anchor"), False, negatives, scratch, leaf)
    named = friends.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
    return (
        foes.join(named, ["anchor", "slot"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
    )
