"""HyperLogLog registers of what every node reaches, hop by hop, without a sketch on any edge.

Registers never meet each other: register j of a node after a hop is the largest register j of its successors and its own.
So the registers are cut into slices, and a slice takes all its hops in one task, which reads every edge. A task holds one byte a
node and register of its slice, and the slices are as wide as their budget allows; edges lie in a local file that
is read in blocks. What leaves a task is what the hop changed in the sums that an estimate is made of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, number_rows, skew_join

SLICE_BYTES = 64 << 20  # registers of all nodes that a task holds at a time; it holds them twice
BLOCK = 1 << 20  # edges that are read at a time
PIECE = 128  # edges of one node that are read together
MAX_TASKS = 64

CHANGES = "at int, hop int, inverse double, hit int"


def numbered_nodes(ids: DataFrame, precision: int, scratch: Scratch) -> DataFrame:
    """(id, at, coupon): nodes by number, with the 32 bits that stand for them in a sketch; 0 for ids it leaves out."""
    sketch = F.hll_sketch_agg("id", F.lit(precision))
    # a sketch of one value is a list with one little-endian integer behind eight bytes
    byte = lambda k: F.hex(F.substring(sketch, k, 1))
    bits = F.conv(F.concat(byte(12), byte(11), byte(10), byte(9)), 16, 10).cast("long")
    coupon = F.when(bits >= 1 << 31, bits - (1 << 32)).otherwise(bits).cast("int")
    return scratch.save(number_rows(ids.groupBy("id").agg(coupon.alias("coupon")), ["id"], "at"))


def _numbered_edges(links: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, d): edges between numbers, those of a source together, and a row (-1 - at, coupon) for every node."""
    at = nodes.select("id", F.col("at").cast("int").alias("at"))
    e = skew_join(links, at.toDF("dst", "d"), "dst", hot_left=hot_keys(links, "dst"))
    e = skew_join(e, at.toDF("src", "s"), "src", hot_left=hot_keys(links, "src"))
    e = e.select("s", "d").repartition("s").sortWithinPartitions("s")
    own = nodes.select((-1 - F.col("at")).cast("int").alias("s"), F.col("coupon").alias("d"))
    return scratch.save(e.unionByName(own))


def _advance(first: int, last: int, n: int, slots: int, width: int, max_hops: int | None) -> Callable[[Iterator], Iterator]:
    """The task of registers ``first`` to ``last``: all numbered edges in, what every hop changes out."""
    block, piece = BLOCK, PIECE

    def run(batches):
        import os
        import tempfile

        import numpy as np
        import pyarrow as pa

        coupons = np.zeros(n, np.int32)
        local = [p for p in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(p)]
        with tempfile.TemporaryFile(dir=local[0] if local else None) as spool:
            blocks, held, rows = [], [], 0

            def keep():
                s, d = (np.concatenate(x) for x in zip(*held))
                run_at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                length = np.diff(np.r_[run_at, len(s)])
                # long runs are cut into pieces, and pieces go by length, so the k-th edges of all that have one lie together
                pieces = -(-length // piece)
                head = np.repeat(np.cumsum(pieces) - pieces, pieces)
                nth = np.arange(len(head)) - head
                start = np.repeat(run_at, pieces) + nth * piece
                size = np.minimum(np.repeat(length, pieces) - nth * piece, piece)
                order = np.argsort(-size, kind="stable")
                start, size, nth = start[order], size[order], nth[order]
                layers = [np.count_nonzero(size > k) for k in range(size[0])]
                for k, many in enumerate(layers):
                    d[start[:many] + k].tofile(spool)
                blocks.append((s[start], layers, None if not nth.any() else nth == 0))
                held.clear()

            for batch in batches:
                s, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                own = s < 0
                if own.any():
                    coupons[-1 - s[own]] = d[own]
                    s, d = s[~own], d[~own]
                if len(s):
                    held.append((s, d))
                    rows += len(s)
                if rows >= block:
                    keep()
                    rows = 0
            if held:
                keep()
            spool.flush()

            slot, rank = coupons & (slots - 1), (coupons.view(np.uint32) >> 26).astype(np.uint8)
            inverse_of = 2.0 ** -np.arange(64)

            def hop_from(now, nxt):
                nxt[:] = now
                spool.seek(0)
                for sources, layers, leads in blocks:
                    best = now[sources]
                    got = np.empty_like(best)
                    to = np.fromfile(spool, np.int32, sum(layers))
                    at = 0
                    for many in layers:
                        np.take(now, to[at : at + many], axis=0, out=got[:many], mode="clip")
                        np.maximum(best[:many], got[:many], out=best[:many])
                        at += many
                    if leads is None:
                        nxt[sources] = np.maximum(nxt[sources], best)
                        continue
                    nxt[sources[leads]] = np.maximum(nxt[sources[leads]], best[leads])
                    for i in np.flatnonzero(~leads):
                        np.maximum(nxt[sources[i]], best[i], out=nxt[sources[i]])

            def changes(hop, now, nxt, sums):
                for a in range(0, n, 1 << 16):
                    part = nxt[a : a + (1 << 16)]
                    moved = np.flatnonzero((part != now[a : a + (1 << 16)]).any(axis=1))
                    if not len(moved):
                        continue
                    at, part = (moved + a).astype(np.int32), part[moved]
                    inverse, hit = inverse_of[part].sum(axis=1), np.count_nonzero(part, axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at), pa.array(np.full(len(at), hop, np.int32)), pa.array(inverse - sums[0][at]), pa.array(hit - sums[1][at])],
                        names=["at", "hop", "inverse", "hit"],
                    )
                    sums[0][at], sums[1][at] = inverse, hit

            for lo in range(first, last, width):
                w = min(width, last - lo)
                now, nxt = np.zeros((n, w), np.uint8), np.zeros((n, w), np.uint8)
                sums = np.full(n, float(w)), np.zeros(n, np.int32)
                mine = np.flatnonzero((slot >= lo) & (slot < lo + w) & (rank > 0))
                nxt[mine, slot[mine] - lo] = rank[mine]
                yield from changes(0, now, nxt, sums)
                hop, moving = 0, True
                while moving and (max_hops is None or hop < max_hops):
                    hop, now, nxt, moving = hop + 1, nxt, now, False
                    hop_from(now, nxt)
                    for batch in changes(hop, now, nxt, sums):
                        moving = True
                        yield batch

    return run


def _images(precision: int) -> Callable[[Iterator], Iterator]:
    """The first 40 bytes of the sketch (8-bit registers, merged) with the sums of each row; an estimate reads no others."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        head = np.frombuffer(bytes([10, 1, 7, precision, 0, 16, 0, 10]), np.uint8)
        for batch in batches:
            many = batch.num_rows
            image = np.zeros((many, 40), np.uint8)
            image[:, :8] = head
            image[:, 16:24] = batch.column("inverse").to_numpy().astype("<f8").reshape(-1, 1).view(np.uint8)
            image[:, 32:36] = batch.column("zeros").to_numpy().astype("<i4").reshape(-1, 1).view(np.uint8)
            ends = pa.py_buffer(np.arange(0, 40 * many + 1, 40, dtype=np.int32))
            images = pa.Array.from_buffers(pa.binary(), many, [None, ends, pa.py_buffer(image)])
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("hop"), images], names=["at", "hop", "image"])

    return run


def distances(ids: DataFrame, edges: DataFrame, precision: int, max_hops: int | None, scratch: Scratch) -> DataFrame:
    """(id, reached, far): how many nodes each reaches, itself included, and the sum of their distances, by estimate."""
    nodes = numbered_nodes(ids, precision, scratch)
    n, slots = nodes.count(), 1 << precision
    table = _numbered_edges(edges, nodes, scratch)
    tasks = min(edges.sparkSession.sparkContext.defaultParallelism, MAX_TASKS, slots)
    width = max(1, SLICE_BYTES // max(n, 1))
    # a union of frames of one partition each would be one partition; no rows of two partitions keep it from that
    found = edges.sparkSession.range(0, 2, 1, 2).where("id < 0").selectExpr(
        "CAST(id AS INT) AS at", "CAST(id AS INT) AS hop", "CAST(id AS DOUBLE) AS inverse", "CAST(id AS INT) AS hit"
    )
    for t in range(tasks):
        first, last = t * slots // tasks, (t + 1) * slots // tasks
        found = found.unionByName(table.coalesce(1).mapInArrow(_advance(first, last, n, slots, width, max_hops), CHANGES))
    changed = found.groupBy("at", "hop").agg(F.sum("inverse").alias("inverse"), F.sum("hit").alias("hit"))
    upto = Window.partitionBy("at").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    sums = changed.select(
        "at", "hop", (F.sum("inverse").over(upto) + slots).alias("inverse"), (slots - F.sum("hit").over(upto)).cast("int").alias("zeros")
    )
    images = sums.mapInArrow(_images(precision), "at int, hop int, image binary")
    estimate = F.hll_sketch_estimate(F.concat("image", F.lit(bytearray(slots))))
    estimates = images.select("at", "hop", estimate.alias("e"))
    before = Window.partitionBy("at").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    known = F.greatest(F.coalesce(F.max("e").over(before), F.lit(1)), F.lit(1))
    grown = estimates.select("at", "hop", F.greatest("e", known).alias("now"), known.alias("known"))
    far = grown.groupBy("at").agg(F.max("now").alias("reached"), F.sum(F.col("hop") * (F.col("now") - F.col("known"))).alias("far"))
    return scratch.save(
        nodes.join(far, "at", "left").select(
            "id", F.coalesce("reached", F.lit(1)).cast("long").alias("reached"), F.coalesce("far", F.lit(0)).cast("long").alias("far")
        )
    )
