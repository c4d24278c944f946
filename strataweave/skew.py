"""Joins and windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.scratch import Scratch

HOT_ROWS = 1_000_000  # a key with fewer rows than this never needs splitting
MAX_HOT = 10_000  # at most this many keys can each hold more than 1/MAX_HOT of the rows
SALTS = 64


def hot_keys(table: DataFrame, key: str, floor: int | None = None) -> DataFrame | None:
    """Keys so frequent that one task should not take all their rows, or None.

    A key is hot above ``max(floor, rows / MAX_HOT)`` rows, so the list never exceeds MAX_HOT
    entries however large the table is; that bound makes the collect and later broadcast safe.

    Without ``floor`` only tables that were written by :class:`Scratch` are measured, once per key:
    loops join the same edges again and again, below aggregates that adaptive execution cannot
    split. In a single join it splits hot keys itself, so no job is started to look for them.
    """
    if floor is not None:
        return _measured(table, key, floor)
    if getattr(table, "_scratch_path", None) is None:
        return None
    known = table.__dict__.setdefault("_hot_keys", {})
    if key not in known:
        known[key] = _measured(table, key, HOT_ROWS)
    return known[key]


def _measured(table: DataFrame, key: str, floor: int) -> DataFrame | None:
    rows = table.count()
    if rows <= floor:
        return None
    bound = max(floor, rows // MAX_HOT)
    counts = table.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    found = counts.select(key).collect()
    if not found:
        return None
    return table.sparkSession.createDataFrame(found, table.select(key).schema)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
) -> DataFrame:
    """Equi join on ``key``; rows of hot keys are spread over salts, the other side is repeated.

    ``hot_left``/``hot_right`` come from :func:`hot_keys` on the respective side. Without hot
    keys this is a plain join and the optimizer picks the strategy. ``hot_right`` repeats rows of
    ``left``, which only an inner join bears.
    """
    if hot_right is not None and how != "inner":
        raise ValueError(f"hot_right needs an inner join, not {how}")
    if hot_left is None and hot_right is None:
        return left.join(right, key, how)

    def salted(side, own, other, own_salt, other_salt):
        out = side.withColumn("_h", F.xxhash64(*[F.col(c) for c in side.columns]))
        for name, hot, spread in ((own_salt, own, True), (other_salt, other, False)):
            if hot is None:
                out = out.withColumn(name, F.lit(0))
                continue
            flag = F.broadcast(hot.withColumn("_f", F.lit(True)))
            out = out.join(flag, key, "left")
            if spread:
                salt = F.when(F.col("_f"), F.pmod("_h", F.lit(SALTS)).cast("int")).otherwise(0)
            else:
                every = F.sequence(F.lit(0), F.lit(SALTS - 1))
                salt = F.explode(F.when(F.col("_f"), every).otherwise(F.array(F.lit(0))))
            out = out.withColumn(name, salt).drop("_f")
        return out.drop("_h")

    a = salted(left, hot_left, hot_right, "_sl", "_sr")
    b = salted(right, hot_right, hot_left, "_sr", "_sl")
    return a.join(b, [key, "_sl", "_sr"], how).drop("_sl", "_sr")


def following(
    table: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    steps: int,
    floor: int | None = None,
) -> DataFrame:
    """Add ``next_1 .. next_steps``: ``value`` of the following rows of the same key.

    Keys of ordinary size use one window. Rows of a hot key are range-partitioned by the sort
    order, so the window only sees one slice at a time; the few rows at the end of a slice take
    the first rows of the next slices.
    """
    names = [f"next_{i}" for i in range(1, steps + 1)]

    def lead(df: DataFrame, window) -> DataFrame:
        return df.select("*", *[F.lead(value, i).over(window).alias(n) for i, n in enumerate(names, 1)])

    plain = Window.partitionBy(key).orderBy(*order)
    hot = hot_keys(table, key, floor)
    if hot is None:
        return lead(table, plain)

    flag = F.broadcast(hot)
    cold = lead(table.join(flag, key, "left_anti"), plain)
    scratch = Scratch(table.sparkSession, "following")
    # written down because range bounds are sampled and must not move between two reads
    sliced = scratch.save(
        table.join(flag, key, "left_semi")
        .repartitionByRange(key, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    tail = Window.partitionBy(key, "_slice").orderBy(*[F.desc(c) for c in order])
    ranked = (
        lead(sliced, w)
        .withColumn("_head", F.row_number().over(w))
        .withColumn("_tail", F.row_number().over(tail))
    )
    # at most `steps` rows per (key, slice): a bounded table however large the key is
    heads = ranked.where(F.col("_head") <= steps).groupBy(key, "_slice").agg(
        F.sort_array(F.collect_list(F.struct("_head", F.col(value).alias("v")))).alias("_heads")
    )
    after = Window.partitionBy(key).orderBy("_slice").rowsBetween(1, steps)
    heads = heads.select(
        key, "_slice", F.flatten(F.collect_list("_heads").over(after)).alias("_after")
    )
    filled = ranked.join(F.broadcast(heads), [key, "_slice"], "left")
    repaired: list[Column] = []
    for i, n in enumerate(names, 1):
        # a row that is t-th from the end of its slice lacks its i-th successor when i >= t
        borrowed = F.get(F.col("_after"), (F.lit(i) - F.col("_tail")).cast("int"))["v"]
        repaired.append(F.when(F.col("_tail") <= i, borrowed).otherwise(F.col(n)).alias(n))
    warm = filled.select(*table.columns, *repaired)
    return cold.unionByName(warm)


def number_rows(table: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the position of every row in ``order``, from 0, without sorting in one task.

    Rows are range-partitioned, numbered inside their slice and shifted by the sizes of the
    slices before it. The slices are written down because sampled range bounds must not move.
    """
    scratch = Scratch(table.sparkSession, "number")
    sliced = scratch.save(
        table.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row per slice
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    at = (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long")
    return sliced.join(F.broadcast(shift), "_slice").select(*table.columns, at.alias(name))
