"""Component graphs derived from the order lines, in Spark and in SQL.

A part plays the component. Wherever a part is listed in an order it depends on the next two parts listed
there: the first at compile time, the second at run time. The peak graph has every such pair of every
order; it is mostly one large cycle. The modular graph has the same pairs, but a pair of different brands points from
the smaller brand to the larger one, so brands are modules with cycles inside and an order between them. The directed
graph has the same pairs, each pointing to the larger part: acyclic. The latest graph keeps, per part, the pairs of its
latest order only (its current release): it is for operators whose result is sources x reach (all-pairs distances,
betweenness, redundant edges), and for condensation, layers and the backlog, whose components take many rounds on the
modular graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import following


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")
    )


def _listed(lines: DataFrame) -> DataFrame:
    # written first, so that orders with very many lines are measured and cut into slices
    return following(Scratch(lines.sparkSession, "lines").save(lines.distinct()), "o", ["n", "p"], "p", 2)


def _release(listed: DataFrame, rank) -> DataFrame:
    release = listed.groupBy(F.col("p").alias("src")).agg(
        F.max_by(F.struct("next_1", "next_2"), rank).alias("deps")
    )
    targets = F.array(
        F.struct(F.col("deps.next_1").alias("dst"), F.lit("compile").alias("scope")),
        F.struct(F.col("deps.next_2").alias("dst"), F.lit("runtime").alias("scope")),
    )
    return (
        release.select("src", F.inline(targets))
        .where("dst IS NOT NULL AND src <> dst")
        .select("src", "dst", "scope", F.lit(1).alias("weight"))
    )


def peak_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, scope, weight): every distinct pair of the listing. Mostly one large cycle."""
    return _pairs(spark, folder).distinct().withColumn("weight", F.lit(1))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, scope): the pairs of the listing, as often as they occur."""
    targets = F.array(
        F.struct(F.col("next_1").alias("dst"), F.lit("compile").alias("scope")),
        F.struct(F.col("next_2").alias("dst"), F.lit("runtime").alias("scope")),
    )
    pairs = _listed(_lines(spark, folder)).select(F.col("p").alias("src"), F.inline(targets))
    return pairs.where("dst IS NOT NULL AND src <> dst")


def latest_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, scope, weight): release = the part's latest order. Few or no cycles.

    The latest order of every part is found first, and only orders that are the latest of some part are listed, whole.
    """
    lines = _lines(spark, folder)
    latest = lines.groupBy("p").agg(F.max("o").alias("last")).select("last").distinct()
    # the order without a key is the latest one of parts that are in no other
    lines = lines.join(latest, F.col("o").eqNullSafe(F.col("last")), "left_semi")
    return _release(_listed(lines), F.struct("o", -F.col("n")))


def ordered_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The latest graph with every edge pointing to the larger id: acyclic."""
    e = latest_edges(spark, folder)
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def modular_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, scope, weight): every distinct pair; pairs of different brands point to the larger brand."""
    brand = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    # few pairs occur twice, and turned ones have to be made distinct anyway
    e = _pairs(spark, folder)
    e = e.join(brand.toDF("src", "a"), "src").join(brand.toDF("dst", "b"), "dst")
    kept, turned = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("src", "dst"), ("dst", "src")))
    e = e.select(F.when(F.col("a") <= F.col("b"), kept).otherwise(turned).alias("e"), "scope")
    return e.select("e.src", "e.dst", "scope").distinct().withColumn("weight", F.lit(1))


def directed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The peak graph with every edge pointing to the larger id: acyclic."""
    e = peak_edges(spark, folder)
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def part_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"))


_LISTED = """
listed AS (
  SELECT o, n, p, x, lead(p, 1) OVER w AS d1, lead(p, 2) OVER w AS d2
  FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, max(l_extendedprice) AS x
        FROM lineitem GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY o ORDER BY n, p))"""


def _release_sql(name: str, order: str) -> str:
    return f"""
{name}_release AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {order}) AS r FROM listed) WHERE r = 1),
{name}_scoped AS (
  SELECT p AS src, d1 AS dst, 'compile' AS scope FROM {name}_release WHERE d1 IS NOT NULL AND d1 <> p
  UNION ALL
  SELECT p, d2, 'runtime' FROM {name}_release WHERE d2 IS NOT NULL AND d2 <> p),
{name} AS (SELECT DISTINCT src, dst FROM {name}_scoped)"""


_PEAK = """
peak_scoped AS (
  SELECT p AS src, d1 AS dst, 'compile' AS scope FROM listed WHERE d1 IS NOT NULL AND d1 <> p
  UNION SELECT p, d2, 'runtime' FROM listed WHERE d2 IS NOT NULL AND d2 <> p),
peak AS (SELECT DISTINCT src, dst FROM peak_scoped)"""
_LATEST = _release_sql("latest", "o DESC, n")
_MODULAR = """
modular_scoped AS (
  SELECT DISTINCT CASE WHEN a.p_brand <= b.p_brand THEN src ELSE dst END AS src,
         CASE WHEN a.p_brand <= b.p_brand THEN dst ELSE src END AS dst, scope
  FROM peak_scoped JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
modular AS MATERIALIZED (SELECT DISTINCT src, dst FROM modular_scoped)"""
PEAK_SQL = f"{_LISTED},{_PEAK}"
MODULAR_SQL = f"{PEAK_SQL},{_MODULAR}"
DIRECTED_SQL = PEAK_SQL + ",\ndirected AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM peak)"
LATEST_SQL = f"{_LISTED},{_LATEST}"
BOTH_SQL = f"{_LISTED},{_PEAK},{_LATEST}"
ORDERED_SQL = LATEST_SQL + ",\nordered AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM latest)"
