"""Component inventory derived from the given tables, in Spark and in SQL.

Parts are components, brands and types give groups, tags and names, the part size gives the
status. Group paths come from customers, documents are built one per order line or part, and
layouts and memberships follow types and brands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.plans.graphs import table
from strataweave.scratch import Scratch

# fixed values: what a part type adds to the component name
TYPE_SUFFIX = {
    "ECONOMY": "-service",
    "STANDARD": "-api",
    "PROMO": "-core",
    "SMALL": "-common",
    "MEDIUM": "-gateway",
    "LARGE": "-domain",
}

COMPONENT_SQL = """
component AS (
  SELECT id, name, brand || ':' || name AS key,
         CASE WHEN size <= 45 THEN type || '.' || brand END AS group_key,
         CASE WHEN size <= 20 THEN 'active' WHEN size <= 32 THEN 'stale' WHEN size <= 40 THEN 'dormant'
              WHEN size <= 45 THEN 'not_analyzed' ELSE 'orphan' END AS status,
         type IN ('economy', 'standard', 'promo', 'small') AS internal,
         CASE WHEN size <= 5 THEN [] ELSE [type, brand, CASE WHEN size <= 15 THEN 'tiny' WHEN size <= 30 THEN 'medium-size' ELSE 'big' END] END AS tags,
         'org.' || type || '.' || word AS group_id, name AS artifact_id, CAST(size AS VARCHAR) || '.0' AS version,
         type, brand, size, price
  FROM (SELECT p_partkey AS id, lower(p_type) AS type, lower(replace(p_brand, '#', '-')) AS brand,
               p_size AS size, p_retailprice AS price, split_part(p_name, ' ', 1) AS word,
               replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) ||
               CASE p_type WHEN 'ECONOMY' THEN '-service' WHEN 'STANDARD' THEN '-api' WHEN 'PROMO' THEN '-core'
                           WHEN 'SMALL' THEN '-common' WHEN 'MEDIUM' THEN '-gateway' WHEN 'LARGE' THEN '-domain' END AS name
        FROM part)),
bridge AS (SELECT id, unnest(tags) AS tag FROM component)"""

COLUMNS = [
    "id", "name", "key", "group_key", "status", "internal", "tags", "group_id",
    "artifact_id", "version", "type", "brand", "size", "price",
]


def components(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    size = F.col("p_size")
    kind, brand = F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "#", "-"))
    suffix = F.element_at(F.create_map(*[F.lit(v) for pair in TYPE_SUFFIX.items() for v in pair]), F.col("p_type"))
    name = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string"), suffix)
    band = F.when(size <= 15, "tiny").when(size <= 30, "medium-size").otherwise("big")
    status = (
        F.when(size <= 20, "active").when(size <= 32, "stale").when(size <= 40, "dormant")
        .when(size <= 45, "not_analyzed").otherwise("orphan")
    )
    return p.select(
        F.col("p_partkey").alias("id"),
        name.alias("name"),
        F.concat(brand, F.lit(":"), name).alias("key"),
        F.when(size <= 45, F.concat(kind, F.lit("."), brand)).alias("group_key"),
        status.alias("status"),
        kind.isin("economy", "standard", "promo", "small").alias("internal"),
        F.when(size <= 5, F.array().cast("array<string>")).otherwise(F.array(kind, brand, band)).alias("tags"),
        F.concat(F.lit("org."), kind, F.lit("."), F.substring_index("p_name", " ", 1)).alias("group_id"),
        name.alias("artifact_id"),
        F.concat(size.cast("string"), F.lit(".0")).alias("version"),
        kind.alias("type"),
        brand.alias("brand"),
        size.alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def bridge(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode("tags").alias("tag"))


def memberships(nodes: DataFrame) -> DataFrame:
    """(layer, grp, id): layers by type, by brand and by both; only components with a group take part."""
    placed = nodes.where("group_key IS NOT NULL")
    layers = F.array(
        F.struct(F.lit("by-type").alias("layer"), F.col("type").alias("grp")),
        F.struct(F.lit("by-brand").alias("layer"), F.col("brand").alias("grp")),
        F.struct(F.lit("by-both").alias("layer"), F.col("group_key").alias("grp")),
    )
    return placed.select("id", F.inline(layers))


MEMBERSHIP_SQL = """
membership AS (
  SELECT 'by-type' AS layer, type AS grp, id FROM component WHERE group_key IS NOT NULL
  UNION ALL SELECT 'by-brand', brand, id FROM component WHERE group_key IS NOT NULL
  UNION ALL SELECT 'by-both', group_key, id FROM component WHERE group_key IS NOT NULL)"""


def layout(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(layers, groups, memberships, positions) of three visions, one per grouping."""
    member = memberships(nodes)
    order = F.when(F.col("layer") == "by-type", 2).when(F.col("layer") == "by-brand", 1).otherwise(0)
    groups = member.select(
        F.col("layer").alias("layer_id"), F.concat_ws("/", "layer", "grp").alias("group_id"),
        F.col("grp").alias("key"), F.upper("grp").alias("name"),
    ).distinct()
    layers = member.select("layer").distinct().select(
        F.concat(F.lit("v-"), "layer").alias("vision_id"), F.col("layer").alias("layer_id"),
        F.col("layer").alias("key"), F.upper("layer").alias("name"), order.alias("ord"),
    )
    rows = member.select(F.concat_ws("/", "layer", "grp").alias("group_id"), "id")
    positions = member.where("layer = 'by-type'").select(
        F.col("layer").alias("layer_id"), "id", "id"
    ).toDF("layer_id", "id", "_i").join(nodes.select("id", "size", "price"), "id").select(
        "layer_id", "id", F.col("size").cast("double").alias("x"), F.col("price").alias("y")
    )
    return layers, groups, rows, positions


def project_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path): customers as projects below region, nation and segment; HOUSEHOLD ones have no group."""
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, folder, "region").select("r_regionkey", "r_name")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    full = F.lower(F.concat_ws("/", F.regexp_replace("r_name", " ", "-"), "n_name", "c_mktsegment", "c_name"))
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lower("c_name")).otherwise(full).alias("path"),
    )


PATH_SQL = """
project AS (
  SELECT c_custkey AS id,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN lower(c_name)
              ELSE lower(replace(r_name, ' ', '-') || '/' || n_name || '/' || c_mktsegment || '/' || c_name) END AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def saved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A derived input written once, when an iterative job reads it several times."""
    return Scratch(spark, "input").save(df)
