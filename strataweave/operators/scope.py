"""Scoping: facet filters, neighbourhoods, induced subgraphs and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.tags import has_any
from strataweave.functions.text import basename, matches, matches_any
from strataweave.operators.adjacency import simple_edges
from strataweave.operators.clusters import main_cluster
from strataweave.operators.ordering import expand
from strataweave.skew import hot_keys, number_rows, skew_join

# fixed values: the status names a component can have
STATUSES = ["active", "stale", "dormant", "not_analyzed", "orphan"]

# fixed values: a filter with nothing chosen
DEFAULTS = {
    "include_external": False,
    "statuses": STATUSES,
    "groups": [],
    "include_ungrouped": True,
    "tags": [],
    "include_untagged": True,
    "name_pattern": "",
    "include_main_cluster": True,
    "include_disconnected": False,
    "include_unused": True,
}


def status_is(statuses: list[str]) -> Column:
    return F.col("status").isin(statuses) if statuses else F.lit(False)


def group_facet(groups: list[str], include_ungrouped: bool) -> Column:
    chosen = F.col("group_key").isin(groups) if groups else F.lit(False)
    return chosen | F.col("group_key").isNull() if include_ungrouped else chosen


def tag_facet(tags: list[str], include_untagged: bool) -> Column:
    chosen = has_any(tags)
    untagged = F.size("tags") == 0
    return chosen | untagged if include_untagged else chosen


def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    used = edges.select(F.col("dst").alias("id")).distinct()
    return nodes.join(used, "id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_anti")


def apply_filter(
    nodes: DataFrame, edges: DataFrame, components: DataFrame | None, config: dict
) -> DataFrame:
    """Nodes selected by a facet configuration (see DEFAULTS), all columns kept.

    Row predicates come first so they reach the scan; the connectivity facets are semi/anti
    joins against labels that the caller computes once.
    """
    c = {**DEFAULTS, **config}
    out = nodes
    if not c["include_external"]:
        out = out.where("internal")
    out = out.where(status_is(c["statuses"]))
    out = out.where(group_facet(c["groups"], c["include_ungrouped"]))
    out = out.where(tag_facet(c["tags"], c["include_untagged"]))
    pattern = c["name_pattern"].strip()
    if pattern:
        out = out.where(matches(F.col("name"), pattern))
    if components is not None and c["include_main_cluster"] != c["include_disconnected"]:
        how = "left_semi" if c["include_main_cluster"] else "left_anti"
        out = out.join(main_cluster(components), "id", how)
    if not c["include_unused"]:
        used = edges.select(F.col("dst").alias("id")).distinct()
        out = out.join(used, "id", "left_semi")
    return out


def preset(config: dict, as_of: str) -> dict:
    """Facet configuration of a saved preset with activity thresholds.

    The preset names statuses through flags and thresholds in days; :func:`with_activity`
    turns the thresholds into the status column the facets read.
    """
    flags = ["active", "stale", "dormant", "not_analyzed", "orphan"]
    chosen = [s for s in flags if config.get(f"include_{s}", s in ("active", "stale"))]
    return {
        **{k: v for k, v in config.items() if k in DEFAULTS},
        "statuses": chosen,
        "as_of": as_of,
        "active_days": config.get("active_days", 30),
        "stale_days": config.get("stale_days", 90),
    }


def with_activity(nodes: DataFrame, edges: DataFrame, seen: str, config: dict) -> DataFrame:
    """Replace ``status`` by the one the preset's thresholds give on the ``seen`` timestamp."""
    as_of = F.to_timestamp(F.lit(config["as_of"]))
    age = lambda days: F.col(seen) > as_of - F.make_dt_interval(F.lit(days))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    linked = ends.distinct().withColumn("_linked", F.lit(True))
    return nodes.join(linked, "id", "left").withColumn(
        "status",
        F.when(F.col("_linked").isNull(), "orphan")
        .when(F.col(seen).isNull(), "not_analyzed")
        .when(age(config["active_days"]), "active")
        .when(age(config["stale_days"]), "stale")
        .otherwise("dormant"),
    ).drop("_linked")


def neighbourhood(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """(id, matched): nodes matching any term on name or key, and their direct neighbours."""
    hit = nodes.where(matches_any([F.col("name"), F.col("key")], terms)).select("id")
    e = simple_edges(edges)
    ways = e.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(
        e.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    )
    near = skew_join(ways, hit, "id", "left_semi", hot_left=hot_keys(ways, "id"))
    both = hit.withColumn("matched", F.lit(True)).unionByName(
        near.select(F.col("other").alias("id"), F.lit(False).alias("matched"))
    )
    return both.groupBy("id").agg(F.max("matched").alias("matched"))


def induced(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``keys(id)``."""
    out = skew_join(
        edges, keys.select(F.col("id").alias("src")), "src", "left_semi", hot_left=hot_keys(edges, "src")
    )
    return skew_join(
        out, keys.select(F.col("id").alias("dst")), "dst", "left_semi", hot_left=hot_keys(edges, "dst")
    )


def search(nodes: DataFrame, text: str, limit: int = 15) -> DataFrame:
    """Type-ahead over name, key and basename; nothing below two characters."""
    if len(text.strip()) < 2:
        return nodes.limit(0)
    term = text.strip()
    hit = any_column_contains([F.col("name"), F.col("key"), basename(F.col("key"))], term)
    return nodes.where(hit).orderBy("name", "key").limit(limit)


def any_column_contains(columns: list[Column], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(c), F.lit(term.lower()))
    return out


def tag_typeahead(tags: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(tag) names containing the text, alphabetical."""
    return (
        tags.select("tag")
        .where(F.contains(F.lower("tag"), F.lit(text.lower())))
        .distinct()
        .orderBy("tag")
        .limit(limit)
    )


def visible(selected: DataFrame, edges: DataFrame, opened: DataFrame, degree: int) -> DataFrame:
    """(id): filtered nodes together with the expansion of the opened ones."""
    return selected.select("id").unionByName(expand(edges, opened, degree).select("id")).distinct()


def status_counts(nodes: DataFrame) -> DataFrame:
    """(status, components) with a row for every status, also empty ones."""
    every = nodes.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = nodes.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counted, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("components")
    )


def facet_counts(nodes: DataFrame) -> DataFrame:
    """One row: total, ungrouped, untagged, internal, external."""
    return nodes.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("group_key").isNull()).alias("ungrouped"),
        F.count_if(F.size("tags") == 0).alias("untagged"),
        F.count_if("internal").alias("internal"),
        F.count_if(~F.col("internal")).alias("external"),
    )


def tag_usage(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """(tag, components) for every known tag, also unused ones."""
    used = bridge.groupBy("tag").agg(F.count("*").alias("n"))
    return tags.select("tag").distinct().join(used, "tag", "left").select(
        "tag", F.coalesce("n", F.lit(0)).alias("components")
    )


def group_counts(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_key, components) for every group, also empty ones."""
    n = nodes.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("n"))
    return groups.select(F.col("key").alias("group_key")).join(n, "group_key", "left").select(
        "group_key", F.coalesce("n", F.lit(0)).alias("components")
    )


def bulk_tag(bridge: DataFrame, ids: DataFrame, tag: str, add: bool = True) -> DataFrame:
    """The bridge with ``tag`` added to (or removed from) every id."""
    pairs = ids.select("id", F.lit(tag).alias("tag"))
    if add:
        return bridge.select("id", "tag").unionByName(pairs).distinct()
    return bridge.select("id", "tag").join(pairs, ["id", "tag"], "left_anti")


def bulk_status(nodes: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Nodes with the status of every id replaced; unknown statuses are refused."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        nodes.join(mark, "id", "left")
        .withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")))
        .drop("_hit")
    )


def newest(table: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """Latest rows first, key order on equal times."""
    return table.orderBy(F.desc(column), key).limit(limit)


def unique_keys(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Give repeated keys the suffix -2, -3, .. in ``order``.

    A key's place among its equals is its global position minus the first position of its
    base, so a base shared by very many rows is not one window.
    """
    placed = number_rows(rows, [base, order], "_n")
    first = placed.groupBy(base).agg(F.min("_n").alias("_first"))
    placed = skew_join(placed, first, base, hot_left=hot_keys(placed, base))
    n = F.col("_n") - F.col("_first") + 1
    unique = F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string")))
    return placed.withColumn("unique_key", unique).select(*rows.columns, "unique_key")
