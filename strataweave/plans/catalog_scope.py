"""Registered queries on scoping, layers, sets, statements and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataweave.functions import tags as tagexpr
from strataweave.functions import text
from strataweave.operators import adjacency as adj
from strataweave.operators import clusters, cycles, intent, layers, linking, reports, scope, snapshots
from strataweave.plans.catalog_graph import NODE, _big_scc, _deg, _wcc
from strataweave.plans.graphs import LATEST_SQL, PEAK_SQL, latest_edges, part_nodes, peak_edges, table
from strataweave.plans.inputs import (
    COMPONENT_SQL, MEMBERSHIP_SQL, PATH_SQL, bridge, components, layout, memberships, project_paths, saved,
)
from strataweave.plans.registry import query

C = f"WITH {COMPONENT_SQL}"

# ---- filters --------------------------------------------------------------------------------


def rows_query(name: str, condition: str, build) -> None:
    """A filter over the components, as a column and as SQL."""

    @query(name, f"{C} SELECT id, key FROM component WHERE {condition}")
    def _(spark, folder):
        return components(spark, folder).where(build()).select("id", "key")


rows_query("f01_status", "status IN ('active', 'dormant')", lambda: scope.status_is(["active", "dormant"]))
rows_query("f01_no_status", "false", lambda: scope.status_is([]))
rows_query("f02_internal", "internal", lambda: F.col("internal"))
rows_query("f03_groups_or_ungrouped", "group_key IN ('economy.brand-1', 'large.brand-12') OR group_key IS NULL",
           lambda: scope.group_facet(["economy.brand-1", "large.brand-12"], True))
rows_query("f03_groups_only", "group_key IN ('economy.brand-1', 'large.brand-12')",
           lambda: scope.group_facet(["economy.brand-1", "large.brand-12"], False))
rows_query("f04_tags_or_untagged", "list_has_any(tags, ['promo', 'big']) OR len(tags) = 0",
           lambda: scope.tag_facet(["promo", "big"], True))
rows_query("f04_tags_only", "list_has_any(tags, ['promo', 'big'])", lambda: scope.tag_facet(["promo", "big"], False))
rows_query("f05_glob", "regexp_matches(lower(key), '^brand-1.*:.*-gizmo-.*-api$')",
           lambda: text.matches(F.col("key"), "BRAND-1*:*-gizmo-*-api"))
rows_query("f05_glob_class", "regexp_matches(key, '^brand-[13].:.*plate.*$')", lambda: text.matches(F.col("key"), "brand-[13]?:*plate*"))
rows_query("f05_substring", "contains(lower(name), 'hot-rod')", lambda: text.matches(F.col("name"), "Hot-Rod"))
rows_query("f06_any_term", "regexp_matches(name, '^new-.*$') OR regexp_matches(key, '^new-.*$') OR contains(name, '-core') OR contains(key, '-core')",
           lambda: text.matches_any([F.col("name"), F.col("key")], ["new-*", "-core"]))
rows_query("u01_all_tags", "list_contains(tags, 'economy') AND list_contains(tags, 'big')",
           lambda: tagexpr.tag_predicate({"and": ["economy", "big"]}))
rows_query("u02_any_tag", "list_contains(tags, 'economy') OR list_contains(tags, 'tiny')",
           lambda: tagexpr.tag_predicate({"or": ["economy", "tiny"]}))
rows_query("u03_complement", "NOT list_contains(tags, 'promo')", lambda: tagexpr.tag_predicate({"not": "promo"}))
rows_query("u04_match_all", "list_has_all(tags, ['small', 'brand-7'])", lambda: tagexpr.has_all(["small", "brand-7"]))
rows_query("u04_match_any", "list_has_any(tags, ['small', 'brand-7'])", lambda: tagexpr.has_any(["small", "brand-7"]))
rows_query("r01_tag_tree", "(list_contains(tags, 'economy') OR list_contains(tags, 'large')) AND NOT (list_contains(tags, 'tiny') AND list_contains(tags, 'brand-3'))",
           lambda: tagexpr.tag_predicate({"and": [{"or": ["economy", {"tag": "large"}]}, {"not": {"and": ["tiny", "brand-3"]}}]}))
rows_query("r01_empty_tree", "false", lambda: tagexpr.tag_predicate({"and": []}))


@query("f08_j04_without_dependents", f"{C}, {PEAK_SQL} SELECT id, key FROM component WHERE id NOT IN (SELECT dst FROM peak)")
def _(spark, folder):
    return scope.unused(components(spark, folder), peak_edges(spark, folder)).select("id", "key")


@query("f19_with_dependents", f"{C}, {PEAK_SQL} SELECT id, key FROM component WHERE id IN (SELECT dst FROM peak)")
def _(spark, folder):
    used = peak_edges(spark, folder).select(F.col("dst").alias("id")).distinct()
    return components(spark, folder).join(used, "id", "left_semi").select("id", "key")


@query("f20_orphans", f"{C}, {PEAK_SQL} SELECT id, key FROM component WHERE id NOT IN (SELECT src FROM peak UNION SELECT dst FROM peak)")
def _(spark, folder):
    return scope.orphans(components(spark, folder), peak_edges(spark, folder)).select("id", "key")


@query(
    "f07_main_cluster",
    f"WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')} SELECT id FROM wcc WHERE component = (SELECT component FROM main)",
)
def _(spark, folder):
    return clusters.main_cluster(
        clusters.connected_components(saved(spark, part_nodes(spark, folder)), saved(spark, peak_edges(spark, folder)))
    )


_GROUPS = ["economy.brand-1", "economy.brand-2", "promo.brand-2", "small.brand-9"]
_APPLIED = f"""
    chosen AS (SELECT c.id, c.key FROM item c JOIN wcc USING (id) WHERE internal AND status IN ('active', 'stale', 'dormant')
      AND (group_key IN ({", ".join(f"'{g}'" for g in _GROUPS)}) OR group_key IS NULL)
      AND (list_has_any(tags, ['tiny', 'big']) OR len(tags) = 0) AND regexp_matches(lower(name), '^.*-.*$')
      AND wcc.component = (SELECT component FROM main) AND c.id IN (SELECT dst FROM peak))"""
_CONFIG = {
    "statuses": ["active", "stale", "dormant"], "groups": _GROUPS, "tags": ["tiny", "big"], "name_pattern": "*-*",
    "include_main_cluster": True, "include_disconnected": False, "include_unused": False,
}


def _applied(spark, folder):
    n, e = saved(spark, part_nodes(spark, folder)), saved(spark, peak_edges(spark, folder))
    labels = clusters.connected_components(n, e)
    return scope.apply_filter(components(spark, folder), e, labels, _CONFIG), e


# the cluster CTEs name a column like the component table, so that table is called item here
_ITEM_SQL = COMPONENT_SQL.replace("component AS (", "item AS (", 1).replace("FROM component)", "FROM item)")
_FILTERED = f"WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')}, {_ITEM_SQL}, {_APPLIED}"


@query(
    "f09_apply_filter",
    f"{_FILTERED} SELECT id, key FROM chosen",
)
def apply_filter(spark, folder):
    return _applied(spark, folder)[0].select("id", "key")


@query(
    "f10_filtered_count",
    f"{_FILTERED} SELECT count(DISTINCT id) AS components FROM chosen",
)
def _(spark, folder):
    return _applied(spark, folder)[0].agg(F.countDistinct("id").alias("components"))


@query(
    "f11_neighbourhood",
    f"""{C}, {PEAK_SQL},
    hit AS (SELECT id FROM component WHERE regexp_matches(name, '^hot-ring.*$') OR regexp_matches(key, '^hot-ring.*$') OR contains(key, 'brand-17:old')),
    near AS (SELECT dst AS id FROM peak WHERE src IN (SELECT id FROM hit) UNION SELECT src FROM peak WHERE dst IN (SELECT id FROM hit) UNION SELECT id FROM hit)
    SELECT id, id IN (SELECT id FROM hit) AS matched FROM near""",
)
def _(spark, folder):
    return scope.neighbourhood(components(spark, folder), peak_edges(spark, folder), ["hot-ring*", "brand-17:old"])


@query(
    "f12_induced_subgraph",
    f"""{C}, {PEAK_SQL} SELECT src, dst, scope FROM peak_scoped
    WHERE src IN (SELECT id FROM component WHERE internal) AND dst IN (SELECT id FROM component WHERE internal)""",
)
def _(spark, folder):
    return scope.induced(peak_edges(spark, folder), components(spark, folder).where("internal")).select("src", "dst", "scope")


_SEEN = "seen AS (SELECT l_partkey AS id, max(l_shipdate) AS seen FROM lineitem GROUP BY 1)"


def _seen(spark, folder):
    s = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("seen"))
    return components(spark, folder).join(s, "id", "left")


@query(
    "f13_saved_preset",
    f"""{C}, {PEAK_SQL}, {_SEEN},
    st AS (SELECT c.id, c.key, CASE WHEN c.id NOT IN (SELECT src FROM peak UNION SELECT dst FROM peak) THEN 'orphan' WHEN seen IS NULL THEN 'not_analyzed'
             WHEN seen > TIMESTAMP '2001-11-01' - INTERVAL 60 DAY THEN 'active' WHEN seen > TIMESTAMP '2001-11-01' - INTERVAL 120 DAY THEN 'stale' ELSE 'dormant' END AS status
           FROM component c LEFT JOIN seen USING (id) WHERE internal)
    SELECT id, key, status FROM st WHERE status IN ('active', 'stale', 'orphan')""",
)
def _(spark, folder):
    e = peak_edges(spark, folder)
    config = scope.preset(
        {"include_orphan": True, "active_days": 60, "stale_days": 120, "groups": [], "include_ungrouped": True}, "2001-11-01"
    )
    rows = scope.with_activity(_seen(spark, folder).where("internal"), e, "seen", config)
    return rows.where(scope.status_is(config["statuses"])).select("id", "key", "status")


@query(
    "f15_search",
    f"{C} SELECT name, key FROM component WHERE contains(lower(key), 'widget-1') ORDER BY name, key LIMIT 15",
)
def _(spark, folder):
    return scope.search(components(spark, folder), " Widget-1 ").select("name", "key")


@query("f16_tag_typeahead", f"{C} SELECT DISTINCT tag FROM bridge WHERE contains(lower(tag), 'brand-1') ORDER BY tag LIMIT 10")
def _(spark, folder):
    return scope.tag_typeahead(bridge(components(spark, folder)), "BRAND-1")


@query(
    "f21_visible_set",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {COMPONENT_SQL}, way AS (SELECT src AS a, dst AS b FROM peak UNION SELECT dst, src FROM peak),
    near AS (SELECT id, 0 AS d FROM component WHERE status = 'orphan' AND NOT internal UNION SELECT b, d + 1 FROM near JOIN way ON a = near.id WHERE d < 1)
    SELECT id FROM component WHERE type = 'promo' UNION SELECT id FROM near""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    opened = nodes.where("status = 'orphan' AND NOT internal").select("id")
    return scope.visible(nodes.where("type = 'promo'"), saved(spark, peak_edges(spark, folder)), opened, 1)


# ---- counts -----------------------------------------------------------------------------------


@query(
    "a01_status_counts",
    f"""{C}, every AS (SELECT unnest(['active', 'stale', 'dormant', 'not_analyzed', 'orphan']) AS status)
    SELECT every.status, count(id) AS components FROM every LEFT JOIN component ON component.status = every.status GROUP BY 1""",
)
def _(spark, folder):
    return scope.status_counts(components(spark, folder))


@query("a03_tag_usage", f"{C} SELECT tag, count(*) AS components FROM bridge GROUP BY 1 UNION ALL SELECT 'unused', 0")
def _(spark, folder):
    used = bridge(components(spark, folder))
    tags = used.select("tag").distinct().unionByName(spark.createDataFrame([("unused",)], "tag string"))
    return scope.tag_usage(tags, used)


@query(
    "a04_facet_counts",
    f"""{C} SELECT count(*) AS total, count(*) FILTER (group_key IS NULL) AS ungrouped, count(*) FILTER (len(tags) = 0) AS untagged,
    count(*) FILTER (internal) AS internal, count(*) FILTER (NOT internal) AS external FROM component""",
)
def _(spark, folder):
    return scope.facet_counts(components(spark, folder))


@query(
    "a04_group_counts",
    f"""{C}, g AS (SELECT DISTINCT split_part(group_key, '.', 1) AS k FROM component WHERE group_key IS NOT NULL UNION SELECT DISTINCT group_key FROM component WHERE group_key IS NOT NULL)
    SELECT k AS group_key, count(id) AS components FROM g LEFT JOIN component ON group_key = k GROUP BY 1""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    return scope.group_counts(linking.group_hierarchy(nodes), nodes)


@query(
    "a08_summary",
    f"""{C}, {PEAK_SQL}, ends AS (SELECT src AS id FROM peak UNION SELECT dst FROM peak),
    g AS (SELECT DISTINCT split_part(group_key, '.', 1) AS k FROM component WHERE group_key IS NOT NULL UNION SELECT DISTINCT group_key FROM component WHERE group_key IS NOT NULL)
    SELECT (SELECT count(*) FROM component) AS total_components, (SELECT count(*) FROM ends) AS with_dependencies,
           (SELECT count(*) FROM component) - (SELECT count(*) FROM ends) AS orphans, (SELECT count(*) FROM peak_scoped) AS total_dependencies,
           (SELECT count(*) FROM g) AS node_groups""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    return reports.summary(nodes, peak_edges(spark, folder), linking.group_hierarchy(nodes))


@query(
    "a09_path_groups",
    f"WITH {PATH_SQL} SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS group_path, count(*) AS projects FROM project GROUP BY 1",
)
def _(spark, folder):
    return reports.path_groups(project_paths(spark, folder))


@query(
    "a10_path_rollup",
    f"""WITH {PATH_SQL}, parts AS (SELECT id, string_split(path, '/') AS p FROM project WHERE contains(path, '/')),
    pre AS (SELECT array_to_string(p[1:i], '/') AS prefix FROM parts, (SELECT unnest(range(1, 10)) AS i) WHERE i < len(p))
    SELECT prefix, count(*) AS projects FROM pre GROUP BY 1""",
)
def _(spark, folder):
    return reports.path_rollup(project_paths(spark, folder))


@query(
    "a11_domain_report",
    f"""{C}, d AS (SELECT group_id AS domain, count(*) AS components FROM component GROUP BY 1)
    SELECT domain, components, CAST((SELECT sum(components) FROM d) AS BIGINT) AS total, (SELECT count(*) FROM d) AS unique_domains
    FROM d ORDER BY components DESC, domain LIMIT 20""",
)
def _(spark, folder):
    return reports.domain_report(components(spark, folder))


@query(
    "a12_naming_report",
    f"""{C}, n AS (SELECT lower(name) AS name FROM component),
    s AS (SELECT CASE {" ".join(f"WHEN ends_with(name, '{x}') THEN '{x}'" for x in reports.NAME_SUFFIXES)} END AS v FROM n),
    a AS (SELECT 'suffix' AS kind, v AS value, count(*) AS components FROM s WHERE v IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15),
    b AS (SELECT 'prefix' AS kind, split_part(name, '-', 1) AS value, count(*) AS components FROM n
          WHERE contains(name, '-') AND length(split_part(name, '-', 1)) > 2 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def _(spark, folder):
    return reports.naming_report(components(spark, folder))


@query(
    "a13_activity_report",
    f"""{C}, {_SEEN}, x AS (SELECT seen FROM component LEFT JOIN seen USING (id)), t AS (SELECT TIMESTAMP '2001-09-01' AS t)
    SELECT count(*) FILTER (seen > t - INTERVAL 30 DAY) AS active_30d, count(*) FILTER (seen <= t - INTERVAL 30 DAY AND seen > t - INTERVAL 90 DAY) AS stale_30_90d,
           count(*) FILTER (seen <= t - INTERVAL 90 DAY) AS dormant_90d_plus, count(*) FILTER (seen IS NULL) AS never_synced FROM x, t""",
)
def _(spark, folder):
    return reports.activity_report(_seen(spark, folder), "seen", "2001-09-01")


@query("a21_mean_coupling", f"WITH {NODE}, {PEAK_SQL}, {_deg('peak')} SELECT round(avg(coupling_score), 6)::DOUBLE AS mean_coupling FROM metric")
def _(spark, folder):
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder))
    return d.agg(F.round(F.avg("coupling_score"), 6).alias("mean_coupling"))


@query(
    "a22_name_prefixes",
    f"""{C} SELECT type, count(DISTINCT split_part(key, ':', 1)) AS prefixes FROM component GROUP BY 1""",
)
def _(spark, folder):
    return components(spark, folder).groupBy("type").agg(
        F.countDistinct(F.substring_index("key", ":", 1)).alias("prefixes")
    )


@query(
    "o03_group_order",
    f"""{C}, g AS (SELECT DISTINCT split_part(group_key, '.', 1) AS k FROM component WHERE group_key IS NOT NULL UNION SELECT DISTINCT group_key FROM component WHERE group_key IS NOT NULL),
    s AS (SELECT k, array_to_string(list_transform(regexp_extract_all(k, '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 10, '0') || ltrim(p, '0') ELSE p END), '') AS z FROM g)
    SELECT k AS key, row_number() OVER (ORDER BY z) AS position FROM s""",
)
def _(spark, folder):
    """Groups in display order: children after their parent, digits compared as numbers."""
    from strataweave.skew import number_rows

    groups = linking.group_hierarchy(components(spark, folder)).withColumn("_z", text.natural_key(F.col("key")))
    return number_rows(groups, ["_z"], "_p").select("key", (F.col("_p") + 1).alias("position"))


@query(
    "o06_member_samples",
    f"""{C}, r AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name, id) AS r, count(*) OVER (PARTITION BY type) AS size FROM component)
    SELECT type, any_value(size) AS size, string_agg(name, '|' ORDER BY name) FILTER (r <= 5) AS members, any_value(size) - count(*) FILTER (r <= 5) AS more FROM r GROUP BY 1""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    out = reports.label_samples(nodes.select("id", "type"), nodes, "type")
    return out.select("type", "size", F.array_join("members", "|").alias("members"), "more")


@query("w08_newest", "SELECT o_orderkey AS run, o_orderdate AS finished FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def _(spark, folder):
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("finished"))
    return scope.newest(runs, "finished", "run", 10)


@query(
    "w07_unique_keys",
    """WITH b AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '-')) AS base FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM b)
    SELECT id, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS unique_key FROM n""",
)
def _(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.slug(F.col("p_name")).alias("base"))
    return scope.unique_keys(rows, "base", "id").select("id", "unique_key")


# ---- joins ------------------------------------------------------------------------------------


@query("j01_edge_ends", f"{C}, {PEAK_SQL} SELECT a.key AS source, b.key AS target, scope FROM peak_scoped JOIN component a ON a.id = src JOIN component b ON b.id = dst")
def _(spark, folder):
    from strataweave.skew import hot_keys, skew_join

    n, e = components(spark, folder).select("id", "key"), peak_edges(spark, folder)
    out = skew_join(e, n.toDF("src", "source"), "src", hot_left=hot_keys(e, "src"))
    return skew_join(out, n.toDF("dst", "target"), "dst", hot_left=hot_keys(e, "dst")).select("source", "target", "scope")


@query(
    "j02_component_group",
    f"""{C}, g AS (SELECT DISTINCT group_key FROM component WHERE starts_with(group_key, 'economy'))
    SELECT id, g.group_key AS known_group FROM component LEFT JOIN g USING (group_key)""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    known = nodes.where(F.startswith("group_key", F.lit("economy"))).select("group_key").distinct()
    return nodes.join(known.withColumn("known_group", F.col("group_key")), "group_key", "left").select("id", "known_group")


@query("j05_tag_bridge", f"{C} SELECT key, tag FROM component JOIN bridge USING (id) WHERE tag IN ('big', 'promo')")
def _(spark, folder):
    nodes = components(spark, folder)
    wanted = bridge(nodes).where(F.col("tag").isin("big", "promo"))
    return wanted.join(nodes.select("id", "key"), "id").select("key", "tag")


@query("j06_group_members", f"{C}, {MEMBERSHIP_SQL} SELECT layer, grp, key FROM membership JOIN component USING (id)")
def _(spark, folder):
    nodes = components(spark, folder)
    return memberships(nodes).join(nodes.select("id", "key"), "id").select("layer", "grp", "key")


@query(
    "j07_layer_overlap",
    f"""{C}, {MEMBERSHIP_SQL} SELECT a.grp AS brand, b.grp AS kind, count(*) AS common FROM membership a JOIN membership b USING (id)
    WHERE a.layer = 'by-brand' AND b.layer = 'by-type' GROUP BY 1, 2""",
)
def _(spark, folder):
    m = memberships(components(spark, folder))
    a = m.where("layer = 'by-brand'").select("id", F.col("grp").alias("brand"))
    b = m.where("layer = 'by-type'").select("id", F.col("grp").alias("kind"))
    return a.join(b, "id").groupBy("brand", "kind").agg(F.count("*").alias("common"))


# ---- layers -----------------------------------------------------------------------------------

RULES = [
    layers.LayerRule(0, "foundation", r"[^:]+:.*-(core|common)$"),
    layers.LayerRule(1, "domain", r"[^:]+:.*-domain$"),
    layers.LayerRule(2, "service", r"[^:]+:.*-service$"),
    layers.LayerRule(3, "edge", r"[^:]+:.*-gateway$"),
    layers.LayerRule(3, "z-catch", r"brand-1\d:"),
]
_ASSIGN = f"""
    auto AS (SELECT id, CASE {" ".join(f"WHEN regexp_matches(key, '^(?:{r.pattern})') THEN '{r.name}'" for r in RULES)} END AS layer FROM component),
    rule AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {r.level})" for r in RULES)}) AS v(layer, level)),
    manual AS (SELECT id FROM component WHERE size = 50),
    assigned AS (SELECT id, layer, level, true AS auto_assigned FROM auto JOIN rule USING (layer) WHERE id NOT IN (SELECT id FROM manual)
                 UNION ALL SELECT id, 'edge', 3, false FROM manual)"""


def _assigned(nodes):
    manual = nodes.where("size = 50").select("id", F.lit("edge").alias("layer"), F.lit(3).alias("level"))
    return layers.assign_layers(nodes, RULES, manual)


@query("l01_j09_w02_assign_layers", f"{C}, {_ASSIGN} SELECT id, layer, level, auto_assigned FROM assigned")
def assign_layers(spark, folder):
    return _assigned(components(spark, folder))


@query(
    "l01_j09_rules_of_a_table",
    f"""{C}, rule AS (SELECT DISTINCT brand, 'module-' || brand AS layer, CAST(replace(brand, 'brand-', '') AS INT) % 7 AS level FROM component)
    SELECT id, layer, level, true AS auto_assigned FROM component JOIN rule USING (brand)""",
)
def _(spark, folder):
    """A layer for each brand, its rule in a table that is derived from the parts."""
    nodes = components(spark, folder)
    rules = nodes.select("brand").distinct().select(
        (F.replace("brand", F.lit("brand-"), F.lit("")).cast("int") % 7).alias("level"),
        F.concat(F.lit("module-"), "brand").alias("name"), F.concat("brand", F.lit(":")).alias("pattern"),
    )
    return layers.assign_layers(nodes, layers.layer_rules(rules))


@query(
    "l02_manual_layers",
    f"""{C}, {_ASSIGN}, change AS (SELECT id, CASE WHEN type = 'promo' THEN 'service' END AS layer FROM component WHERE size <= 3)
    SELECT id, layer, level, auto_assigned FROM assigned WHERE id NOT IN (SELECT id FROM change)
    UNION ALL SELECT id, layer, 2, false FROM change WHERE layer IS NOT NULL""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    change = nodes.where("size <= 3").select(
        "id", F.when(F.col("type") == "promo", "service").alias("layer"), F.lit(2).alias("level")
    )
    return layers.set_manual(_assigned(nodes), change)


_VIOLATION = """
    violation AS (SELECT src, dst, a.layer AS source_layer, b.layer AS target_layer, CASE WHEN a.level < b.level THEN 'critical' ELSE 'info' END AS severity
                  FROM peak JOIN assigned a ON a.id = src JOIN assigned b ON b.id = dst WHERE a.level <= b.level)"""


@query("l03_j03_layer_violations", f"{C}, {PEAK_SQL}, {_ASSIGN}, {_VIOLATION} SELECT * FROM violation")
def violations(spark, folder):
    return layers.layer_violations(peak_edges(spark, folder), _assigned(components(spark, folder))).drop("reason")


@query(
    "a18_violation_totals",
    f"{C}, {PEAK_SQL}, {_ASSIGN}, {_VIOLATION} SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'info') AS info FROM violation",
)
def _(spark, folder):
    return layers.violation_totals(violations(spark, folder))


@query(
    "l03_cycle_warnings",
    f"""WITH RECURSIVE {NODE}, {COMPONENT_SQL}, {PEAK_SQL}, {_ASSIGN}, {_big_scc('peak')},
    loops AS (SELECT src, dst FROM peak JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc_id = b.scc_id AND (a.scc_size > 1 OR src = dst))
    SELECT src, dst, CASE WHEN a.level < b.level THEN 'critical' WHEN (src, dst) IN (SELECT src, dst FROM loops) THEN 'warning' ELSE 'info' END AS severity
    FROM peak JOIN assigned a ON a.id = src JOIN assigned b ON b.id = dst WHERE a.level <= b.level""",
)
def _(spark, folder):
    n, e = saved(spark, part_nodes(spark, folder)), saved(spark, peak_edges(spark, folder).select("src", "dst").distinct())
    loops = cycles.cycle_edges(e, cycles.scc(n, e))
    out = layers.layer_violations(e, _assigned(components(spark, folder)), loops)
    return out.select("src", "dst", "severity")


@query(
    "a05_layer_counts",
    f"{C}, {_ASSIGN} SELECT rule.layer, rule.level, count(id) AS components FROM rule LEFT JOIN assigned USING (layer) GROUP BY 1, 2",
)
def _(spark, folder):
    return layers.layer_counts(RULES, _assigned(components(spark, folder)))


@query(
    "l04_layer_listing",
    f"{C}, {_ASSIGN} SELECT level, layer, component.name, auto_assigned FROM assigned JOIN component USING (id)",
)
def _(spark, folder):
    nodes = components(spark, folder)
    return _assigned(nodes).join(nodes.select("id", "name"), "id").select("level", "layer", "name", "auto_assigned")


# ---- sets and statements ----------------------------------------------------------------------

_DEFINED = """
    definition AS (
      SELECT 'tag:' || t AS set_id FROM (SELECT DISTINCT type AS t FROM component) UNION ALL SELECT 'mixed' UNION ALL SELECT 'listed'
      UNION ALL SELECT 'on-brand' UNION ALL SELECT 'loose'),
    member AS (
      SELECT 'tag:' || tag AS set_id, id FROM bridge WHERE tag IN (SELECT DISTINCT type FROM component)
      UNION SELECT 'mixed', id FROM component WHERE list_contains(tags, 'big') AND NOT list_contains(tags, 'promo')
      UNION SELECT 'listed', id FROM component WHERE size = 7
      UNION SELECT 'on-brand', id FROM membership WHERE layer = 'by-brand')"""


def _definitions(nodes):
    from pyspark.sql import types as T

    spark = nodes.sparkSession
    kinds = nodes.select("type").distinct().select(
        F.concat(F.lit("tag:"), "type").alias("set_id"), F.lit("tag_expression").alias("kind"),
        F.to_json(F.struct(F.col("type").alias("tag"))).alias("expression"),
    )
    fixed = spark.createDataFrame(
        [
            ("mixed", "tag_expression", '{"and": ["big", {"not": "promo"}]}', None),
            ("on-brand", "layer", None, "by-brand"),
            ("loose", "informal", None, None),
        ],
        "set_id string, kind string, expression string, layer string",
    )
    # an explicit list is as long as the data makes it, so it is one row per member
    listed = nodes.where("size = 7").select(
        F.lit("listed").alias("set_id"), F.lit("explicit_list").alias("kind"), F.array("key").alias("members")
    )
    return kinds.unionByName(fixed, True).unionByName(listed, True).select("set_id", "kind", "expression", "layer", "members")


@query("r02_resolve_sets", f"{C}, {MEMBERSHIP_SQL}, {_DEFINED} SELECT set_id, id FROM member")
def resolve_sets(spark, folder):
    nodes = components(spark, folder)
    return intent.resolve_sets(_definitions(nodes), nodes, memberships(nodes))


@query(
    "r03_sets_by_name",
    f"""{C}, d AS (SELECT 1 AS v, 'big' AS name, 'economy' AS tag UNION ALL SELECT NULL, 'small', 'large' UNION ALL SELECT NULL, 'big', 'promo'),
    n AS (SELECT v.v, t.name FROM (SELECT 1 AS v UNION ALL SELECT 2) v, (SELECT 'big' AS name UNION ALL SELECT 'small' UNION ALL SELECT 'tiny') t),
    p AS (SELECT n.v AS vision_id, n.name, coalesce(a.tag, b.tag, n.name) AS tag FROM n LEFT JOIN d a ON a.v = n.v AND a.name = n.name LEFT JOIN d b ON b.v IS NULL AND b.name = n.name)
    SELECT vision_id, name, id FROM p JOIN bridge USING (tag)""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    tags = bridge(nodes)
    definitions = spark.createDataFrame(
        [(1, "big", "own-big"), (None, "small", "all-small"), (None, "big", "all-big")], "vision_id int, name string, set_id string"
    )
    meaning = spark.createDataFrame([("own-big", "economy"), ("all-small", "large"), ("all-big", "promo")], "set_id string, tag string")
    members = meaning.join(tags, "tag").select("set_id", "id")
    names = spark.createDataFrame([(v, n) for v in (1, 2) for n in ("big", "small", "tiny")], "vision_id int, name string")
    return intent.sets_by_name(names, definitions, members, tags)


@query("r04_tags_of_components", f"{C} SELECT key, array_to_string(list_sort(tags), ',') AS tags FROM component")
def _(spark, folder):
    return components(spark, folder).select("key", F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query(
    "r05_bulk_tag",
    f"{C} SELECT id, tag FROM bridge WHERE NOT (tag = 'big' AND id IN (SELECT id FROM component WHERE type = 'small')) UNION SELECT id, 'reviewed' FROM component WHERE type = 'promo'",
)
def _(spark, folder):
    nodes = components(spark, folder)
    less = scope.bulk_tag(bridge(nodes), nodes.where("type = 'small'"), "big", add=False)
    return scope.bulk_tag(less, nodes.where("type = 'promo'"), "reviewed")


@query("r05_bulk_status", f"{C} SELECT id, CASE WHEN size > 40 THEN 'dormant' ELSE status END AS status FROM component")
def _(spark, folder):
    nodes = components(spark, folder)
    return scope.bulk_status(nodes, nodes.where("size > 40"), "dormant").select("id", "status")


@query("r06_r07_set_as_layer", f"{C} SELECT 'v-new-Payments-all' AS group_id, id FROM component WHERE list_contains(tags, 'promo')")
def _(spark, folder):
    nodes = components(spark, folder).where(tagexpr.tag_predicate("promo"))
    return snapshots.set_as_layer("v-new", "Payments", nodes)[2]


_STATEMENT = """
    pairing AS (SELECT DISTINCT type, brand FROM component),
    statement AS (
      SELECT 'e1-' || set_id AS statement_id, 'existence' AS type, set_id AS first, NULL AS second, NULL AS operator, NULL::BIGINT AS value FROM definition
      UNION ALL SELECT 'e1-none', 'existence', 'missing', NULL, NULL, NULL
      UNION ALL SELECT 'e2-' || type || '-' || brand, 'containment', 'tag:' || type, brand, NULL, NULL FROM pairing
      UNION ALL SELECT 'e2-own-' || type, 'containment', 'tag:' || type, type, NULL, NULL FROM pairing GROUP BY type
      UNION ALL SELECT 'e2-absent', 'containment', 'mixed', 'no-such-group', NULL, NULL UNION ALL SELECT 'e2-empty', 'containment', 'loose', 'promo', NULL, NULL
      UNION ALL SELECT 'e3-' || a.set_id || '-' || b.set_id, 'exclusion', a.set_id, b.set_id, NULL, NULL FROM definition a, definition b
      UNION ALL SELECT 'e4-' || set_id || o, 'cardinality', set_id, NULL, o, 300 FROM definition, (SELECT unnest(['==', '!=', '<=', '>=', '<', '>', '~']) AS o)
      UNION ALL SELECT 'e5-' || set_id || l, 'coverage', set_id, l, NULL, NULL FROM (SELECT set_id FROM definition UNION ALL SELECT '*'), (SELECT unnest(['by-type', 'by-both', 'nowhere']) AS l)
      UNION ALL SELECT 'e6-' || a || b, 'correspondence', a, b, NULL, NULL FROM (SELECT unnest(['by-type', 'by-brand']) AS a), (SELECT unnest(['by-type', 'by-both']) AS b)
      UNION ALL SELECT 'e7-' || a || b, 'refinement', a, b, NULL, NULL FROM (SELECT unnest(['by-type', 'by-both']) AS a), (SELECT unnest(['by-type', 'by-brand', 'by-both']) AS b)
      UNION ALL SELECT 'e6-absent', 'correspondence', 'by-type', 'absent', NULL, NULL UNION ALL SELECT 'e7-absent', 'refinement', 'absent', 'by-type', NULL, NULL
      UNION ALL SELECT 'e8-semi-' || k, k, NULL, NULL, NULL, NULL FROM (SELECT unnest(['existence', 'containment', 'exclusion', 'cardinality', 'coverage', 'correspondence', 'refinement']) AS k)
      UNION ALL SELECT 'e8-part-' || k, k, 'mixed', NULL, NULL, NULL FROM (SELECT unnest(['containment', 'exclusion']) AS k)
      UNION ALL SELECT 'e8-informal', NULL, NULL, NULL, NULL, NULL),
    size AS (SELECT set_id, count(*) AS n FROM member GROUP BY 1),
    verdict AS (
      SELECT statement_id, type, CASE
        WHEN coalesce(first, second, operator, CAST(value AS VARCHAR)) IS NULL THEN NULL
        WHEN type IN ('containment', 'exclusion') AND (first IS NULL OR second IS NULL) THEN false
        WHEN type = 'coverage' AND second NOT IN (SELECT layer FROM membership) THEN NULL
        WHEN type IN ('correspondence', 'refinement') AND (first NOT IN (SELECT layer FROM membership) OR second NOT IN (SELECT layer FROM membership)) THEN NULL
        ELSE CASE type
        WHEN 'existence' THEN coalesce((SELECT n FROM size WHERE set_id = first), 0) > 0
        WHEN 'cardinality' THEN CASE operator WHEN '==' THEN n = value WHEN '!=' THEN n <> value WHEN '<=' THEN n <= value WHEN '>=' THEN n >= value WHEN '<' THEN n < value WHEN '>' THEN n > value ELSE false END
        WHEN 'containment' THEN CASE WHEN n = 0 THEN true WHEN second NOT IN (SELECT grp FROM membership) THEN false
             ELSE NOT EXISTS (SELECT 1 FROM member m WHERE m.set_id = first AND NOT EXISTS (SELECT 1 FROM membership g WHERE g.grp = second AND g.id = m.id)) END
        WHEN 'exclusion' THEN NOT EXISTS (SELECT 1 FROM peak JOIN member a ON a.id = src JOIN member b ON b.id = dst WHERE a.set_id = first AND b.set_id = second)
        WHEN 'coverage' THEN NOT EXISTS (SELECT 1 FROM (SELECT set_id, id FROM member UNION ALL SELECT '*', id FROM component) m WHERE m.set_id = first
             AND NOT EXISTS (SELECT 1 FROM membership g WHERE g.layer = second AND g.id = m.id))
        WHEN 'correspondence' THEN NOT EXISTS (
             (SELECT s FROM sig WHERE layer = first EXCEPT SELECT s FROM sig WHERE layer = second) UNION ALL (SELECT s FROM sig WHERE layer = second EXCEPT SELECT s FROM sig WHERE layer = first))
        WHEN 'refinement' THEN NOT EXISTS (SELECT 1 FROM sig f WHERE f.layer = first AND NOT EXISTS (SELECT 1 FROM sig c WHERE c.layer = second AND list_has_all(c.s, f.s)))
        END END AS is_satisfied
      FROM (SELECT *, coalesce((SELECT n FROM size WHERE set_id = first), 0) AS n FROM statement)),
    """


KINDS = ["existence", "containment", "exclusion", "cardinality", "coverage", "correspondence", "refinement"]


def _sql_statements(tail: str) -> str:
    sig = "sig AS (SELECT layer, grp, list_sort(list(id)) AS s FROM membership GROUP BY 1, 2)"
    body = _STATEMENT.rstrip().rstrip(",").replace("verdict AS (", f"{sig},\n    verdict AS (")
    return f"{C}, {MEMBERSHIP_SQL}, {PEAK_SQL}, {_DEFINED}, {body} {tail}"


def _statements(nodes):
    spark = nodes.sparkSession
    none = F.lit(None).cast("string")
    defined = _definitions(nodes).select("set_id").distinct()
    pairing = nodes.select("type", "brand").distinct()

    def rows(df, sid: Column, kind, first=none, second=none, operator=none, value=None):
        return df.select(
            sid.alias("statement_id"), F.lit(kind).alias("type"), first.alias("first"), second.alias("second"),
            operator.alias("operator"), F.lit(value).cast("long").alias("value"),
        )

    def given(values):
        return spark.createDataFrame([(v,) for v in values], "v string")

    s, v = F.col("set_id"), F.col("v")
    one = given([""])
    every = defined.unionByName(spark.createDataFrame([("*",)], "set_id string"))
    # pairs of the few defined names, listed through arrays
    with_all = lambda df, values: df.select("*", F.explode(F.array(*[F.lit(x) for x in values])).alias("v"))
    names = defined.agg(F.sort_array(F.collect_list("set_id"))).scalar()
    parts = [
        rows(defined, F.concat(F.lit("e1-"), s), "existence", s),
        rows(one, F.lit("e1-none"), "existence", F.lit("missing")),
        rows(pairing, F.concat_ws("-", F.lit("e2"), "type", "brand"), "containment", F.concat(F.lit("tag:"), "type"), F.col("brand")),
        rows(pairing.select("type").distinct(), F.concat(F.lit("e2-own-"), "type"), "containment", F.concat(F.lit("tag:"), "type"), F.col("type")),
        rows(one, F.lit("e2-absent"), "containment", F.lit("mixed"), F.lit("no-such-group")),
        rows(one, F.lit("e2-empty"), "containment", F.lit("loose"), F.lit("promo")),
        rows(defined.select("*", F.explode(names).alias("v")), F.concat(F.lit("e3-"), s, F.lit("-"), v), "exclusion", s, v),
        rows(with_all(defined, ["==", "!=", "<=", ">=", "<", ">", "~"]), F.concat(F.lit("e4-"), s, v), "cardinality", s, none, v, 300),
        rows(with_all(every, ["by-type", "by-both", "nowhere"]), F.concat(F.lit("e5-"), s, v), "coverage", s, v),
        rows(with_all(given(["by-type", "by-brand"]).toDF("set_id"), ["by-type", "by-both"]), F.concat(F.lit("e6-"), s, v), "correspondence", s, v),
        rows(with_all(given(["by-type", "by-both"]).toDF("set_id"), ["by-type", "by-brand", "by-both"]), F.concat(F.lit("e7-"), s, v), "refinement", s, v),
        rows(one, F.lit("e6-absent"), "correspondence", F.lit("by-type"), F.lit("absent")),
        rows(one, F.lit("e7-absent"), "refinement", F.lit("absent"), F.lit("by-type")),
        *[rows(one, F.lit(f"e8-semi-{kind}"), kind) for kind in KINDS],
        *[rows(one, F.lit(f"e8-part-{kind}"), kind, F.lit("mixed")) for kind in ("containment", "exclusion")],
        rows(one, F.lit("e8-informal"), None),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    status = F.when(F.col("type").isNull(), "informal").when(F.startswith("statement_id", F.lit("e8-")), "semi_formal").otherwise("formal")
    return out.withColumn("type", F.col("type").cast("string")).withColumn("status", status)


def _judged(spark, folder):
    nodes = components(spark, folder)
    member = memberships(nodes)
    found = saved(spark, intent.resolve_sets(_definitions(nodes), nodes, member))
    statements = saved(spark, _statements(nodes))
    return statements, found, member, nodes, saved(spark, peak_edges(spark, folder))


@query("e01_to_e08_evaluate_statements", _sql_statements("SELECT statement_id, type, is_satisfied FROM verdict"))
def evaluate(spark, folder):
    return intent.evaluate_statements(*_judged(spark, folder))


@query(
    "e09_a19_statement_summary",
    _sql_statements("""SELECT count(*) AS total, count(*) FILTER (is_satisfied) AS satisfied, count(*) FILTER (NOT is_satisfied) AS violated,
    count(*) FILTER (is_satisfied IS NULL) AS not_evaluated FROM verdict"""),
)
def _(spark, folder):
    return intent.statement_summary(evaluate(spark, folder))


@query(
    "v08_stability",
    _sql_statements("""SELECT count(*) FILTER (is_satisfied) AS satisfied, count(*) FILTER (NOT is_satisfied) AS violated,
    count(*) FILTER (is_satisfied IS NULL) AS unverified, count(*) FILTER (NOT is_satisfied) = 0 AS stable FROM verdict"""),
)
def _(spark, folder):
    return snapshots.stability(evaluate(spark, folder))[0]


@query("v08_blocking_statements", _sql_statements("SELECT statement_id, type FROM verdict WHERE NOT is_satisfied"))
def _(spark, folder):
    return snapshots.stability(evaluate(spark, folder))[1].select("statement_id", "type")


@query(
    "e10_witnesses",
    _sql_statements("""SELECT type, first, second, CAST(m.id AS VARCHAR) AS witness, NULL AS other FROM (SELECT DISTINCT type, first, second FROM statement WHERE type = 'containment') s
      JOIN member m ON m.set_id = first WHERE NOT EXISTS (SELECT 1 FROM membership g WHERE g.grp = second AND g.id = m.id)
    UNION ALL SELECT type, first, second, CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM (SELECT DISTINCT type, first, second FROM statement WHERE type = 'exclusion') s
      JOIN member a ON a.set_id = first JOIN peak ON src = a.id JOIN member b ON b.id = dst AND b.set_id = second
    UNION ALL SELECT type, first, second, CAST(m.id AS VARCHAR), NULL FROM (SELECT DISTINCT type, first, second FROM statement WHERE type = 'coverage') s
      JOIN (SELECT set_id, id FROM member UNION ALL SELECT '*', id FROM component) m ON m.set_id = first WHERE NOT EXISTS (SELECT 1 FROM membership g WHERE g.layer = second AND g.id = m.id)
    UNION ALL SELECT type, first, second, x.grp, x.layer FROM (SELECT DISTINCT type, first, second FROM statement WHERE type = 'correspondence') s
      JOIN sig x ON (x.layer = first AND x.s NOT IN (SELECT s FROM sig y WHERE y.layer = second)) OR (x.layer = second AND x.s NOT IN (SELECT s FROM sig y WHERE y.layer = first))
    UNION ALL SELECT type, first, second, f.grp, NULL FROM (SELECT DISTINCT type, first, second FROM statement WHERE type = 'refinement') s
      JOIN sig f ON f.layer = first WHERE NOT EXISTS (SELECT 1 FROM sig c WHERE c.layer = second AND list_has_all(c.s, f.s))"""),
)
def _(spark, folder):
    return intent.statement_witnesses(*_judged(spark, folder))


@query(
    "u05_subset_test",
    f"""{C} SELECT NOT EXISTS (SELECT 1 FROM component WHERE list_contains(tags, 'economy') AND NOT internal) AS economy_is_internal,
    NOT EXISTS (SELECT 1 FROM component WHERE list_contains(tags, 'large') AND NOT internal) AS large_is_internal""",
)
def _(spark, folder):
    outside = lambda tag: F.count_if(tagexpr.tag_predicate(tag) & ~F.col("internal")) == 0
    return components(spark, folder).agg(
        outside("economy").alias("economy_is_internal"), outside("large").alias("large_is_internal")
    )


@query(
    "a24_momentum",
    _sql_statements(f"""SELECT round((SELECT avg(0.6 * coalesce(i, 0) + 0.4 * coalesce(o, 0)) FROM component LEFT JOIN (SELECT dst AS id, count(*) AS i FROM peak GROUP BY 1) USING (id)
        LEFT JOIN (SELECT src AS id, count(*) AS o FROM peak GROUP BY 1) USING (id)), 6)::DOUBLE AS avg_coupling,
      (SELECT count(DISTINCT scc_id) FROM scc WHERE scc_size > 1) AS cyclic_components,
      coalesce((SELECT max(scc_size) FROM scc WHERE scc_size > 1), 0) AS largest_cycle,
      (SELECT count(*) FROM violation) AS violations,
      round(count(*) FILTER (statement_id NOT LIKE 'e8-%') / count(*)::DOUBLE, 6) AS formal_ratio, round(count(*) FILTER (is_satisfied) / count(*)::DOUBLE, 6) AS satisfied_ratio FROM verdict""")
    .replace("WITH ", f"WITH RECURSIVE {NODE}, ", 1)
    .replace("pairing AS (", f"{_ASSIGN.strip()}, {_VIOLATION.strip()}, {_big_scc('peak').strip()},\n    pairing AS (", 1),
)
def _(spark, folder):
    statements, found, member, nodes, e = _judged(spark, folder)
    n = saved(spark, part_nodes(spark, folder))
    verdict = intent.evaluate_statements(statements, found, member, nodes, e)
    verdict = saved(spark, verdict.join(statements.select("statement_id", "status"), "statement_id"))
    out = snapshots.momentum(
        adj.node_degrees(nodes, e),
        saved(spark, cycles.scc_ranking(e, cycles.scc(n, e))),
        layers.layer_violations(e, _assigned(nodes)),  # only counted, so no row of it is written
        verdict,
    )
    six = ("avg_coupling", "formal_ratio", "satisfied_ratio")
    return out.select(*[F.round(c, 6).alias(c) if c in six else F.col(c) for c in out.columns])
