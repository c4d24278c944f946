"""Registered queries on document ingest, linking, upserts and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import text
from strataweave.operators import adjacency as adj
from strataweave.operators import layers, linking
from strataweave.plans.catalog_graph import NODE, _deg
from strataweave.plans.catalog_scope import _ASSIGN, _VIOLATION, C, _assigned
from strataweave.plans.graphs import PEAK_SQL, part_nodes, peak_edges, table
from strataweave.plans.inputs import COMPONENT_SQL, components, saved
from strataweave.plans.registry import query
from strataweave.scratch import Scratch
from strataweave.sources import documents as docs
from strataweave.sources import tables

PREFIX = "pkg:maven/org.shop"

# ---- SBOM documents: one per order line, listing the part, its supplier and an unnamed entry ----


def _sboms(spark, folder):
    """(doc, text): a JSON document per order line; lines returned ('R') are cut off and unreadable."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    part = F.concat(F.lit("pkg:maven/org.shop.brand"), (F.col("l_suppkey")).cast("string"), F.lit("/part-"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("pkg:maven/com.supply/supplier-"), F.col("l_suppkey").cast("string"))
    v = F.concat(F.lit("@"), F.col("l_linenumber").cast("string"), F.lit(".0"))
    item = lambda ref, scope: F.struct(ref.alias("bom-ref"), F.lit("x").alias("name"), F.lit("9").alias("version"), scope.alias("scope"))
    scope = F.when(F.col("l_linestatus") == "O", "optional")
    body = F.to_json(
        F.struct(
            F.array(item(F.concat(part, v), F.lit("required")), item(supplier, scope), item(F.lit(""), F.lit(None).cast("string"))).alias("components"),
            F.array(
                F.struct(F.concat(part, v).alias("ref"), F.array(supplier, F.lit("pkg:maven/not/listed@1")).alias("dependsOn")),
                F.struct(F.lit("pkg:npm/unknown@2").alias("ref"), F.array(supplier).alias("dependsOn")),
            ).alias("dependencies"),
        )
    )
    doc = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    broken = F.when(F.col("l_returnflag") == "R", F.substring(body, 1, 40)).otherwise(body)
    return line.select(doc.alias("doc"), broken.alias("text"))


_LINE = """
    line AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS doc, l_returnflag AS flag,
             'pkg:maven/org.shop.brand' || l_suppkey || '/part-' || l_partkey AS part, 'pkg:maven/com.supply/supplier-' || l_suppkey AS supplier,
             'part-' || l_partkey AS part_name, 'supplier-' || l_suppkey AS supplier_name, 'brand' || l_suppkey AS brand, CAST(l_linenumber AS VARCHAR) || '.0' AS v, l_linestatus AS st FROM lineitem),
    good AS (SELECT * FROM line WHERE flag <> 'R')"""


@query("s02_sbom_rejects", f"WITH {_LINE} SELECT doc, 'unreadable document' AS error FROM line WHERE flag = 'R'")
def _(spark, folder):
    return docs.parse_sboms(_sboms(spark, folder))[1]


@query(
    "s02_s11_sbom_files",
    """SELECT 'package' AS kind, 'brand' || l_suppkey AS owner, 'pkg:maven/org.shop.brand' || l_suppkey || '/part-' || l_partkey AS item FROM lineitem
    WHERE l_suppkey % 5 <> 0 GROUP BY ALL
    UNION ALL SELECT 'reject', 'brand' || l_suppkey, 'unreadable document' FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY ALL""",
)
def sbom_files(spark, folder):
    """One SBOM file for each supplier, written and read as whole files; of every fifth the list is no list.

    The rejects go to the sink and are read back from it. A file costs more than its rows, so the files are dealt to all
    cores, however few bytes they hold.
    """
    place = Scratch(spark, "sbom-files").base
    tasks = 4 * spark.sparkContext.defaultParallelism
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ref = F.concat(F.lit("pkg:maven/org.shop.brand"), F.col("l_suppkey").cast("string"), F.lit("/part-"), F.col("l_partkey").cast("string"))
    item = F.struct(F.concat(ref, F.lit("@1")).alias("bom-ref"), F.lit("x").alias("name"), F.lit("1").alias("version"))
    fine = F.col("l_suppkey") % 5 != 0
    # a document lists what one supplier delivers
    listed = line.where(fine).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.collect_list(item).alias("components"))
    listed.repartition(tasks, "supplier").write.partitionBy("supplier").json(f"{place}/in")
    wrong = line.where(~fine).select(F.col("l_suppkey").alias("supplier"), F.lit("no list").alias("components")).distinct()
    wrong.repartition(tasks, "supplier").write.mode("append").partitionBy("supplier").json(f"{place}/in")
    good, bad = docs.read_sboms(spark, f"{place}/in")
    tables.save_rejects(bad, f"{place}/rejects")
    rejects = spark.read.schema("doc string, error string").json(f"{place}/rejects")
    owner = F.concat(F.lit("brand"), F.regexp_extract("doc", r"/supplier=(\d+)/", 1)).alias("owner")
    found = docs.sbom_packages(good, PREFIX).select(F.lit("package").alias("kind"), owner, F.col("purl_key").alias("item"))
    return found.unionByName(rejects.select(F.lit("reject").alias("kind"), owner, F.col("error").alias("item")))


@query(
    "s03_sbom_packages",
    f"""WITH {_LINE} SELECT doc, 0 AS pos, part || '@' || v AS bom_ref, part AS purl_key, v AS version, true AS internal, brand AS group_key FROM good
    UNION ALL SELECT doc, 1, supplier, supplier, '9', false, NULL FROM good""",
)
def sbom_packages(spark, folder):
    good, _ = docs.parse_sboms(_sboms(spark, folder))
    return docs.sbom_packages(good, PREFIX).select("doc", "pos", "bom_ref", "purl_key", "version", "internal", "group_key")


@query(
    "t08_t09_sbom_components",
    f"""WITH {_LINE}, p AS (SELECT part AS purl_key, first(v ORDER BY doc) AS version, any_value('org.shop.' || brand || ':' || part_name) AS key,
      any_value('org.shop.' || brand || '.' || part_name) AS name, any_value(brand) AS group_key, true AS internal FROM good GROUP BY 1
      UNION ALL SELECT supplier, '9', any_value('com.supply:' || supplier_name), any_value('com.supply.' || supplier_name), NULL, false FROM good GROUP BY 1)
    SELECT * FROM p""",
)
def sbom_components(spark, folder):
    good, _ = docs.parse_sboms(_sboms(spark, folder))
    return docs.sbom_components(docs.sbom_packages(good, PREFIX)).select(
        "purl_key", "version", "key", "name", "group_key", "internal"
    )


@query("s04_t20_sbom_edges", f"WITH {_LINE} SELECT DISTINCT part AS src, supplier AS dst, 'compile' AS scope, 1 AS weight FROM good")
def sbom_edges(spark, folder):
    good, _ = docs.parse_sboms(_sboms(spark, folder))
    good = saved(spark, good)
    return docs.sbom_edges(good, docs.sbom_components(docs.sbom_packages(good, PREFIX)))


@query(
    "s05_package_links",
    f"""WITH {_LINE} SELECT DISTINCT doc AS src, part AS dst, 'direct' AS scope FROM good
    UNION SELECT doc, supplier, CASE WHEN st = 'O' THEN 'transitive' ELSE 'direct' END FROM good""",
)
def _(spark, folder):
    return docs.package_links(docs.parse_sboms(_sboms(spark, folder))[0])


# ---- POM documents: one per part, depending on the next parts of its release ------------------


def _poms(spark, folder):
    """(doc, text): an XML document per part; tiny parts leave out a coordinate."""
    nodes = components(spark, folder)
    named = nodes.select(F.col("id").alias("dst"), F.col("group_id").alias("dg"), F.col("artifact_id").alias("da"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    scope = F.when(F.col("scope") == "runtime", "<scope>test</scope>").otherwise("")
    e = peak_edges(spark, folder).join(named, "dst").groupBy("src").agg(
        F.array_join(
            F.sort_array(
                F.collect_list(  # at most two per part
                    F.concat(F.lit("<dependency>"), tag("groupId", F.col("dg")), tag("artifactId", F.col("da")), scope, F.lit("</dependency>"))
                )
            ),
            "",
        ).alias("deps")
    )
    rows = nodes.join(e, F.col("id") == F.col("src"), "left")
    own = F.when(F.col("size") <= 25, tag("groupId", F.col("group_id"))).otherwise(
        F.concat(F.lit("<parent>"), tag("groupId", F.concat(F.lit(" "), "group_id", F.lit(" "))), F.lit("</parent>"))
    )
    own = F.when(F.col("size") == 1, "").otherwise(own)
    artifact = F.when(F.col("size") == 2, "").otherwise(tag("artifactId", F.col("artifact_id")))
    scm = F.when(F.col("type") == "promo", F.concat(F.lit("scm:git:git@host.example:"), "group_key", F.lit(".git"))).when(
        F.col("type") == "small", F.concat(F.lit("https://host.example/"), "group_key")
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0">'), own, artifact,
        tag("version", F.col("version")), tag("dependencies", F.coalesce("deps", F.lit(""))),
        F.when(F.col("type") == "large", tag("modules", tag("module", F.col("brand")))).otherwise(""),
        F.coalesce(tag("scm", tag("connection", scm)), F.lit("")), F.lit("</project>"),
    )
    path = F.concat(F.lit("cache/"), F.replace(F.col("key"), F.lit(":"), F.lit("/")), F.lit("/pom.xml"))
    return rows.select(path.alias("doc"), xml.alias("text"))


_POM = f"""{COMPONENT_SQL},
    pom AS (SELECT *, group_id || ':' || artifact_id AS pkey, 'cache/' || replace(key, ':', '/') || '/pom.xml' AS doc,
      CASE WHEN type = 'promo' THEN 'scm:git:git@host.example:' || group_key || '.git' WHEN type = 'small' THEN 'https://host.example/' || group_key END AS scm FROM component),
    fine AS (SELECT * FROM pom WHERE size > 2)"""


@query(
    "s06_s07_s09_pom_projects",
    f"""WITH {_POM} SELECT doc, pkey AS key, group_id, artifact_id, version, artifact_id AS name, CASE WHEN type = 'large' THEN brand ELSE '' END AS modules, scm FROM fine""",
)
def pom_projects(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    return good.select("doc", "key", "group_id", "artifact_id", "version", "name", F.array_join("modules", ",").alias("modules"), "scm")


@query(
    "s07_s11_pom_rejects",
    f"WITH {_POM} SELECT doc, CASE size WHEN 1 THEN 'no groupId' ELSE 'no artifactId' END AS error FROM pom WHERE size <= 2",
)
def _(spark, folder):
    return docs.parse_poms(_poms(spark, folder))[1]


_POM_DEPS = f"""{_POM}, {PEAK_SQL},
    dep AS (SELECT a.pkey AS key, b.pkey AS target_key, b.group_id, b.artifact_id, 'compile' AS scope FROM peak_scoped JOIN fine a ON a.id = src JOIN pom b ON b.id = dst WHERE scope = 'compile')"""


@query("s08_pom_dependencies", f"WITH {_POM_DEPS} SELECT key, target_key, group_id, artifact_id, scope FROM dep")
def pom_dependencies(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    return docs.pom_dependencies(good).drop("version")


@query(
    "t14_external_targets",
    f"WITH {_POM_DEPS} SELECT DISTINCT target_key AS key, group_id, artifact_id FROM dep WHERE target_key NOT IN (SELECT pkey FROM fine)",
)
def _(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    good = saved(spark, good)
    return linking.external_targets(docs.pom_dependencies(good), good).select("key", "group_id", "artifact_id")


@query(
    "t24_dry_run_counts",
    f"WITH {_POM} SELECT count(*) AS projects, count(*) FILTER (type = 'large') AS multi_module, count(scm) AS with_scm FROM fine",
)
def _(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    return linking.dry_run(good)[0]


@query("t24_dry_run_sample", f"WITH {_POM} SELECT pkey AS key, name, version FROM fine ORDER BY pkey LIMIT 10")
def _(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    return linking.dry_run(good)[1]


@query("s14_cached_projects", f"{C} SELECT replace(key, ':', '/') AS path FROM component")
def _(spark, folder):
    return docs.cached_projects(_poms(spark, folder).select("doc"), "cache")


@query("t16_scm_paths", f"{C} SELECT key, CASE WHEN type IN ('promo', 'small') THEN group_key END AS path FROM component WHERE size > 2")
def _(spark, folder):
    good, _ = docs.parse_poms(_poms(spark, folder))
    named = components(spark, folder).select("key", F.concat_ws(":", "group_id", "artifact_id").alias("_p"))
    return good.select(F.col("key").alias("_p"), text.scm_path(F.col("scm")).alias("path")).join(named, "_p").select("key", "path")


def _link_inputs(spark, folder):
    nodes = components(spark, folder)
    poms = nodes.select(
        F.concat(F.replace("group_key", F.lit("."), F.lit("/")), F.lit("/"), "name", F.lit("/pom.xml")).alias("file"), "key",
        F.when(F.col("type") == "promo", F.concat(F.lit("https://host.example/"), "brand", F.lit(".git"))).alias("scm"),
    )
    paths = nodes.where("type <> 'promo' AND group_key IS NOT NULL").select(F.replace("group_key", F.lit("."), F.lit("/")).alias("path"), "type")
    paths = paths.unionByName(nodes.select(F.col("type").alias("path"), "type").where("type <> 'promo'"))
    paths = paths.unionByName(nodes.select(F.col("brand").alias("path"), F.col("brand").alias("type"))).distinct()
    linked = F.when(F.col("type") == "small", "taken")
    return poms.where("file IS NOT NULL"), paths.select(F.concat(F.lit("p:"), "path").alias("project"), "path", linked.alias("linked_key"))


_LINKS = """
    item AS (SELECT key, type, brand, type || '/' || brand || '/' || name || '/pom.xml' AS file FROM component WHERE group_key IS NOT NULL),
    proj AS (SELECT DISTINCT type || '/' || brand AS path, type FROM component WHERE type <> 'promo' AND group_key IS NOT NULL
             UNION SELECT DISTINCT type, type FROM component WHERE type <> 'promo' UNION SELECT DISTINCT brand, brand FROM component),
    hit AS (SELECT key, file, path, row_number() OVER (PARTITION BY file ORDER BY length(path) DESC) AS r FROM item JOIN proj ON starts_with(file, path || '/'))"""


@query("t15_j10_longest_prefix", f"{C}, {_LINKS} SELECT file, 'p:' || path AS project FROM hit WHERE r = 1")
def _(spark, folder):
    poms, projects = _link_inputs(spark, folder)
    return linking.longest_prefix(poms.select("file"), projects)


@query(
    "t17_link_projects",
    f"""{C}, {_LINKS}, by_path AS (SELECT key, path, 'path' AS via FROM hit WHERE r = 1),
    both AS (SELECT * FROM by_path UNION ALL SELECT key, brand, 'scm' FROM item WHERE type = 'promo' AND file NOT IN (SELECT file FROM hit)),
    pick AS (SELECT path, key, via, row_number() OVER (PARTITION BY path ORDER BY via, key) AS r FROM both)
    SELECT 'p:' || path AS project, key, via FROM pick WHERE r = 1 AND path NOT IN (SELECT path FROM proj WHERE type = 'small')""".replace("both AS", "joint AS").replace("FROM both", "FROM joint"),
)
def link_projects(spark, folder):
    poms, projects = _link_inputs(spark, folder)
    return linking.link_projects(poms, projects)


@query(
    "t18_link_roots",
    f"""{C}, n AS (SELECT type || '/' || brand AS project_path, key, name, id FROM component WHERE group_key IS NOT NULL),
    h AS (SELECT project_path, key, row_number() OVER (PARTITION BY project_path ORDER BY id, key) AS r FROM n WHERE contains(key, split_part(project_path, '/', 2)))
    SELECT project_path, key FROM h WHERE r = 1""",
)
def _(spark, folder):
    nodes = components(spark, folder).where("group_key IS NOT NULL")
    path = F.replace("group_key", F.lit("."), F.lit("/"))
    rows = nodes.select(path.alias("project_path"), F.lit("project").alias("node_type"), F.col("key").alias("artifact_id"), "key", F.col("id").alias("seq"))
    return linking.link_roots(nodes.select(path.alias("project_path")).distinct(), rows)


# ---- module trees, listings, line formats -------------------------------------------------------


@query(
    "s10_module_tree",
    """WITH RECURSIVE m AS (SELECT DISTINCT lower(p_type) AS path, lower(replace(p_brand, '#', '-')) AS module FROM part
        UNION SELECT DISTINCT lower(p_type) || '/' || lower(replace(p_brand, '#', '-')), replace(p_name, ' ', '-') FROM part),
    t AS (SELECT DISTINCT path AS root, path, 0 AS depth FROM m WHERE path NOT IN (SELECT path || '/' || module FROM m)
        UNION SELECT root, t.path || '/' || module, depth + 1 FROM t JOIN m ON m.path = t.path WHERE depth < 10)
    SELECT root, path, depth FROM t""",
)
def _(spark, folder):
    p = table(spark, folder, "part").select(
        F.lower("p_type").alias("t"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("b"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("n")
    )
    first = p.select(F.col("t").alias("path"), F.col("b").alias("module"))
    return docs.module_tree(first.unionByName(p.select(F.concat_ws("/", "t", "b").alias("path"), F.col("n").alias("module"))))


@query(
    "s12_listing_defaults",
    """SELECT c_custkey AS id, c_name AS name, '' AS path, CASE WHEN c_acctbal < 0 THEN '' ELSE lower(c_name) END AS path_with_namespace,
    coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS description, 'main' AS default_branch, '' AS web_url FROM customer""",
)
def _(spark, folder):
    none = F.lit(None).cast("string")
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), none.alias("path"),
        F.when(F.col("c_acctbal") >= 0, F.lower("c_name")).alias("path_with_namespace"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description"), none.alias("default_branch"),
        F.create_map(F.lit("kind"), F.lit("group")).alias("namespace"), none.alias("web_url"),
    )
    return docs.with_listing_defaults(rows).drop("namespace")


@query(
    "s12_listing_files",
    """SELECT c_custkey AS id, c_name AS name, '' AS path, CASE WHEN c_acctbal < 0 THEN '' ELSE lower(c_name) END AS path_with_namespace,
    coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS description, 'main' AS default_branch, '' AS web_url FROM customer""",
)
def _(spark, folder):
    """The listing as it is served: pages of at most 100 projects, one JSON array in each file, read from the files."""
    place = Scratch(spark, "listing").base
    row = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.lower("c_name")).alias("path_with_namespace"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description"),
        F.create_map(F.lit("kind"), F.lit("group")).alias("namespace"),
    )
    page = F.floor(F.col("c_custkey") / 100).alias("page")
    pages = table(spark, folder, "customer").groupBy(page).agg(F.to_json(F.collect_list(row)).alias("value"))
    pages.write.partitionBy("page").text(f"{place}/in")
    return docs.read_listing(spark, f"{place}/in/*").drop("namespace")


@query(
    "s13_unique_projects",
    "SELECT l_partkey AS id, min(CAST(l_suppkey AS VARCHAR)) AS path FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("path"))
    return docs.unique_projects(rows)


@query(
    "s15_t22_not_cached",
    "SELECT o_orderkey AS doc FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')",
)
def _(spark, folder):
    wanted = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"))
    cache = table(spark, folder, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("doc"))
    return docs.not_cached(wanted, cache, "doc")


@query(
    "s16_line_edges",
    "SELECT l_orderkey AS src, 'org.shop:part-' || l_partkey AS dst FROM lineitem UNION ALL SELECT l_orderkey, 'supplier:' || l_suppkey FROM lineitem",
)
def _(spark, folder):
    line = table(spark, folder, "lineitem")
    value = F.concat(
        F.lit("\n org.shop:part-"), F.col("l_partkey").cast("string"), F.lit("\nheading\n"), F.lit("supplier:"), F.col("l_suppkey").cast("string"), F.lit("\n")
    )
    return docs.line_edges(line.select(F.col("l_orderkey").alias("src"), value.alias("value")))


@query(
    "s17_iso_timestamps",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events",
)
def _(spark, folder):
    e = table(spark, folder, "events")
    raw = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return e.select("event_id", text.iso_timestamp(raw).cast("timestamp_ntz").alias("parsed"))


@query("s18_base64_content", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"))
    return d.select("doc_id", F.md5(text.decoded(F.col("content"))).alias("digest"))


# ---- resolved graph -------------------------------------------------------------------------------


def _resolved(spark, folder):
    """Node and edge tables as a dependency resolver writes them."""
    nodes = components(spark, folder)
    kind = F.when(F.col("type") == "large", "module").when(F.col("type") == "promo", "project").otherwise("artifact")
    node_id = F.concat_ws(":", kind, "group_id", "brand", "version")
    rows = nodes.select("id", node_id.alias("node_id"), kind.alias("node_type"))
    e = peak_edges(spark, folder)
    ends = rows.select("id", "node_id")
    e = e.join(ends.toDF("src", "from_node"), "src").join(ends.toDF("dst", "to_node"), "dst")
    scope = F.when(F.col("scope") == "compile", "").otherwise(F.col("scope"))
    return rows.select(F.col("node_id").alias("id"), "node_type"), e.select("from_node", "to_node", scope.alias("scope"))


_RESOLVED = f"""{COMPONENT_SQL}, {PEAK_SQL},
    r AS (SELECT id, type, group_id || ':' || brand AS key, group_id, brand, version, CASE type WHEN 'promo' THEN 'project' ELSE 'artifact' END || ':' || group_id || ':' || brand || ':' || version AS nid
          FROM component WHERE type <> 'large')"""


@query(
    "s19_graph_components",
    f"WITH {_RESOLVED} SELECT key, any_value(group_id) AS group_id, any_value(brand) AS artifact_id, first(version ORDER BY nid) AS version, bool_or(starts_with(group_id, 'org.promo')) AS internal FROM r GROUP BY key",
)
def _(spark, folder):
    nodes, _ = _resolved(spark, folder)
    return docs.graph_components(docs.graph_nodes(nodes, "org.promo"))


@query(
    "s19_graph_edges",
    f"""WITH {_RESOLVED} SELECT DISTINCT a.key AS src, b.key AS dst, scope, 1 AS weight FROM peak_scoped JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE a.key <> b.key""",
)
def _(spark, folder):
    nodes, edges = _resolved(spark, folder)
    return docs.graph_edges(edges.distinct(), docs.graph_nodes(nodes))


# ---- keys, names, package URLs ----------------------------------------------------------------------


@query(
    "t01_key_parts",
    f"""{C}, k AS (SELECT key AS k FROM component UNION ALL SELECT group_id || '.' || name FROM component UNION ALL SELECT brand || '/' || type || '/' || name FROM component UNION ALL SELECT name || ':' FROM component UNION ALL SELECT name FROM component)
    SELECT k AS key, CASE WHEN regexp_matches(k, '^.+:[^:]+$') THEN regexp_replace(k, ':[^:]+$', '') WHEN regexp_matches(k, '^.+/[^/]+$') THEN regexp_replace(k, '/[^/]+$', '')
       WHEN regexp_matches(k, '^.+[.][^.]+$') THEN regexp_replace(k, '[.][^.]+$', '') END AS group_key,
     CASE WHEN regexp_matches(k, '^.+:[^:]+$') THEN regexp_extract(k, '([^:]+)$', 1) WHEN regexp_matches(k, '^.+/[^/]+$') THEN regexp_extract(k, '([^/]+)$', 1)
       WHEN regexp_matches(k, '^.+[.][^.]+$') THEN regexp_extract(k, '([^.]+)$', 1) ELSE k END AS name FROM k""",
)
def _(spark, folder):
    n = components(spark, folder)
    forms = F.array("key", F.concat_ws(".", "group_id", "name"), F.concat_ws("/", "brand", "type", "name"), F.concat("name", F.lit(":")), F.col("name"))
    return n.select(F.explode(forms).alias("key")).select("key", text.key_parts(F.col("key")).alias("p")).select("key", "p.group_key", "p.name")


_TITLE = "list_aggregate(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


@query(
    "t02_group_titles",
    f"""{C}, g AS (SELECT DISTINCT group_id AS group_key FROM component)
    SELECT group_key, {_TITLE.format("replace(group_key, '.', ' ')")} AS title FROM g""",
)
def _(spark, folder):
    g = components(spark, folder).select(F.col("group_id").alias("group_key")).distinct()
    return g.select("group_key", text.group_title(F.col("group_key")).alias("title"))


@query(
    "t03_t04_t05_package_urls",
    f"""WITH {_LINE} SELECT doc, part || '@' || v AS purl, 'maven' AS type, 'org.shop.' || brand AS namespace, part_name AS artifact, v AS version, part AS base,
    brand AS group_key, part_name AS basename, 'org.shop.' || brand || '.' || part_name AS full_name FROM line""",
)
def _(spark, folder):
    line = table(spark, folder, "lineitem")
    doc = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    purl = F.concat(
        F.lit("pkg:maven/org.shop.brand"), F.col("l_suppkey").cast("string"), F.lit("/part-"), F.col("l_partkey").cast("string"),
        F.lit("@"), F.col("l_linenumber").cast("string"), F.lit(".0"),
    )
    p = line.select(doc.alias("doc"), purl.alias("purl"))
    p = p.select("*", text.purl_parts(F.col("purl")).alias("p"), text.purl_base(F.col("purl")).alias("base"))
    p = p.withColumn("g", text.purl_group(F.col("base"), PREFIX))
    return p.select("doc", "purl", "p.*", "base", "g.*")


_HIERARCHY = """
    g AS (SELECT DISTINCT string_split(group_id, '.') AS p FROM component),
    h AS (SELECT DISTINCT array_to_string(p[1:i], '.') AS key, p[i] AS segment, CASE WHEN i > 1 THEN array_to_string(p[1:i - 1], '.') END AS parent_key, CAST(i - 1 AS INTEGER) AS depth
          FROM g, (SELECT unnest(range(1, 10)) AS i) WHERE i <= len(p))"""


@query("t06_group_hierarchy", f"{C}, {_HIERARCHY} SELECT key, upper(segment[1]) || segment[2:] AS name, parent_key, depth FROM h")
def _(spark, folder):
    return linking.group_hierarchy(components(spark, folder), "group_id")


@query("t07_raw_group_hierarchy", f"{C}, {_HIERARCHY} SELECT key, segment AS name, parent_key, depth FROM h")
def _(spark, folder):
    return linking.group_hierarchy(components(spark, folder), "group_id", titles=False)


@query(
    "g35_group_ancestors",
    f"""WITH RECURSIVE {COMPONENT_SQL}, {_HIERARCHY}, up AS (SELECT key, parent_key AS ancestor, 1 AS distance FROM h WHERE parent_key IS NOT NULL
      UNION SELECT up.key, h.parent_key, distance + 1 FROM up JOIN h ON h.key = ancestor WHERE h.parent_key IS NOT NULL)
    SELECT key, ancestor, distance FROM up""",
)
def _(spark, folder):
    return linking.group_paths(saved(spark, linking.group_hierarchy(components(spark, folder), "group_id"))).drop("full_path")


@query("t23_coordinates", f"{C} SELECT key, name AS basename, group_id || ':' || artifact_id || ':' || version AS coordinate FROM component")
def _(spark, folder):
    return components(spark, folder).select(
        "key", text.basename(F.col("key")).alias("basename"),
        text.maven_coordinate(F.col("group_id"), F.col("artifact_id"), F.col("version")).alias("coordinate"),
    )


# ---- matching, upserts, insert-if-absent ------------------------------------------------------------


@query(
    "t10_match_existing",
    f"""{C}, old AS (SELECT * FROM component WHERE size <= 30),
    new AS (SELECT id, CASE WHEN type = 'small' THEN 'other' ELSE group_id END AS group_id, artifact_id, name FROM component)
    SELECT new.id, coalesce(a.key, b.key) AS matched_key, CASE WHEN a.key IS NOT NULL THEN 'coordinate' WHEN b.key IS NOT NULL THEN 'name' END AS matched_by
    FROM new LEFT JOIN old a ON a.group_id = new.group_id AND a.artifact_id = new.artifact_id LEFT JOIN old b ON b.name = new.name""",
)
def _(spark, folder):
    n = components(spark, folder)
    new = n.select("id", F.when(F.col("type") == "small", "other").otherwise(F.col("group_id")).alias("group_id"), "artifact_id", "name")
    return linking.match_existing(new, n.where("size <= 30")).select("id", "matched_key", "matched_by")


def _upsert(spark, folder):
    n = components(spark, folder)
    old = n.where("size <= 35").select("key", "name", "version", "internal", "group_key")
    new = n.where("size >= 15").select(
        "key", F.lower("name").alias("name"), F.when(F.col("type") == "promo", "").otherwise(F.concat("version", F.lit("-new"))).alias("version"),
        F.lit(True).alias("internal"), F.lit(None).cast("string").alias("group_key"),
    )
    return linking.upsert_components(old, new)


_UPSERT = """
    up AS (SELECT key, name, CASE WHEN size < 15 OR (type = 'promo' AND size <= 35) THEN version WHEN type = 'promo' THEN NULL ELSE version || '-new' END AS version,
           CASE WHEN size < 15 THEN internal ELSE true END AS internal, CASE WHEN size <= 35 THEN group_key END AS group_key,
           CASE WHEN size < 15 THEN 'kept' WHEN size <= 35 THEN 'updated' ELSE 'created' END AS action FROM component)"""


@query("t11_upsert_components", f"{C}, {_UPSERT} SELECT key, name, version, internal, group_key, action FROM up")
def upsert_components(spark, folder):
    return _upsert(spark, folder)


@query("t19_import_summary", f"{C}, {_UPSERT} SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'kept') AS kept FROM up")
def _(spark, folder):
    return linking.import_summary(_upsert(spark, folder))


_ORDERED_LINES = "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS scope, CAST(l_quantity AS INTEGER) AS weight, l_orderkey AS batch FROM lineitem"


@query(
    "t12_upsert_edges",
    f"""WITH n AS ({_ORDERED_LINES}), o AS (SELECT src, dst, scope, min(weight) AS weight, -1 AS batch FROM n WHERE scope = 'N' GROUP BY 1, 2, 3),
    a AS (SELECT * FROM o UNION ALL SELECT * FROM n)
    SELECT src, dst, scope, first(weight ORDER BY batch DESC, weight DESC) AS weight, CASE WHEN min(batch) >= 0 THEN 'created' WHEN max(batch) < 0 THEN 'kept' ELSE 'updated' END AS action
    FROM a GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    n = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("scope"),
        F.col("l_quantity").cast("int").alias("weight"), F.col("l_orderkey").alias("batch"),
    )
    old = n.where("scope = 'N'").groupBy("src", "dst", "scope").agg(F.min("weight").alias("weight"))
    return linking.upsert_edges(old, n)


@query(
    "t13_insert_missing_edges",
    f"""WITH n AS ({_ORDERED_LINES}), o AS (SELECT src, dst, scope, max(weight) AS weight FROM n WHERE scope = 'N' GROUP BY 1, 2, 3)
    SELECT src, dst, scope, weight FROM o UNION ALL SELECT src, dst, scope, min(weight) FROM n WHERE (src, dst, scope) NOT IN (SELECT src, dst, scope FROM o) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    n = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("scope"), F.col("l_quantity").cast("int").alias("weight")
    )
    old = n.where("scope = 'N'").groupBy("src", "dst", "scope").agg(F.max("weight").alias("weight"))
    return linking.insert_missing_edges(old, n)


@query(
    "t09_internal_flag",
    f"{C} SELECT key, starts_with(key, 'brand-1') OR key IN (SELECT key FROM component WHERE size > 40) AS internal FROM component",
)
def _(spark, folder):
    n = components(spark, folder)
    return linking.mark_internal(n.select("key"), "key", "brand-1", n.where("size > 40"))


@query(
    "t21_latest_scan",
    "SELECT o_custkey AS project, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS scan FROM orders GROUP BY 1",
)
def _(spark, folder):
    scans = table(spark, folder, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("scan"))
    return linking.latest(scans, "project", "created").select("project", "scan")


# ---- sinks -----------------------------------------------------------------------------------------


@query("s01_table_scan", f"{C} SELECT id, key, name, status, internal FROM component")
def _(spark, folder):
    return components(spark, folder).select("id", "key", "name", "status", "internal")


@query("s20_json_report", f"""{C} SELECT to_json({{'type': type, 'components': count(*)}})::VARCHAR AS json FROM component GROUP BY type""")
def _(spark, folder):
    return tables.as_json(components(spark, folder).groupBy("type").agg(F.count("*").alias("components")))


@query("s20_json_files", f"{C} SELECT type, brand, count(*) AS components FROM component GROUP BY ALL")
def _(spark, folder):
    """The report written as JSON files, by the sink, and read back."""
    place = Scratch(spark, "json").base
    tables.write_json(components(spark, folder).groupBy("type", "brand").agg(F.count("*").alias("components")), place)
    return spark.read.schema("type string, brand string, components long").json(place)


@query(
    "s22_saved_metrics",
    f"WITH {NODE}, {PEAK_SQL}, {_deg('peak')} SELECT id, fan_in, fan_out FROM metric",
)
def _(spark, folder):
    """Written with the run row, replaced by a second run, and read back."""
    place = Scratch(spark, "saved").base
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder)).select("id", "fan_in", "fan_out")
    run = d.agg(F.count("*").alias("total_components"), F.lit("completed").alias("status"))
    tables.save_analysis(run, d, place)
    tables.save_analysis(run, tables.read_table(spark, f"{place}/node_metrics"), place)
    return tables.read_table(spark, f"{place}/node_metrics")


@query(
    "s23_saved_violations",
    f"{C}, {PEAK_SQL}, {_ASSIGN}, {_VIOLATION} SELECT src, dst, source_layer, target_layer, severity, 'run-1' AS run_id FROM violation",
)
def _(spark, folder):
    place = Scratch(spark, "saved").base
    found = layers.layer_violations(peak_edges(spark, folder), _assigned(components(spark, folder))).drop("reason")
    tables.save_violations(found, "run-1", place)
    return tables.read_table(spark, f"{place}/layer_violation")


