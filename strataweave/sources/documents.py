"""Readers for inventory documents: SBOM JSON, POM XML, project listings, resolved graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.text import blank_to_null, parent_path, purl_base, purl_group, purl_parts, purl_pieces, purl_version
from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, skew_join

# ---- fixed values: document shapes --------------------------------------------------------

SBOM_SCHEMA = """
components array<struct<`bom-ref`: string, name: string, version: string, scope: string>>,
dependencies array<struct<ref: string, dependsOn: array<string>>>,
_corrupt string"""

POM_SCHEMA = """
groupId string, artifactId string, version string, name string, description string,
parent struct<groupId: string, artifactId: string, version: string>,
dependencies struct<dependency: array<struct<groupId: string, artifactId: string, version: string,
                                             scope: string, optional: string>>>,
modules struct<module: array<string>>,
scm struct<connection: string, developerConnection: string, url: string>,
_corrupt string"""

LISTING_SCHEMA = """
id long, name string, path string, path_with_namespace string, description string,
default_branch string, namespace map<string, string>, web_url string"""

GRAPH_KINDS = ["artifact", "project", "parent", "bom"]


def documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc, text): one row per file below ``path``."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def _once(docs: DataFrame, parsed: Column, name: str) -> DataFrame:
    """(doc, name) with the parse in a generator, so that later filters on its result do not
    repeat it: a filter is pushed below a projection together with a copy of the expression.
    """
    return docs.select("doc", F.explode(F.array(parsed)).alias(name))


# ---- SBOM ---------------------------------------------------------------------------------


def parsed_sboms(docs: DataFrame) -> DataFrame:
    """(doc, b) of ``(doc, text)``: what the JSON says, for :func:`split_sboms`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return _once(docs, F.from_json("text", SBOM_SCHEMA, options), "b")


def split_sboms(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of :func:`parsed_sboms`."""
    good = parsed.where("b IS NOT NULL AND b._corrupt IS NULL").select("doc", "b.components", "b.dependencies")
    bad = parsed.where("b IS NULL OR b._corrupt IS NOT NULL").select("doc", F.lit("unreadable document").alias("error"))
    return good, bad


def parse_sboms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of ``(doc, text)``; a document that is not JSON is a reject."""
    return split_sboms(parsed_sboms(docs))


def read_sboms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the JSON files below ``path``, which are opened and parsed once."""
    return split_sboms(Scratch(spark, "sboms").save(parsed_sboms(documents(spark, path, "*.json"))))


def sbom_packages(docs: DataFrame, internal_prefix: str | None = None) -> DataFrame:
    """One row per listed package with its coordinates; empty references are dropped."""
    item = docs.select("doc", F.posexplode("components").alias("pos", "c")).where(
        "coalesce(c.`bom-ref`, '') <> ''"
    )
    ref = F.col("c.bom-ref")
    base = item.select(
        "doc",
        "pos",
        ref.alias("bom_ref"),
        purl_base(ref).alias("purl_key"),
        F.coalesce(F.nullif(purl_version(ref), F.lit("")), F.col("c.version"), F.lit("")).alias("version"),
        F.col("c.scope").alias("scope"),
    )
    # a column of its own, so that a package URL is cut once and not for every part that is taken from it
    base = base.withColumn("_pieces", purl_pieces(F.col("purl_key")))
    pieces = F.col("_pieces")
    parts, group = purl_parts(F.col("purl_key"), pieces), purl_group(F.col("purl_key"), internal_prefix, pieces)
    internal = F.lit(False)
    if internal_prefix:
        head = internal_prefix.rsplit("@", 1)[0]
        internal = F.startswith(F.col("purl_key"), F.lit(head))
    return base.select(
        *[c for c in base.columns if c != "_pieces"],
        parts["namespace"].alias("maven_group_id"),
        parts["artifact"].alias("artifact_id"),
        group["full_name"].alias("name"),
        F.when(internal, group["group_key"]).alias("group_key"),
        internal.alias("internal"),
    )


def sbom_components(packages: DataFrame) -> DataFrame:
    """One component per version-less package, the first seen (by document, then position).

    A hash aggregate with map-side combine, so a package listed by every document is cheap.
    """
    fields = ["version", "maven_group_id", "artifact_id", "name", "group_key", "internal"]
    first = F.min_by(F.struct(*fields), F.struct("doc", "pos"))
    return packages.groupBy("purl_key").agg(first.alias("f")).select(
        "purl_key", "f.*", package_key(F.col("purl_key")).alias("key")
    )


def package_key(purl: Column) -> Column:
    """Component key of a version-less package URL: ``group:artifact``, else its name."""
    parts = purl_parts(purl)
    return coordinate_key(parts["namespace"], parts["artifact"], purl)


def coordinate_key(namespace: Column, artifact: Column, purl: Column) -> Column:
    """:func:`package_key` of a package URL whose parts are known."""
    return F.when(namespace.isNotNull(), F.concat_ws(":", namespace, artifact)).otherwise(F.coalesce(artifact, purl))


def package_pairs(docs: DataFrame) -> DataFrame:
    """(src, dst): distinct version-less package pairs that the documents list as dependencies."""
    return (
        docs.select(F.explode("dependencies").alias("d"))
        .select(F.col("d.ref").alias("ref"), F.explode("d.dependsOn").alias("on"))
        .select(purl_base(F.col("ref")).alias("src"), purl_base(F.col("on")).alias("dst"))
        .distinct()
    )


def sbom_edges(docs: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, scope, weight) between known packages, versions stripped, once per pair."""
    pairs = package_pairs(docs)
    known = components.select("purl_key")
    out = skew_join(pairs, known.withColumnRenamed("purl_key", "src"), "src", "left_semi", hot_left=hot_keys(pairs, "src"))
    out = skew_join(out, known.withColumnRenamed("purl_key", "dst"), "dst", "left_semi", hot_left=hot_keys(pairs, "dst"))
    return out.select("src", "dst", F.lit("compile").alias("scope"), F.lit(1).alias("weight"))


def package_links(docs: DataFrame, owner: str = "doc") -> DataFrame:
    """(src, dst, scope): a document's packages as its direct or transitive dependencies."""
    item = docs.select(F.col(owner).alias("src"), F.explode("components").alias("c"))
    optional = F.col("c.scope").eqNullSafe(F.lit("optional"))
    return (
        item.where("coalesce(c.`bom-ref`, '') <> ''")
        .select(
            "src",
            purl_base(F.col("c.bom-ref")).alias("dst"),
            F.when(optional, "transitive").otherwise("direct").alias("scope"),
        )
        .distinct()
    )


# ---- POM ----------------------------------------------------------------------------------


def parse_poms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, rejects) of ``(doc, text)``.

    The group falls back to the parent's, the name to the artifact id. A document without a
    coordinate, or that is not XML, is a reject.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "project"}
    p = _once(docs, F.from_xml("text", POM_SCHEMA, options), "p")
    group = F.coalesce(blank_to_null(F.col("p.groupId")), blank_to_null(F.col("p.parent.groupId")))
    artifact = blank_to_null(F.col("p.artifactId"))
    rows = p.select(
        "doc",
        group.alias("group_id"),
        artifact.alias("artifact_id"),
        blank_to_null(F.col("p.version")).alias("version"),
        F.coalesce(blank_to_null(F.col("p.name")), artifact).alias("name"),
        blank_to_null(F.col("p.description")).alias("description"),
        F.col("p.dependencies.dependency").alias("dependency"),
        F.coalesce(F.col("p.modules.module"), F.array().cast("array<string>")).alias("modules"),
        F.coalesce(
            blank_to_null(F.col("p.scm.connection")),
            blank_to_null(F.col("p.scm.developerConnection")),
            blank_to_null(F.col("p.scm.url")),
        ).alias("scm"),
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "unreadable document")
        .when(artifact.isNull(), "no artifactId")
        .when(group.isNull(), "no groupId")
        .alias("error"),
    )
    good = rows.where("error IS NULL").drop("error").withColumn("key", F.concat_ws(":", "group_id", "artifact_id"))
    return good, rows.where("error IS NOT NULL").select("doc", "error")


def read_poms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_poms(documents(spark, path, "pom.xml"))


def pom_dependencies(projects: DataFrame) -> DataFrame:
    """(key, target_key, group_id, artifact_id, version, scope): no test scope, compile by default."""
    d = projects.select("key", F.explode("dependency").alias("d")).select(
        "key",
        blank_to_null(F.col("d.groupId")).alias("group_id"),
        blank_to_null(F.col("d.artifactId")).alias("artifact_id"),
        blank_to_null(F.col("d.version")).alias("version"),
        F.coalesce(blank_to_null(F.col("d.scope")), F.lit("compile")).alias("scope"),
    )
    return d.where("group_id IS NOT NULL AND artifact_id IS NOT NULL AND scope <> 'test'").select(
        "key", F.concat_ws(":", "group_id", "artifact_id").alias("target_key"), "group_id", "artifact_id", "version", "scope"
    )


def module_tree(modules: DataFrame) -> DataFrame:
    """(root, path, depth): module paths below each root document.

    ``modules(path, module)`` lists the modules of the project at a path. Every step lengthens the
    path and only listed paths have modules, so a module that names itself ends.
    """
    scratch = Scratch(modules.sparkSession, "modules")
    modules = scratch.save(modules.select("path", "module").distinct())
    children = modules.select(F.concat_ws("/", "path", "module").alias("path")).distinct()
    roots = modules.select("path").distinct().join(children, "path", "left_anti")
    level = scratch.save(roots.select(F.col("path").alias("root"), "path", F.lit(0).alias("depth")))
    out, depth = level, 0
    while True:
        depth += 1
        level = scratch.save(
            level.join(modules, "path")
            .select("root", F.concat_ws("/", "path", "module").alias("path"), F.lit(depth).alias("depth"))
            .distinct()
        )
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def cached_projects(docs: DataFrame, root: str) -> DataFrame:
    """(path): project paths of cached POM files below ``root``."""
    tail = F.regexp_replace("doc", rf"^.*?{root.strip('/')}/", "")
    return docs.select(F.regexp_replace(tail, r"/?pom\.xml$", "").alias("path")).where("path <> ''").distinct()


# ---- listings and line formats --------------------------------------------------------------


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Project listing JSON with the documented defaults."""
    return with_listing_defaults(spark.read.schema(LISTING_SCHEMA).option("multiLine", True).json(path))


def with_listing_defaults(rows: DataFrame) -> DataFrame:
    empty = F.lit("")
    return rows.select(
        "id",
        F.coalesce("name", empty).alias("name"),
        F.coalesce("path", empty).alias("path"),
        F.coalesce("path_with_namespace", empty).alias("path_with_namespace"),
        F.coalesce("description", empty).alias("description"),
        F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
        "namespace",
        F.coalesce("web_url", empty).alias("web_url"),
    )


def unique_projects(rows: DataFrame) -> DataFrame:
    """A project seen through several groups counts once (its first path)."""
    others = [c for c in rows.columns if c != "id"]
    order = F.struct(*[F.col(c) for c in others if c != "namespace"])
    return rows.groupBy("id").agg(F.min_by(F.struct(*others), order).alias("r")).select("id", "r.*")


def line_edges(lists: DataFrame) -> DataFrame:
    """(src, dst) from ``(src, value)`` with one ``group:name`` dependency per line."""
    lines = lists.select("src", F.explode(F.split(F.trim("value"), r"\r?\n")).alias("dst"))
    return lines.select("src", F.trim("dst").alias("dst")).where(F.contains("dst", F.lit(":")))


def not_cached(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose result is not in the cache listing yet."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


# ---- resolved dependency graph ----------------------------------------------------------------


def graph_nodes(nodes: DataFrame, internal_prefix: str | None = None) -> DataFrame:
    """(node_id, key, group_id, artifact_id, version, internal) of ``(id, node_type)``.

    Ids read ``kind:group:artifact:version``; other kinds and shorter ids are dropped.
    """
    parts = F.split("id", ":")
    internal = F.startswith(F.get(parts, F.lit(1)), F.lit(internal_prefix)) if internal_prefix else F.lit(False)
    return nodes.where(F.col("node_type").isin(GRAPH_KINDS) & (F.size(parts) >= 4)).select(
        F.col("id").alias("node_id"),
        "node_type",
        F.concat_ws(":", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).alias("key"),
        F.get(parts, F.lit(1)).alias("group_id"),
        F.get(parts, F.lit(2)).alias("artifact_id"),
        F.array_join(F.slice(parts, F.lit(4), F.size(parts)), ":").alias("version"),
        internal.alias("internal"),
    )


def graph_components(parsed: DataFrame) -> DataFrame:
    """One row per ``group:artifact``, the first node id."""
    fields = F.struct("group_id", "artifact_id", "version", "internal")
    return parsed.groupBy("key").agg(F.min_by(fields, "node_id").alias("f")).select("key", "f.*")


def graph_edges(edges: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst, scope, weight) of ``(from_node, to_node, scope)`` between known components."""
    at = lambda side, out: parsed.select(F.col("node_id").alias(side), F.col("key").alias(out)).distinct()
    e = skew_join(edges, at("from_node", "src"), "from_node", hot_left=hot_keys(edges, "from_node"))
    e = skew_join(e, at("to_node", "dst"), "to_node", hot_left=hot_keys(edges, "to_node"))
    scope = F.coalesce(blank_to_null(F.col("scope")), F.lit("compile"))
    return e.where("src <> dst").select("src", "dst", scope.alias("scope"), F.lit(1).alias("weight")).distinct()


def parent_directory(c: Column) -> Column:
    return parent_path(c, "/")
