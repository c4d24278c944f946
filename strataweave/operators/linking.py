"""Ingest transforms: group hierarchies, matching, upserts and project links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import prefixes, scm_path, segment_title
from strataweave.skew import hot_keys, skew_join


def group_hierarchy(keys: DataFrame, column: str = "group_key", titles: bool = True) -> DataFrame:
    """(key, name, parent_key, depth) for every prefix of the dotted keys.

    Keys are made distinct before their prefixes are listed. ``titles`` turns the last segment
    into a display name, otherwise the raw segment is the name.
    """
    every = (
        keys.select(F.col(column).alias("k"))
        .where("k IS NOT NULL AND k <> ''")
        .distinct()
        .select(F.explode(prefixes(F.col("k"), ".")).alias("key"))
        .distinct()
    )
    parts = F.split("key", r"\.")
    segment = F.element_at(parts, -1)
    return every.select(
        "key",
        (segment_title(segment) if titles else segment).alias("name"),
        F.when(F.size(parts) > 1, F.regexp_extract("key", r"^(.*)\.", 1)).alias("parent_key"),
        (F.size(parts) - 1).alias("depth"),
    )


def group_paths(groups: DataFrame, max_depth: int = 50) -> DataFrame:
    """(key, ancestor, distance, full_path) of a tree given by parent links.

    Walks parent links level by level: the depth of the tree bounds the joins.
    """
    tree = groups.select("key", "name", "parent_key")
    step = tree.select("key", F.col("name").alias("full_path"), F.col("parent_key").alias("up"))
    out = None
    for distance in range(1, max_depth + 1):
        above = tree.select(F.col("key").alias("up"), F.col("name").alias("_n"), F.col("parent_key").alias("_p"))
        step = step.join(above, "up").select(
            "key", F.col("up").alias("ancestor"), F.concat_ws(" / ", "_n", "full_path").alias("full_path"), F.col("_p").alias("up")
        )
        part = step.select("key", "ancestor", F.lit(distance).alias("distance"), "full_path")
        if distance > 1 and part.isEmpty():
            return out
        out = part if out is None else out.unionByName(part)
    if not step.where("up IS NOT NULL").isEmpty():
        raise ValueError(f"group tree deeper than {max_depth}")
    return out


def mark_internal(rows: DataFrame, key: str, prefix: str | None, known: DataFrame | None = None) -> DataFrame:
    """Add ``internal``: the key starts with the prefix, or is among ``known(key)``."""
    by_prefix = F.startswith(F.col(key), F.lit(prefix)) if prefix else F.lit(False)
    if known is None:
        return rows.withColumn("internal", by_prefix)
    mark = known.select(F.col("key").alias(key)).distinct().withColumn("_k", F.lit(True))
    out = skew_join(rows, mark, key, "left", hot_left=hot_keys(rows, key))
    return out.withColumn("internal", by_prefix | F.coalesce("_k", F.lit(False))).drop("_k")


def match_existing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``matched_key`` and ``matched_by``: same coordinates first, else same name."""
    known = existing.where("group_id IS NOT NULL AND artifact_id IS NOT NULL")
    by_coordinate = known.groupBy("group_id", "artifact_id").agg(F.min("key").alias("_c"))
    by_name = existing.groupBy("name").agg(F.min("key").alias("_n"))
    whole = F.col("group_id").isNotNull() & F.col("artifact_id").isNotNull()
    kind = by_coordinate.schema["_c"].dataType
    out = rows.where(whole).join(by_coordinate, ["group_id", "artifact_id"], "left").unionByName(
        rows.where(~whole).withColumn("_c", F.lit(None).cast(kind))
    )
    out = skew_join(out, by_name, "name", "left", hot_left=hot_keys(rows, "name"))
    return out.withColumn("matched_key", F.coalesce("_c", "_n")).withColumn(
        "matched_by", F.when(F.col("_c").isNotNull(), "coordinate").when(F.col("_n").isNotNull(), "name")
    ).drop("_c", "_n")


def upsert_components(old: DataFrame, new: DataFrame) -> DataFrame:
    """All components after an import, with ``action`` created, updated or kept.

    ``key, name, version, internal, group_key`` on both sides. New values replace old ones
    unless they are empty; ``internal`` always follows the new row.
    """
    fields = ["name", "version", "internal", "group_key"]
    a = old.select("key", F.struct(*fields).alias("o"))
    b = new.select("key", F.struct(*fields).alias("n"))

    def pick(field: str) -> Column:
        fresh = F.col(f"n.{field}")
        if field != "internal":
            fresh = F.nullif(fresh, F.lit(""))
        return F.coalesce(fresh, F.col(f"o.{field}")).alias(field)

    return a.join(b, "key", "full_outer").select(
        "key",
        *[pick(f) for f in fields],
        F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "kept").otherwise("updated").alias("action"),
    )


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, scope, weight, action): the newest weight per edge wins.

    ``new`` may hold several batches in ``batch``; the highest batch is the newest.
    """
    cols = ["src", "dst", "scope", "weight"]
    rows = old.select(*cols, F.lit(-1).cast("long").alias("batch")).unionByName(
        new.select(*cols, F.col("batch").cast("long").alias("batch"))
    )
    return rows.groupBy("src", "dst", "scope").agg(
        F.max_by("weight", F.struct("batch", "weight")).alias("weight"),
        F.when(F.min("batch") >= 0, "created").when(F.max("batch") < 0, "kept").otherwise("updated").alias("action"),
    )


def insert_missing_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges, plus those new ones that are not there yet."""
    key = ["src", "dst", "scope"]
    cols = [*key, "weight"]
    fresh = new.groupBy(*key).agg(F.min("weight").alias("weight")).join(old.select(*key), key, "left_anti")
    return old.select(*cols).unionByName(fresh.select(*cols))


def external_targets(dependencies: DataFrame, known: DataFrame) -> DataFrame:
    """Component rows for dependency targets that no project provides."""
    targets = dependencies.groupBy(F.col("target_key").alias("key")).agg(
        F.min(F.struct("group_id", "artifact_id", "version")).alias("t")
    )
    return targets.join(known.select("key"), "key", "left_anti").select(
        "key", "t.group_id", "t.artifact_id", "t.version", F.col("t.artifact_id").alias("name"), F.lit(False).alias("internal")
    )


def latest(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The newest row of every key."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(when, *others))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def longest_prefix(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file, project): the project whose path is the longest prefix of the file's path.

    Files are dealt before their prefixes are listed, as one scan task may hold most of them, and only the depth of the
    longest prefix is aggregated: numbers fit a hash aggregate, while names would be sorted.
    """
    named = projects.groupBy("path").agg(F.max("project").alias("project"))
    steps = files.select("file").repartition("file").select("file", F.posexplode(prefixes(F.col("file"), "/")).alias("depth", "path"))
    hit = skew_join(steps, named.select("path"), "path", "left_semi", hot_left=hot_keys(steps, "path"))
    deepest = hit.groupBy("file").agg(F.max("depth").alias("depth"))
    deepest = deepest.select("file", F.expr("substring_index(file, '/', depth + 1)").alias("path"))
    return skew_join(deepest, named, "path", hot_left=hot_keys(deepest, "path")).select("file", "project")


def link_projects(poms: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, key, via): components linked to unlinked projects by file path, else by scm.

    ``poms(file, key, scm)``, ``projects(project, path, linked_key)``. The smallest key wins
    when several components point at one project.
    """
    by_path = longest_prefix(poms, projects).withColumnRenamed("project", "_p")
    by_scm = projects.select(F.col("path").alias("_scm"), F.col("project").alias("_s"))
    placed = poms.withColumn("_scm", scm_path(F.col("scm"))).join(by_path, "file", "left")
    linked = placed.where("_scm IS NOT NULL").join(by_scm, "_scm", "left")
    # poms without a link would all meet under one null key
    bare = placed.where("_scm IS NULL").withColumn("_s", F.lit(None).cast(by_scm.schema["_s"].dataType))
    picked = (
        linked.unionByName(bare)
        .select(
            F.coalesce("_p", "_s").alias("project"),
            "key",
            F.when(F.col("_p").isNotNull(), "path").when(F.col("_s").isNotNull(), "scm").alias("via"),
        )
        .where("project IS NOT NULL")
    )
    free = projects.where("linked_key IS NULL").select("project")
    return (
        picked.join(free, "project", "left_semi")
        .groupBy("project")
        .agg(F.min(F.struct("via", "key")).alias("b"))
        .select("project", "b.key", "b.via")
    )


def link_roots(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_path, key): root node whose artifact equals or contains the project's name.

    ``nodes(project_path, node_type, artifact_id, key, seq)`` come per project, so the match
    stays inside one project's rows; the first by ``seq`` wins.
    """
    name = F.element_at(F.split("project_path", "/"), -1)
    hit = nodes.where("node_type = 'project'").join(projects.select("project_path"), "project_path", "left_semi")
    hit = hit.where((F.col("artifact_id") == name) | F.contains("artifact_id", name))
    return hit.groupBy("project_path").agg(F.min_by("key", F.struct("seq", "key")).alias("key"))


def import_summary(actions: DataFrame) -> DataFrame:
    """One row: created, updated, kept."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "kept")])


def dry_run(projects: DataFrame, sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts, first projects by key) of an import that is only previewed."""
    counts = projects.agg(
        F.count("*").alias("projects"),
        F.count_if(F.size("modules") > 0).alias("multi_module"),
        F.count_if(F.col("scm").isNotNull()).alias("with_scm"),
    )
    return counts, projects.select("key", "name", "version").orderBy("key").limit(sample)
