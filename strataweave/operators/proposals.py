"""Scored improvement proposals: cycles to break, interfaces to stabilise, boundaries to redraw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import first_true
from strataweave.operators.adjacency import at_or_above_percentile
from strataweave.operators.communities import community_edges
from strataweave.operators.cycles import scc_ranking
from strataweave.scratch import Scratch
from strataweave.skew import hot_keys, number_rows, skew_join

# ---- fixed values: kinds, states, suffixes and the rule-based texts -------------------------

TYPES = ["cycle_break", "service_extraction", "api_stabilization", "boundary_redefinition"]
PREFIXES = {"cycle_break": "CYC", "api_stabilization": "API", "boundary_redefinition": "BND"}
STATES = ["pending", "accepted", "rejected", "completed"]
CONCEPT_SUFFIXES = ["-service", "-api", "-core", "-common", "-shared"]
CYCLE_STEPS = [
    "Identify the primary direction of data flow",
    "Extract shared domain models to a common module",
    "Introduce interfaces/abstractions at cycle boundaries",
    "Invert dependencies to break the cycle",
    "Remove redundant direct dependencies",
]
CYCLE_GAIN = "Breaking this cycle will improve modularity and make services independently deployable."
API_STEPS = [
    "Define versioned API interfaces",
    "Create adapter layer for internal changes",
    "Migrate consumers to stable interfaces",
    "Deprecate volatile endpoints with clear timeline",
]
API_GAIN = "Stable API contracts will reduce breaking changes for downstream consumers."
BOUNDARY_STEPS = [
    "Identify natural domain boundaries based on naming",
    "Move cross-cutting services to shared infrastructure",
    "Update dependency directions to follow domain boundaries",
]
BOUNDARY_GAIN = "Clearer boundaries will improve team ownership and reduce cross-domain coupling."
CYCLE_PREVIEW, API_SCOPE, BOUNDARY_SCOPE = 5, 5, 10
MIN_FAN_IN, MIN_COMMUNITY = 3, 3


def impact(services: Column, mean_coupling: Column) -> Column:
    return (
        F.when((services >= 5) | (mean_coupling >= 10), "high")
        .when((services >= 3) | (mean_coupling >= 5), "medium")
        .otherwise("low")
    )


def risk(kind: Column, services: Column) -> Column:
    return (
        F.when(kind == "cycle_break", F.when(services <= 3, "medium").otherwise("high"))
        .when(kind == "service_extraction", "high")
        .when(kind == "api_stabilization", F.when(services <= 5, "low").otherwise("medium"))
        .otherwise("medium")
    )


def _first_members(rows: DataFrame, group: str, count: int, order: str = "key") -> DataFrame:
    """The first ``count`` keys per group; Spark keeps only those while sorting."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = rows.withColumn("_r", rank).where(F.col("_r") <= count)
    return few.groupBy(group).agg(F.sort_array(F.collect_list(order)).alias("members"))


def concepts(members: DataFrame, group: str) -> DataFrame:
    """(group, concept): name prefixes before ``:`` and known suffixes met among the members."""
    prefix = F.when(F.contains("key", F.lit(":")), F.substring_index("key", ":", 1))
    endings = [F.when(F.endswith("key", F.lit(s)), F.lit(s.strip("-"))) for s in CONCEPT_SUFFIXES]
    return (
        members.select(group, F.explode(F.array_compact(F.array(prefix, *endings))).alias("concept")).distinct()
    )


def cycle_breaks(
    nodes: DataFrame, edges: DataFrame, components: DataFrame, degrees: DataFrame, min_size: int = 2
) -> DataFrame:
    """One candidate per cyclic component, with its inner edges and a preview of its members."""
    sizes = scc_ranking(edges, components, min_size)
    inner = components.where(F.col("scc_size") >= min_size).select("id", "scc_id")
    named = inner.join(nodes.select("id", "key"), "id")
    coupled = inner.join(degrees.select("id", "coupling_score"), "id").groupBy("scc_id").agg(
        F.avg("coupling_score").alias("mean_coupling")
    )
    preview = _first_members(named, "scc_id", CYCLE_PREVIEW)
    rows = sizes.join(coupled, "scc_id").join(preview, "scc_id")
    chain = F.array_join("members", " -> ")
    more = F.when(F.col("size") > CYCLE_PREVIEW, F.format_string(" -> ... (%d total)", "size")).otherwise("")
    return rows.select(
        F.lit("cycle_break").alias("proposal_type"),
        F.col("scc_id").cast("string").alias("subject"),
        "size",
        "mean_coupling",
        F.format_string("Break cyclic dependency involving %d services", "size").alias("summary"),
        F.concat(F.lit("Cyclic dependency detected: "), chain, more).alias("root_cause"),
        F.array(*[F.lit(s) for s in CYCLE_STEPS]).alias("steps"),
        F.lit(CYCLE_GAIN).alias("expected_improvement"),
        F.col("size").alias("scc_size_before"),
        F.lit(None).cast("long").alias("fan_in_before"),
        F.lit(None).cast("long").alias("fan_out_before"),
    )


def api_stabilisations(nodes: DataFrame, degrees: DataFrame, percentile: float = 90) -> DataFrame:
    """One candidate per highly coupled component with at least three dependents."""
    high = at_or_above_percentile(degrees, "coupling_score", percentile).where(F.col("fan_in") >= MIN_FAN_IN)
    rows = high.join(nodes.select("id", "key"), "id")
    lead = F.format_string("Identify stable vs volatile API contracts for %s", "key")
    return rows.select(
        F.lit("api_stabilization").alias("proposal_type"),
        F.col("key").alias("subject"),
        (F.col("fan_in") + 1).alias("size"),
        F.col("coupling_score").alias("mean_coupling"),
        F.format_string("Stabilize API for %s (%d consumers)", "key", "fan_in").alias("summary"),
        F.lit("").alias("root_cause"),
        F.array(lead, *[F.lit(s) for s in API_STEPS]).alias("steps"),
        F.lit(API_GAIN).alias("expected_improvement"),
        F.lit(None).cast("long").alias("scc_size_before"),
        F.col("fan_in").alias("fan_in_before"),
        F.col("fan_out").alias("fan_out_before"),
    )


def boundary_changes(nodes: DataFrame, edges: DataFrame, labels: DataFrame, degrees: DataFrame) -> DataFrame:
    """One candidate per community of three or more that mixes name prefixes."""
    named = labels.join(nodes.select("id", "key"), "id").join(degrees.select("id", "coupling_score"), "id")
    prefix = F.when(F.contains("key", F.lit(":")), F.substring_index("key", ":", 1))
    mixed = (
        named.groupBy("community")
        .agg(
            F.count("*").alias("size"),
            F.avg("coupling_score").alias("mean_coupling"),
            F.sort_array(F.collect_set(prefix)).alias("prefixes"),
        )
        .where((F.col("size") >= MIN_COMMUNITY) & (F.size("prefixes") > 1))
    )
    rows = mixed.join(community_edges(edges, labels), "community", "left")
    listed = F.array_join("prefixes", ", ")
    steps = F.array(
        F.lit(BOUNDARY_STEPS[0]),
        F.concat(F.lit("Separate services by domain: "), listed),
        *[F.lit(s) for s in BOUNDARY_STEPS[1:]],
    )
    return rows.select(
        F.lit("boundary_redefinition").alias("proposal_type"),
        F.col("community").cast("string").alias("subject"),
        "size",
        "mean_coupling",
        F.format_string("Redefine boundaries for %d services across %d domains", F.col("size"), F.size("prefixes")).alias("summary"),
        F.concat(
            F.lit("Mixed domain prefixes in cluster: "),
            listed,
            F.lit("\nServices with different responsibilities grouped together"),
        ).alias("root_cause"),
        steps.alias("steps"),
        F.lit(BOUNDARY_GAIN).alias("expected_improvement"),
        F.lit(None).cast("long").alias("scc_size_before"),
        F.lit(None).cast("long").alias("fan_in_before"),
        F.lit(None).cast("long").alias("fan_out_before"),
    )


def valid(candidates: DataFrame) -> DataFrame:
    """Candidates with a summary, steps, and a cause where the kind needs one."""
    needs_cause = F.col("proposal_type").isin("cycle_break", "boundary_redefinition")
    return candidates.where(
        (F.col("summary") != "") & (F.size("steps") > 0) & (~needs_cause | (F.col("root_cause") != ""))
    )


def backlog(candidates: list[DataFrame], already: int = 0) -> DataFrame:
    """Valid candidates scored and numbered: kinds in order, larger first, then by subject."""
    rows = candidates[0]
    for more in candidates[1:]:
        rows = rows.unionByName(more)
    kind = first_true([(F.col("proposal_type") == t, F.lit(i)) for i, t in enumerate(PREFIXES)])
    scored = valid(rows).select(
        "*",
        impact(F.col("size"), F.col("mean_coupling")).alias("impact"),
        risk(F.col("proposal_type"), F.col("size")).alias("risk"),
        kind.alias("_kind"),
        (-F.col("size")).alias("_down"),
    )
    numbered = number_rows(scored, ["_kind", "_down", "subject"], "_n")
    prefix = first_true([(F.col("proposal_type") == t, F.lit(p)) for t, p in PREFIXES.items()])
    serial = (F.col("_n") + 1 + already).cast("string")
    serial = F.when(F.length(serial) < 3, F.lpad(serial, 3, "0")).otherwise(serial)
    return numbered.withColumn("proposal_id", F.concat_ws("-", prefix, serial)).drop("_kind", "_down", "_n")


def run_backlog(
    nodes: DataFrame, edges: DataFrame, components: DataFrame, labels: DataFrame, degrees: DataFrame,
    min_size: int = 2, percentile: float = 90, already: int = 0, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The row of one analysis run, and the proposals it saves: none in a dry run, which counts them all the same."""
    found = [
        cycle_breaks(nodes, edges, components, degrees, min_size),
        api_stabilisations(nodes, degrees, percentile),
        boundary_changes(nodes, edges, labels, degrees),
    ]
    listed = Scratch(edges.sparkSession, "backlog").save(backlog(found, already))
    # a component is one row of its members' ids, so distinct ids count components
    cyclic = components.where(F.col("scc_size") >= min_size).agg(F.countDistinct("scc_id").alias("total_sccs"))
    run = (
        nodes.agg(F.count("*").alias("total_projects"))
        .join(cyclic).join(labels.agg(F.countDistinct("community").alias("total_clusters")))  # one row each
        .join(listed.agg(F.count("*").alias("proposals_generated")))
        .select("*", F.lit("completed").alias("status"), F.lit(dry_run).alias("dry_run"))
    )
    return run, listed.limit(0) if dry_run else listed


def steps(candidates: DataFrame) -> DataFrame:
    """(proposal_type, subject, step, text, expected_improvement): one row per step, numbered from 1."""
    rows = candidates.select("proposal_type", "subject", F.posexplode("steps").alias("at", "text"), "expected_improvement")
    return rows.select("proposal_type", "subject", (F.col("at") + 1).alias("step"), "text", "expected_improvement")


def proposal_scope(
    proposals: DataFrame, nodes: DataFrame, edges: DataFrame, components: DataFrame, labels: DataFrame
) -> DataFrame:
    """(proposal_id, key): the components each proposal is about, one per row.

    All members of a cycle; a component and its first five dependents; the first ten members of
    a community.
    """
    ids = proposals.select("proposal_id", "proposal_type", "subject")
    keyed = nodes.select("id", "key")

    def of(kind: str) -> DataFrame:
        return ids.where(F.col("proposal_type") == kind).select("proposal_id", "subject")

    cyc = components.select("id", F.col("scc_id").cast("string").alias("subject"))
    cyc = cyc.join(of("cycle_break"), "subject").join(keyed, "id").select("proposal_id", "key")
    e = edges.select("src", "dst").distinct()
    hub = keyed.join(of("api_stabilization"), F.col("key") == F.col("subject")).select(
        F.col("id").alias("dst"), "proposal_id"
    )
    users = skew_join(e, hub, "dst", hot_left=hot_keys(e, "dst")).join(keyed.withColumnRenamed("id", "src"), "src")
    users = _first_members(users, "proposal_id", API_SCOPE).select("proposal_id", F.explode("members").alias("key"))
    own = of("api_stabilization").select("proposal_id", F.col("subject").alias("key"))
    com = labels.select("id", F.col("community").cast("string").alias("subject"))
    com = com.join(of("boundary_redefinition"), "subject").join(keyed, "id")
    com = _first_members(com, "proposal_id", BOUNDARY_SCOPE).select("proposal_id", F.explode("members").alias("key"))
    return cyc.unionByName(own).unionByName(users).unionByName(com)


def filter_backlog(proposals: DataFrame, limit: int = 50, **wanted: str) -> DataFrame:
    """Proposals matching type, impact, risk and status; newest first."""
    out = proposals
    for column, value in wanted.items():
        if value:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), "proposal_id").limit(limit)


def type_counts(proposals: DataFrame) -> DataFrame:
    """(proposal_type, proposals) for every known type."""
    every = proposals.sparkSession.createDataFrame([(t,) for t in TYPES], "proposal_type string")
    n = proposals.groupBy("proposal_type").agg(F.count("*").alias("n"))
    return every.join(n, "proposal_type", "left").select("proposal_type", F.coalesce("n", F.lit(0)).alias("proposals"))


def set_status(proposals: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposals with the state of ``changes(proposal_id, status)``; unknown states are ignored."""
    ok = changes.where(F.col("status").isin(STATES)).groupBy("proposal_id").agg(F.max("status").alias("_s"))
    return proposals.join(ok, "proposal_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def cycles_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two component tables: cyclic components, nodes in them, the largest one."""
    def totals(components: DataFrame) -> DataFrame:
        size = F.when(F.col("scc_size") > 1, F.col("scc_size"))
        return components.agg(
            F.countDistinct(F.when(F.col("scc_size") > 1, F.col("scc_id"))).alias("cyclic_sccs"),
            F.count(size).alias("cyclic_nodes"), F.coalesce(F.max(size), F.lit(0)).alias("largest_scc"),
        )

    names = ["cyclic_sccs", "cyclic_nodes", "largest_scc"]
    long = lambda df, name: totals(df).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias(name)) for n in names]))
    )
    both = long(before, "before").join(long(after, "after"), "metric")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def before_after(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, metric, before, after, delta) of two metric tables, one row per changed value."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return df.select("id", F.inline(pairs))

    joined = long(before, "before").join(long(after, "after"), ["id", "metric"], "full_outer")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("delta", F.col("after") - F.col("before"))
