"""Grouping reports: paths, domains, names, activity, domain anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import any_of, first_true, parent_path, prefixes
from strataweave.operators.spread import spread
from strataweave.skew import hot_keys, skew_join

# ---- fixed values -------------------------------------------------------------------------

NAME_SUFFIXES = [
    "-service", "-api", "-worker", "-lib", "-library",
    "-gateway", "-proxy", "-client", "-common", "-core",
    "-utils", "-tools", "-config", "-admin", "-web",
    "-batch", "-scheduler", "-connector", "-adapter",
]
ANCHOR_PATTERNS = [
    "-domain$", "-parent$", "-bom$", "-common$", "-core$",
    "-base$", "-shared$", "-platform$", "-framework$",
    "^common-", "^shared-", "^platform-", "^core-",
]
INFRASTRUCTURE_PATTERNS = [
    "^kafka", "^redis", "^mongo", "^postgres", "^mysql",
    "^elastic", "^rabbit", "logging", "monitoring", "tracing",
    "gateway", "config.*server", "discovery", "eureka", "consul",
    "^cache", "metrics", "zipkin", "jaeger", "prometheus",
    "^auth[-_]service$", "^identity[-_]", "^sso[-_]", "^oauth[-_]",
]
DOMAIN_SUFFIXES = [
    "-domain", "-parent", "-bom", "-common", "-core",
    "-base", "-shared", "-platform", "-framework",
]
DOMAIN_PREFIXES = ["common-", "shared-", "platform-", "core-"]
TOP_DOMAINS, TOP_PATTERNS, TOP_HUBS = 20, 15, 20
ANCHOR_HOPS = 3  # nodes up to here are expanded, so an anchor may be one hop further

# ---- structure ----------------------------------------------------------------------------


def summary(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of totals; ends are counted without listing every component's edges."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    linked = nodes.join(ends.distinct().withColumn("_l", F.lit(True)), "id", "left").agg(
        F.count("*").alias("total_components"), F.count_if("_l").alias("with_dependencies")
    )
    return linked.select(
        "total_components",
        "with_dependencies",
        (F.col("total_components") - F.col("with_dependencies")).alias("orphans"),
        edges.agg(F.count("*")).scalar().alias("total_dependencies"),
        groups.agg(F.count("*")).scalar().alias("node_groups"),
    )


def path_groups(projects: DataFrame) -> DataFrame:
    """(group_path, projects): projects per direct parent path; null for ungrouped ones."""
    return projects.groupBy(parent_path(F.col("path"), "/").alias("group_path")).agg(F.count("*").alias("projects"))


def path_rollup(projects: DataFrame) -> DataFrame:
    """(prefix, projects) for every prefix of the parent paths, counted once per path first."""
    return (
        path_groups(projects)
        .where("group_path IS NOT NULL")
        .select(F.explode(prefixes(F.col("group_path"), "/")).alias("prefix"), "projects")
        .groupBy("prefix")
        .agg(F.sum("projects").alias("projects"))
    )


def domain_of(group_id: Column) -> Column:
    return F.array_join(F.slice(F.split(group_id, r"\."), 1, 3), ".")


def domain_counts(nodes: DataFrame) -> DataFrame:
    named = nodes.where("coalesce(group_id, '') <> ''")
    return named.groupBy(domain_of(F.col("group_id")).alias("domain")).agg(F.count("*").alias("components"))


def domain_report(nodes: DataFrame, top: int = TOP_DOMAINS) -> DataFrame:
    """(domain, components, total, unique_domains) of the largest domains."""
    counts = domain_counts(nodes)
    totals = counts.agg(F.struct(F.sum("components").alias("total"), F.count("*").alias("unique_domains"))).scalar()
    best = counts.orderBy(F.desc("components"), "domain").limit(top)
    return best.withColumn("_t", totals).select("domain", "components", "_t.total", "_t.unique_domains")


def naming_report(nodes: DataFrame, top: int = TOP_PATTERNS) -> DataFrame:
    """(kind, value, components): commonest name suffixes and first words."""
    low = F.lower("name")
    suffix = first_true([(F.endswith(low, F.lit(s)), F.lit(s)) for s in NAME_SUFFIXES])
    head = F.substring_index(low, "-", 1)
    prefix = F.when(F.contains(low, F.lit("-")) & (F.length(head) > 2), head)

    def best(kind: str, value: Column) -> DataFrame:
        counts = nodes.select(value.alias("value")).where("value IS NOT NULL").groupBy("value")
        counted = counts.agg(F.count("*").alias("components"))
        return counted.orderBy(F.desc("components"), "value").limit(top).select(F.lit(kind).alias("kind"), "value", "components")

    return best("suffix", suffix).unionByName(best("prefix", prefix))


def activity_bucket(seen: Column, as_of: Column) -> Column:
    days = lambda n: as_of - F.make_dt_interval(F.lit(n))
    return (
        F.when(seen.isNull(), "never_synced")
        .when(seen > days(30), "active_30d")
        .when(seen > days(90), "stale_30_90d")
        .otherwise("dormant_90d_plus")
    )


def activity_report(nodes: DataFrame, seen: str, as_of: str) -> DataFrame:
    """One row of counts per activity bucket relative to ``as_of``."""
    bucket = activity_bucket(F.col(seen), F.to_timestamp(F.lit(as_of)))
    names = ["active_30d", "stale_30_90d", "dormant_90d_plus", "never_synced"]
    return nodes.select(bucket.alias("b")).agg(*[F.count_if(F.col("b") == n).alias(n) for n in names])


def top_hubs(nodes: DataFrame, degrees: DataFrame, top: int = TOP_HUBS) -> DataFrame:
    """(id, name, fan_in, fan_out, hub_score) of the highest hub scores.

    The top rows are taken before names are joined.
    """
    best = degrees.select("id", "fan_in", "fan_out", "hub_score").orderBy(F.desc("hub_score"), "id").limit(top)
    return F.broadcast(best).join(nodes.select("id", "name"), "id").select(
        "id", "name", "fan_in", "fan_out", "hub_score"
    )


# ---- anchors ------------------------------------------------------------------------------


def domain_name(name: Column) -> Column:
    """Domain a component's name speaks of: without a known suffix or prefix, else its first word."""
    low = F.lower(name)
    cut_end = [
        (F.endswith(low, F.lit(s)), low.substr(F.lit(1), F.length(low) - len(s))) for s in DOMAIN_SUFFIXES
    ]
    cut_start = [
        (F.startswith(low, F.lit(p)), low.substr(F.lit(len(p) + 1), F.length(low))) for p in DOMAIN_PREFIXES
    ]
    return first_true([*cut_end, *cut_start], F.substring_index(low, "-", 1))


def _plain(name: Column) -> Column:
    return F.translate(F.lower(name), " _", "--")


def domain_anchors(nodes: DataFrame, edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Components classed as domain anchors or shared infrastructure (``kind``), with the evidence.

    Name coherence is the share of dependents whose name contains the anchor's domain word; it
    is one join of the edges with both names and one aggregate.
    """
    named = nodes.select("id", "name", _plain(F.col("name")).alias("plain"), domain_name(F.col("name")).alias("domain"))
    word = F.when(F.contains("domain", F.lit("-")), F.substring_index("domain", "-", 1)).otherwise(
        F.substring("domain", 1, 4)
    )
    e = edges.select("src", "dst").distinct()
    targets = named.select(F.col("id").alias("dst"), word.alias("word"))
    sources = named.select(F.col("id").alias("src"), F.col("plain").alias("dependent"))
    pairs = skew_join(e, targets, "dst", hot_left=hot_keys(e, "dst"))
    pairs = skew_join(pairs, sources, "src", hot_left=hot_keys(e, "src"))
    coherence = pairs.groupBy(F.col("dst").alias("id")).agg(
        F.count_if((F.col("word") != "") & F.contains("dependent", F.col("word"))).alias("hits"),
        F.count("*").alias("dependents"),
    )
    n = F.col("fan_in")
    rows = (
        named.join(degrees.select("id", "fan_in", "fan_out"), "id")
        .join(coherence, "id", "left")
        .withColumn("ratio", F.when(n > 0, n / (F.col("fan_out") + 1)).otherwise(0.0))
        .withColumn(
            "coherent",
            F.when((F.col("domain") != "") & (F.col("dependents") > 0), F.col("hits") / F.col("dependents")).otherwise(0.0),
        )
        .withColumn("name_match", any_of([F.col("plain").rlike(p) for p in ANCHOR_PATTERNS]))
        .withColumn("infra", any_of([F.col("plain").rlike(p) for p in INFRASTRUCTURE_PATTERNS]))
    )
    anchor = (
        (F.col("name_match") & (n >= 2) & ~F.col("infra"))
        | ((F.col("coherent") >= 0.3) & (n >= 3))
        | ((F.col("ratio") >= 5) & (n >= 5) & ~F.col("infra") & (F.col("coherent") >= 0.2))
    )
    shared = F.col("infra") & (F.col("ratio") >= 3) & (n >= 5)
    return rows.select(
        "id",
        F.when(anchor, "domain_anchor").when(shared, "infrastructure").alias("kind"),
        "domain",
        n.alias("in_degree"),
        F.col("fan_out").alias("out_degree"),
        F.bround("ratio", 2).alias("anchor_ratio"),
        F.bround("coherent", 2).alias("name_coherence"),
        "name_match",
    ).where("kind IS NOT NULL")


def cluster_by_anchors(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, anchor_id, is_anchor): every component with the anchor it depends on, null if none.

    Anchors send (in-degree, id) up the dependency edges; passing another anchor ends the walk.
    Only the best anchor met so far travels on, so there is one value per node.
    """
    own = anchors.select("id", "in_degree")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct()
    # walks run through non-anchors only: edges that enter an anchor are not followed
    open_up = up.join(own.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    rank = F.struct((-F.col("in_degree")).alias("d"), F.col("id").alias("i"))
    reach = spread(own.select("id", rank.alias("value")), open_up, "min", max_rounds=ANCHOR_HOPS + 1)
    best = reach.join(own.select("id"), "id", "left_anti").select("id", F.col("value.i").alias("anchor_id"))
    mine = own.select("id", F.lit(True).alias("is_anchor"))
    return (
        nodes.select("id")
        .join(mine, "id", "left")
        .join(best, "id", "left")
        .select(
            "id",
            F.when(F.col("is_anchor"), F.col("id")).otherwise(F.col("anchor_id")).alias("anchor_id"),
            F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"),
        )
    )


def label_samples(labels: DataFrame, nodes: DataFrame, label: str, sample: int = 5) -> DataFrame:
    """(label, size, members, more): the smallest ``sample`` member names and how many follow.

    Keeps only ``sample`` rows per label before they are collected, numbered by a window that
    Spark limits per group while sorting.
    """
    from pyspark.sql import Window

    named = labels.join(nodes.select("id", "name"), "id")
    size = named.groupBy(label).agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("name", "id"))
    few = named.withColumn("_r", rank).where(F.col("_r") <= sample)
    lists = few.groupBy(label).agg(F.sort_array(F.collect_list("name")).alias("members"))
    return size.join(lists, label).select(
        label, "size", "members", (F.col("size") - F.size("members")).alias("more")
    )
