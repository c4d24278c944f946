"""Visions: layouts, their copies, comparisons and the graphs drawn from them.

Tables: ``layers(vision_id, layer_id, key, name, ord)``, ``groups(layer_id, group_id, key,
name)``, ``memberships(group_id, id)``, ``positions(layer_id, id, x, y)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.scope import induced
from strataweave.skew import hot_keys, skew_join

NEST_LIMIT = 1_000_000  # entries of one vision that may be nested into one document

SNAPSHOT_SCHEMA = """
name string,
layers array<struct<key: string, name: string,
  groups: array<struct<key: string, name: string, members: array<string>>>,
  node_positions: array<struct<project_key: string, position: array<double>>>>>"""


def snapshot(
    layers: DataFrame, groups: DataFrame, memberships: DataFrame, positions: DataFrame, nodes: DataFrame
) -> DataFrame:
    """(vision_id, kind, path, payload): a copy of every layout entry, one JSON per row.

    Entries stay rows, so a vision of any size is written and compared in parallel.
    """
    keyed = nodes.select("id", F.col("key").alias("node_key"))
    placed = layers.select("vision_id", "layer_id", F.col("key").alias("layer_key"))
    grouped = groups.join(placed, "layer_id").withColumn("group_path", F.concat_ws("/", "layer_key", "key"))
    entry = lambda kind, path, **fields: [
        F.col("vision_id"),
        F.lit(kind).alias("kind"),
        path.alias("path"),
        F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload"),
    ]
    a = layers.select(*entry("layer", F.col("key"), name=F.col("name"), ord=F.col("ord")))
    b = grouped.select(*entry("group", F.col("group_path"), name=F.col("name")))
    member = skew_join(
        memberships, grouped.select("group_id", "vision_id", "group_path"), "group_id",
        hot_left=hot_keys(memberships, "group_id"),
    ).join(keyed, "id")
    c = member.select(*entry("member", F.concat_ws("/", "group_path", "node_key"), key=F.col("node_key")))
    spot = skew_join(positions, placed, "layer_id", hot_left=hot_keys(positions, "layer_id")).join(keyed, "id")
    d = spot.select(*entry("position", F.concat_ws("/", "layer_key", "node_key"), x=F.col("x"), y=F.col("y")))
    return a.unionByName(b).unionByName(c).unionByName(d)


def nested_snapshot(
    visions: DataFrame, layers: DataFrame, groups: DataFrame, memberships: DataFrame, nodes: DataFrame
) -> DataFrame:
    """(vision_id, document): layers with groups with members as one JSON per vision.

    A document is one value, so this form refuses visions with more than NEST_LIMIT members;
    :func:`snapshot` has no such bound.
    """
    wide = (
        memberships.join(groups.select("group_id", "layer_id"), "group_id")
        .join(layers.select("layer_id", "vision_id"), "layer_id")
        .groupBy("vision_id")
        .agg(F.count("*").alias("n"))
    )
    if not wide.where(F.col("n") > NEST_LIMIT).isEmpty():
        raise ValueError("vision too large for one document; use snapshot()")
    members = memberships.join(nodes.select("id", "key"), "id").groupBy("group_id").agg(
        F.sort_array(F.collect_list("key")).alias("members")
    )
    group = groups.join(members, "group_id", "left").select(
        "layer_id",
        F.struct("key", "name", F.coalesce("members", F.array().cast("array<string>")).alias("members")).alias("g"),
    )
    per_layer = group.groupBy("layer_id").agg(F.sort_array(F.collect_list("g")).alias("groups"))
    empty = F.expr("CAST(array() AS array<struct<key:string,name:string,members:array<string>>>)")
    layer = layers.join(per_layer, "layer_id", "left").select(
        "vision_id", F.struct("ord", "key", "name", F.coalesce("groups", empty).alias("groups")).alias("l")
    )
    per_vision = layer.groupBy("vision_id").agg(F.sort_array(F.collect_list("l")).alias("layers"))
    return visions.join(per_vision, "vision_id", "left").select(
        "vision_id", F.to_json(F.struct("name", "layers")).alias("document")
    )


def restore(documents: DataFrame) -> DataFrame:
    """(doc, layer_key, ord, group_key, member) of stored documents ``(doc, document)``.

    Empty layers and groups keep a row with nulls.
    """
    d = documents.select("doc", F.from_json("document", SNAPSHOT_SCHEMA).alias("d"))
    layer = d.select("doc", F.posexplode_outer("d.layers").alias("ord", "l"))
    group = layer.select("doc", "ord", F.col("l.key").alias("layer_key"), F.explode_outer("l.groups").alias("g"))
    return group.select(
        "doc", "layer_key", "ord", F.col("g.key").alias("group_key"), F.explode_outer("g.members").alias("member")
    )


def restored_positions(documents: DataFrame) -> DataFrame:
    """(doc, member, x, y): the first stored position of a component in layer order."""
    d = documents.select("doc", F.from_json("document", SNAPSHOT_SCHEMA).alias("d"))
    rows = d.select("doc", F.posexplode("d.layers").alias("ord", "l")).select(
        "doc", "ord", F.posexplode("l.node_positions").alias("at", "p")
    )
    first = F.min_by("p.position", F.struct("ord", "at"))
    return rows.groupBy("doc", F.col("p.project_key").alias("member")).agg(first.alias("xy")).select(
        "doc", "member", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y")
    )


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(vision_id, kind, path, change, before, after): entries added, removed or changed."""
    key = ["vision_id", "kind", "path"]
    a = before.select(*key, F.col("payload").alias("before"))
    b = after.select(*key, F.col("payload").alias("after"))
    joined = a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return joined.select(*key, change.alias("change"), "before", "after")


def duplicate_vision(layers: DataFrame, groups: DataFrame, memberships: DataFrame, source, target) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows of a copy: ids get the target vision as prefix, so children keep their parents."""
    fresh = lambda c: F.concat(F.lit(f"{target}-"), F.col(c).cast("string"))
    own = layers.where(F.col("vision_id") == source)
    new_layers = own.select(F.lit(target).alias("vision_id"), fresh("layer_id").alias("layer_id"), "key", "name", "ord")
    kept = groups.join(own.select("layer_id"), "layer_id", "left_semi")
    new_groups = kept.select(fresh("layer_id").alias("layer_id"), fresh("group_id").alias("group_id"), "key", "name")
    rows = skew_join(memberships, kept.select("group_id"), "group_id", "left_semi", hot_left=hot_keys(memberships, "group_id"))
    return new_layers, new_groups, rows.select(fresh("group_id").alias("group_id"), "id")


def save_layout(positions: DataFrame, sent: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Positions after a save: sent rows replace old ones; others stay or go."""
    key = ["layer_id", "id"]
    cols = [*key, "x", "y"]
    newest = sent.groupBy(*key).agg(F.max(F.struct("x", "y")).alias("p")).select(*key, "p.x", "p.y")
    if not keep_missing:
        return newest
    return positions.select(*cols).join(newest.select(*key), key, "left_anti").unionByName(newest)


def keep_groups(groups: DataFrame, sent: DataFrame) -> DataFrame:
    """Groups of a layer that the sent layout still names; layers not sent are untouched."""
    touched = sent.select("layer_id").distinct()
    gone = groups.join(touched, "layer_id", "left_semi").join(sent.select("layer_id", "key"), ["layer_id", "key"], "left_anti")
    return groups.join(gone.select("group_id"), "group_id", "left_anti")


def add_members(memberships: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, id) rows to add: existing components that are not members yet."""
    rows = wanted.select("group_id", "id").distinct().join(nodes.select("id"), "id", "left_semi")
    return rows.join(memberships.select("group_id", "id"), ["group_id", "id"], "left_anti").select("group_id", "id")


def remove_members(memberships: DataFrame, unwanted: DataFrame) -> DataFrame:
    return memberships.join(unwanted.select("group_id", "id"), ["group_id", "id"], "left_anti")


def delete_vision(layers: DataFrame, groups: DataFrame, memberships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the visions of ``gone(vision_id)`` and everything below them."""
    dead_layers = layers.join(gone, "vision_id", "left_semi").select("layer_id")
    dead_groups = groups.join(dead_layers, "layer_id", "left_semi").select("group_id")
    return (
        layers.join(gone, "vision_id", "left_anti"),
        groups.join(dead_layers, "layer_id", "left_anti"),
        skew_join(memberships, dead_groups, "group_id", "left_anti", hot_left=hot_keys(memberships, "group_id")),
    )


def set_as_layer(vision_id, key: str, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layer, group and membership rows that show a resolved set as one group."""
    spark = members.sparkSession
    layer_id, group_id = f"{vision_id}-{key}", f"{vision_id}-{key}-all"
    layer = spark.createDataFrame([(vision_id, layer_id, key, key, 0)], ["vision_id", "layer_id", "key", "name", "ord"])
    group = spark.createDataFrame([(layer_id, group_id, key, key)], ["layer_id", "group_id", "key", "name"])
    return layer, group, members.select(F.lit(group_id).alias("group_id"), "id").distinct()


def first_membership(layers: DataFrame, groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, layer_key, group_key): the membership shown when a component is in several groups.

    The first by layer order, layer name and group name; a hash aggregate, not a window.
    """
    shown = groups.select("group_id", "layer_id", F.col("key").alias("group_key"), F.col("name").alias("gname")).join(
        layers.select("layer_id", F.col("key").alias("layer_key"), F.col("name").alias("lname"), "ord"), "layer_id"
    )
    rows = skew_join(memberships, shown, "group_id", hot_left=hot_keys(memberships, "group_id"))
    best = F.min_by(F.struct("layer_key", "group_key"), F.struct("ord", "lname", "gname", "group_key"))
    return rows.groupBy("id").agg(best.alias("b")).select("id", "b.layer_key", "b.group_key")


def vision_graph(
    layers: DataFrame, groups: DataFrame, memberships: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes with the group they are drawn in, and the edges among them."""
    shown = first_membership(layers, groups, memberships)
    return shown, induced(edges.select("src", "dst").distinct(), shown.select("id"))


def graph_document(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame, transitive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows as JSON elements, edges with transitive and in_cycle flags."""
    loop = cyclic.select("src", "dst").withColumn("_c", F.lit(True))
    flags = transitive.select("src", "dst", "transitive")
    e = edges.select("src", "dst").distinct().join(loop, ["src", "dst"], "left").join(flags, ["src", "dst"], "left")
    edge = F.struct(
        F.concat_ws("-", "src", "dst").alias("id"),
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.coalesce("transitive", F.lit(False)).alias("transitive"),
        F.coalesce("_c", F.lit(False)).alias("in_cycle"),
    )
    node = F.struct("id", F.col("name").alias("label"), F.col("group_key").alias("parent"))
    return nodes.select("id", F.to_json(node).alias("json")), e.select("src", "dst", F.to_json(edge).alias("json"))


def vision_list(visions: DataFrame, layers: DataFrame, statements: DataFrame, status: str | None = None) -> DataFrame:
    """(vision_id, name, status, layers, statements), each child counted before it is joined."""
    l = layers.groupBy("vision_id").agg(F.count("*").alias("layers"))
    s = statements.groupBy("vision_id").agg(F.count("*").alias("statements"))
    out = visions if status is None else visions.where(F.col("status") == status)
    return out.join(l, "vision_id", "left").join(s, "vision_id", "left").select(
        "vision_id", "name", "status", F.coalesce("layers", F.lit(0)).alias("layers"), F.coalesce("statements", F.lit(0)).alias("statements")
    )


def stability(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counts and a verdict, the violated statements that block it)."""
    counts = evaluated.agg(
        F.count_if("is_satisfied").alias("satisfied"),
        F.count_if(~F.col("is_satisfied")).alias("violated"),
        F.count_if(F.col("is_satisfied").isNull()).alias("unverified"),
    )
    return counts.withColumn("stable", F.col("violated") == 0), evaluated.where("NOT is_satisfied")


def run_trend(runs: DataFrame, metrics: list[str], key: str = "scope") -> DataFrame:
    """Run history with the change of each metric since the run before (per scope)."""
    w = Window.partitionBy(key).orderBy("finished_at", "run_id")
    change: list[Column] = [(F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in metrics]
    return runs.select(key, "run_id", "finished_at", *metrics, *change)


def momentum(metrics: DataFrame, cycles: DataFrame, violations: DataFrame, statements: DataFrame) -> DataFrame:
    """One row: avg_coupling, cyclic_components, largest_cycle, violations, formal and satisfied shares."""
    a = metrics.agg(F.avg("coupling_score").alias("avg_coupling"))
    d = statements.agg(
        F.avg(F.when(F.col("status") == "formal", 1.0).otherwise(0.0)).alias("formal_ratio"),
        F.avg(F.when(F.col("is_satisfied"), 1.0).otherwise(0.0)).alias("satisfied_ratio"),
    )
    d = d.select(F.struct("*").alias("d")).scalar()
    return a.withColumn("_d", d).select(
        "avg_coupling",
        cycles.agg(F.count("*")).scalar().alias("cyclic_components"),
        cycles.agg(F.coalesce(F.max("size"), F.lit(0))).scalar().alias("largest_cycle"),
        violations.agg(F.count("*")).scalar().alias("violations"),
        "_d.formal_ratio",
        "_d.satisfied_ratio",
    )
