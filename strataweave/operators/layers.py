"""Architectural layers: assignment by pattern, manual overrides and violations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import first_true
from strataweave.skew import hot_keys, skew_join

MAX_RULES = 1000


@dataclass(frozen=True)
class LayerRule:
    level: int
    name: str
    pattern: str


def layer_rules(table: DataFrame) -> list[LayerRule]:
    """Rules of a ``(level, name, pattern)`` configuration table, lowest level first.

    A rule list is configuration; more than MAX_RULES rows means the wrong table was passed.
    """
    rows = table.select("level", "name", "pattern").orderBy("level", "name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} layer rules")
    for r in rows:
        re.compile(r["pattern"])
    return [LayerRule(r["level"], r["name"], r["pattern"]) for r in rows]


def assign_layers(
    nodes: DataFrame, rules: list[LayerRule], manual: DataFrame | None = None
) -> DataFrame:
    """(id, layer, level, auto_assigned): first rule by level whose pattern starts the key.

    The rules become one CASE expression, so assignment is a projection of the node scan.
    ``manual(id, layer, level)`` wins over patterns.
    """
    ordered = sorted(rules, key=lambda r: (r.level, r.name))
    hit = first_true(
        [
            (
                F.col("key").rlike(f"^(?:{r.pattern})"),
                F.struct(F.lit(r.name).alias("layer"), F.lit(r.level).alias("level")),
            )
            for r in ordered
        ]
    )
    auto = nodes.select("id", hit.alias("_l")).where("_l IS NOT NULL").select(
        "id", "_l.layer", "_l.level", F.lit(True).alias("auto_assigned")
    )
    if manual is None:
        return auto
    fixed = manual.select("id", "layer", "level", F.lit(False).alias("auto_assigned"))
    return auto.join(fixed, "id", "left_anti").unionByName(fixed)


def set_manual(assignment: DataFrame, chosen: DataFrame) -> DataFrame:
    """Assignment with ``chosen(id, layer, level)`` set by hand; a null layer removes the row."""
    rest = assignment.join(chosen.select("id"), "id", "left_anti")
    return rest.unionByName(
        chosen.where("layer IS NOT NULL").select("id", "layer", "level", F.lit(False).alias("auto_assigned"))
    )


def layer_violations(
    edges: DataFrame, assignment: DataFrame, cycle: DataFrame | None = None
) -> DataFrame:
    """(src, dst, source_layer, target_layer, severity, reason) of edges against the layering.

    A dependency from a lower to a higher level is critical, one inside a level is info. With
    ``cycle(src, dst)`` the latter becomes a warning when the edge lies on a cycle. Ends
    without a layer are left out.
    """
    e = edges.select("src", "dst").distinct()
    a = assignment.select(F.col("id").alias("src"), F.col("layer").alias("source_layer"), F.col("level").alias("ls"))
    b = assignment.select(F.col("id").alias("dst"), F.col("layer").alias("target_layer"), F.col("level").alias("lt"))
    out = skew_join(e, a, "src", hot_left=hot_keys(e, "src"))
    out = skew_join(out, b, "dst", hot_left=hot_keys(e, "dst")).where("ls <= lt")
    info = F.lit("info")
    if cycle is not None:
        out = out.join(
            cycle.select("src", "dst").distinct().withColumn("_c", F.lit(True)), ["src", "dst"], "left"
        )
        info = F.when(F.col("_c"), F.lit("warning")).otherwise(F.lit("info"))
    return out.select(
        "src",
        "dst",
        "source_layer",
        "target_layer",
        F.when(F.col("ls") < F.col("lt"), F.lit("critical")).otherwise(info).alias("severity"),
        F.when(F.col("ls") < F.col("lt"), F.lit("lower layer depends on higher layer"))
        .otherwise(F.lit("dependency inside one layer"))
        .alias("reason"),
    )


def layer_counts(rules: list[LayerRule], assignment: DataFrame) -> DataFrame:
    """(layer, level, components) for every rule, also unused ones."""
    spark = assignment.sparkSession
    every = spark.createDataFrame([(r.name, r.level) for r in rules], "layer string, level int")
    n = assignment.groupBy("layer").agg(F.count("*").alias("n"))
    return every.join(n, "layer", "left").select(
        "layer", "level", F.coalesce("n", F.lit(0)).alias("components")
    )


def violation_totals(violations: DataFrame) -> DataFrame:
    return violations.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "info").alias("info"),
    )
