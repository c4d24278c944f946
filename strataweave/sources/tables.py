"""Table reads, appends, rewrites and JSON results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.scratch import delete, shared_root


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def rewrite(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``, also when ``rows`` was computed from it.

    The rows are staged in the shared folder first, so the target is never read while it is
    being overwritten.
    """
    spark = rows.sparkSession
    stage = f"{shared_root(spark)}/stage-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(stage)
    spark.read.schema(rows.schema).parquet(stage).write.mode("overwrite").parquet(path)
    delete(spark, stage)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document per row, in as many files as the rows have partitions."""
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias(name))


def save_rejects(rejects: DataFrame, path: str) -> None:
    rejects.select("doc", "error").write.mode("append").json(path)


def save_analysis(run: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Append the run row, replace the metric rows."""
    append(run, f"{folder}/analysis_run")
    rewrite(metrics, f"{folder}/node_metrics")


def save_violations(violations: DataFrame, run_id: str, folder: str) -> None:
    append(violations.withColumn("run_id", F.lit(run_id)), f"{folder}/layer_violation")
