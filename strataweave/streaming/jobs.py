"""Continuous versions of the ingest and of the activity report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataweave.operators.reports import activity_bucket
from strataweave.scratch import Scratch
from strataweave.sources.documents import coordinate_key, package_key, package_pairs, parsed_sboms, sbom_packages, split_sboms
from strataweave.sources.tables import append

FIELDS = ["name", "version", "internal", "group_key"]


def sbom_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of JSON files as they arrive below ``path``."""
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.json")
        .load(path)
        .select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    )


def ingest_sboms(stream: DataFrame, target: str, checkpoint: str, internal_prefix: str | None = None) -> StreamingQuery:
    """Append what each batch of documents says to ``component``, ``dependency`` and ``reject`` tables.

    Nothing is overwritten, so a job that dies loses nothing and a batch costs what it holds.
    :func:`stored_components`, :func:`stored_edges` and :func:`stored_rejects` read the tables
    back: the first row by document and position per component, edges once each and only between
    known components. So the result is that of one batch run however the documents are split, a
    replayed batch changes nothing, and an edge may arrive before its target.
    """

    def batch(docs: DataFrame, number: int) -> None:
        # parsed once and written, as a batch may hold far more text than the executors' memory
        scratch = Scratch(docs.sparkSession, "batch")
        good, bad = split_sboms(scratch.save(parsed_sboms(docs)))
        append(first_packages(good, internal_prefix).withColumn("batch", F.lit(number)), f"{target}/component")
        pairs = package_pairs(good).select(package_key(F.col("src")).alias("src"), package_key(F.col("dst")).alias("dst"))
        rows = pairs.select("src", "dst", F.lit("compile").alias("scope"), F.lit(1).alias("weight"))
        append(rows.withColumn("batch", F.lit(number)), f"{target}/dependency")
        append(bad.withColumn("batch", F.lit(number)), f"{target}/reject")
        scratch.clear()

    return (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def first_packages(docs: DataFrame, internal_prefix: str | None = None) -> DataFrame:
    """(key, seen, name, version, internal, group_key): each package's first row, with where it was seen."""
    rows = sbom_packages(docs, internal_prefix)
    rows = rows.withColumn("key", coordinate_key(F.col("maven_group_id"), F.col("artifact_id"), F.col("purl_key")))
    first = F.min(F.struct(F.struct("doc", "pos").alias("seen"), *FIELDS))
    return rows.groupBy("key").agg(first.alias("f")).select("key", "f.*")


def stored_components(spark: SparkSession, target: str) -> DataFrame:
    """(key, name, version, internal, group_key) collected so far; the first seen row counts."""
    rows = spark.read.parquet(f"{target}/component")
    return rows.groupBy("key").agg(F.min(F.struct("seen", *FIELDS)).alias("f")).select("key", *[f"f.{c}" for c in FIELDS])


def stored_rejects(spark: SparkSession, target: str) -> DataFrame:
    """(doc, error) collected so far, once each."""
    return spark.read.parquet(f"{target}/reject").select("doc", "error").distinct()


def stored_edges(spark: SparkSession, target: str) -> DataFrame:
    """(src, dst, scope, weight) collected so far between known components."""
    known = spark.read.parquet(f"{target}/component").select("key").distinct()
    e = spark.read.parquet(f"{target}/dependency").select("src", "dst", "scope", "weight").distinct()
    return e.join(known.withColumnRenamed("key", "src"), "src", "left_semi").join(
        known.withColumnRenamed("key", "dst"), "dst", "left_semi"
    )


def activity_windows(events: DataFrame, entity: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(entity, window_start, events, last_seen) per tumbling window, with a watermark for late rows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(entity, F.window("ts", size).alias("w"))
        .agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))
        .select(entity, F.col("w.start").alias("window_start"), "events", "last_seen")
    )


def activity_status(windows: DataFrame, entity: str, as_of: str) -> DataFrame:
    """(entity, last_seen, events, bucket): buckets are taken when read, so late rows still count."""
    last = windows.groupBy(entity).agg(F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))
    return last.withColumn("bucket", activity_bucket(F.col("last_seen"), F.to_timestamp(F.lit(as_of))))


def run_activity(stream: DataFrame, entity: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write every batch's changed windows with the batch number.

    Windows are updated until the watermark passes them; :func:`newest_windows` keeps the last
    state of each, so late and open windows both count and a replayed batch is harmless.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return (
        activity_windows(stream, entity)
        .writeStream.foreachBatch(batch)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_windows(spark: SparkSession, target: str, entity: str) -> DataFrame:
    """(entity, window_start, events, last_seen): the last written state of every window."""
    rows = spark.read.parquet(target)
    last = F.max_by(F.struct("events", "last_seen"), "batch")
    return rows.groupBy(entity, "window_start").agg(last.alias("w")).select(entity, "window_start", "w.*")
