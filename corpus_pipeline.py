"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.
Null texts, null ids, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import block_naming, mixing, odd_sketch, ordinal_toxicity, template_leaks
from strataweave.llm.queries import TOXIC_FROM, table
from strataweave.scratch import collected, delete, shared_root


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability below TOXIC_FROM stay."""
    model = ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = ordinal_toxicity.score(docs, model)
    return scored.where(F.col("p_toxic") < TOXIC_FROM).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return block_naming.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest id stays."""
    return odd_sketch.drop_near_copies(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks stay."""
    return template_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with the words taken (repeats counted) and their source's target."""
    return mixing.mix(docs).where("taken > 0 OR size = 0")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]
#: Training, near-duplicates and slot checks have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of the stages before it are deleted once they have been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_root(spark)}/llm-pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        with collected(spark):  # a stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
