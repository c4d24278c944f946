"""The registered queries: a Spark job and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add
