"""Tables that cut lineage between the rounds of an iterative job.

Each round is written as parquet below the shared folder named by ``spark.checkpoint.dir``, so
a lost executor costs a re-read and not a replay of every earlier round. Parquet (rather than
``DataFrame.checkpoint``) is used because the job then runs once, the columns stay prunable and
the file sizes give the optimizer real statistics for choosing join strategies.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="strataweave-")
    return _LOCAL_ROOTS[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_OPEN: list[list[Scratch]] = []


@contextmanager
def collected(spark: SparkSession) -> Iterator[None]:
    """Delete all intermediate tables that are made inside, once the results have been written.

    Frames returned from inside read these tables, so write what is to be kept before the end.
    """
    made: list[Scratch] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for scratch in made:
            scratch.clear()


class Scratch:
    """One job's intermediate tables; see :func:`collected` for when they go."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._names: list[str] = []
        if _OPEN:
            _OPEN[-1].append(self)

    def _path(self) -> str:
        self._n += 1
        return f"{self.base}/t{self._n:05d}"

    def save(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and return a frame that reads it back; drop the table it replaces."""
        path = self._path()
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        if replaces is not None:
            self.drop(replaces)
        return saved

    def read(self, saved: list[DataFrame]) -> DataFrame:
        """The rows of tables of one schema made by :meth:`save`, in one scan."""
        return self.spark.read.schema(saved[0].schema).parquet(*[df._scratch_path for df in saved])

    def save_bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Write ``df`` as a table bucketed by ``key``: reading it by that key again needs no shuffle."""
        self._names.append(f"scratch_{uuid.uuid4().hex}")
        writer = df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd")
        writer.option("path", self._path()).saveAsTable(self._names[-1])
        return self.spark.table(self._names[-1])

    def clear(self) -> None:
        """Delete all tables of this job."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()
        delete(self.spark, self.base)

    def drop(self, saved: DataFrame) -> None:
        """Delete a table made by :meth:`save` that nothing reads any more."""
        path = getattr(saved, "_scratch_path", None)
        if path is None:
            return
        delete(self.spark, path)
