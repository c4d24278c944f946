"""Numbers for rows whose ids do not tell them apart.

Where no id is null or repeated the id is the number, and nothing is written. Otherwise rows get positions in the
order of (id, text digest), rows without an id each their own; rows with the same id and the same text share one.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.scratch import Scratch
from strataweave.skew import number_rows


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or the first of name_1, name_2, .. that is no column yet, capitals aside: for helper columns."""
    taken = {c.lower() for c in columns}
    tries = chain([name], (f"{name}_{i}" for i in count(1)))
    return next(n for n in tries if n.lower() not in taken)


def ids_are_unique(docs: DataFrame) -> bool:
    """Whether no ``doc_id`` is null or repeated; only ids are shuffled."""
    return docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()


def positioned(docs: DataFrame, scratch: Scratch, nulls_first: bool, name: str = "position") -> DataFrame:
    """``docs`` with a column ``name`` that it does not have yet, written down."""
    none = F.col("doc_id").isNull()
    key: list[str] = []
    for helper in ("none", "known", "tag", "digest"):
        key.append(unused(f"_{helper}", [*docs.columns, *key, name]))
    rows = scratch.save(
        docs.withColumns(dict(zip(key, [
            none != F.lit(nulls_first),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            F.when(none, F.monotonically_increasing_id()).otherwise(-1),
            F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256),
        ])))
    )
    places = scratch.save(number_rows(rows.select(*key).distinct(), key, name))
    return scratch.save(rows.join(places, key).select(*docs.columns, name), replaces=rows)
