"""Tag expression trees as boolean columns over a ``tags`` array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_predicate(expression, tags: str | Column = "tags") -> Column:
    """Compile ``"a"``, ``{"and": [..]}``, ``{"or": [..]}``, ``{"not": x}`` or ``{"tag": "a"}``.

    Empty lists select nothing, as does anything that is not a tree.
    """
    column = F.col(tags) if isinstance(tags, str) else tags
    if isinstance(expression, str):
        return F.coalesce(F.array_contains(column, expression), F.lit(False))
    if isinstance(expression, dict):
        if "tag" in expression:
            return tag_predicate(expression["tag"], column)
        if "not" in expression:
            return ~tag_predicate(expression["not"], column)
        for name, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
            if name in expression:
                parts = [tag_predicate(e, column) for e in expression[name]]
                return reduce(join, parts) if parts else F.lit(False)
    return F.lit(False)


def has_all(names: list[str], tags: str = "tags") -> Column:
    wanted = F.array(*[F.lit(n) for n in dict.fromkeys(names)])
    return F.size(F.array_intersect(F.col(tags), wanted)) == len(set(names)) if names else F.lit(False)


def has_any(names: list[str], tags: str = "tags") -> Column:
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.col(tags), F.array(*[F.lit(n) for n in names]))
