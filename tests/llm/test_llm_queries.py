"""Registered queries of the training-data operators against their SQL on the smallest data."""

import pathlib

import duckdb
import pytest

import check
from strataweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(check.catalog, "JOBS", queries.JOBS)
    monkeypatch.setattr(check.catalog, "SQL", queries.SQL)
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    verdict, rows, _, _, note = check.compare(spark, con, FOLDER, name)
    assert verdict == "ok" and rows > 0, note


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in found and set(queries.SQL) <= set(entry.oracle_sql())
