"""Registered queries against their SQL on the smallest data."""

import pathlib

import duckdb
import pytest

from check import TABLES, compare
from strataweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
FAST = [
    "a12_naming_report", "a10_path_rollup", "e01_to_e08_evaluate_statements", "f11_neighbourhood", "g06_connected_components",
    "g18_g19_g20_node_degrees", "l03_j03_layer_violations", "p01_p02_classify_statements", "p08_j12_span_structure",
    "s08_pom_dependencies", "t08_t09_sbom_components", "t17_link_projects", "v07_j14_snapshot_delta", "x02_activity_stream",
    "g05_cycle_edges", "g36_scc_ranking", "l03_cycle_warnings", "x01_ingest_stream",
    "g04_condense", "g15_enumerate_cycles", "b08_run_rows", "b10_cycles_before_after",
    "s02_s11_sbom_files", "s12_listing_files", "v03_duplicate_tables", "g32_graph_nodes", "l01_j09_rules_of_a_table",
]


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    verdict, rows, _, _, note = compare(spark, con, FOLDER, name)
    assert verdict == "ok" and rows > 0, note


def test_every_sql_has_a_job():
    assert set(catalog.SQL) <= set(catalog.JOBS)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
