"""Compare registered queries with their SQL on one data folder.

    python check.py [name-part ...] [--sf 0.01] [--data /root/testdata]
"""

from __future__ import annotations

import argparse
import json
import math
import time

import duckdb

from strataweave.plans import catalog
from strataweave.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name):
    started = time.time()
    frame = catalog.JOBS[name](spark, folder)
    mine = frame.collect()
    took = time.time() - started
    sql = catalog.SQL.get(name)
    if sql is None:
        return "rows-only", len(mine), took, 0.0, ""
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    sql_took = time.time() - started
    a, b = _rows(frame.columns, mine), _rows(names, theirs)
    if sorted(frame.columns) != sorted(names):
        return "COLUMNS", len(a), took, sql_took, f"{sorted(frame.columns)} vs {sorted(names)}"
    if a == b:
        types = dict(zip(names, [str(d[1]) for d in result.description]))
        return "ok", len(a), took, sql_took, json.dumps(types) if any("HUGE" in t or "DECIMAL" in t for t in types.values()) else ""
    left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return "DIFF", len(a), took, sql_took, f"sql rows={len(b)} spark-only={left} sql-only={right}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--data", default="/root/testdata")
    args = parser.parse_args()
    folder = f"{args.data}/sf{args.sf}"
    spark = session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in sorted(catalog.JOBS):
        if args.names and not any(part in name for part in args.names):
            continue
        try:
            verdict, rows, took, sql_took, note = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            verdict, rows, took, sql_took, note = "ERROR", 0, 0.0, 0.0, str(error)[:700]
        bad += verdict not in ("ok", "rows-only")
        print(f"{verdict:9s} {name:36s} rows={rows:<7d} spark={took:6.1f}s sql={sql_took:5.1f}s {note}", flush=True)
    print(f"{bad} not matching")


if __name__ == "__main__":
    main()
