"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the data (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import re
import time

from strataweave.plans import catalog
from strataweave.session import session

HEADLINES = [
    "g18_g19_g20_node_degrees",
    "o01_most_coupled",
    "a14_high_coupling",
    "a10_path_rollup",
    "a12_naming_report",
    "f04_tags_or_untagged",
    "f11_neighbourhood",
    "f12_induced_subgraph",
    "l03_j03_layer_violations",
    "r02_resolve_sets",
    "e01_to_e08_evaluate_statements",
    "p01_p02_classify_statements",
    "p08_j12_span_structure",
    "s03_sbom_packages",
    "t08_t09_sbom_components",
    "s04_t20_sbom_edges",
    "s08_pom_dependencies",
    "t12_upsert_edges",
    "v01_snapshot",
    "g06_connected_components",
    "g03_scc",
    "g11_topological_layers",
    "g12_transitive_edges",
    "g14_label_propagation",
    "g21_betweenness",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in HEADLINES:
        started = time.time()
        catalog.JOBS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
