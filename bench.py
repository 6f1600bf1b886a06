"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1) and BENCH_CPUS the local threads. Each
query is run once to warm up and then three times; the best counts. Results go to a sink
that keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from graphloom.api import statements  # noqa: E402
from graphloom.options import Options  # noqa: E402
from graphloom.plans.model import Plan  # noqa: E402
from graphloom.queries import EX, QUERIES, emit, iri, lit, order_graph, ref, scan, tpl  # noqa: E402


def lineitem_map(spark: SparkSession, sf_dir: str):
    """One statement a line item, by a map-only plan."""
    plan = Plan()
    functions = {"s": iri(tpl(EX + "l/{l_orderkey}/{l_linenumber}", "l_orderkey", "l_linenumber")), "o": lit(ref("l_quantity"))}
    emit(plan, scan(plan, sf_dir, "lineitem"), functions, f"?s <{EX}quantity> ?o .")
    return statements(plan, spark=spark)


def unfused(spark: SparkSession, sf_dir: str):
    return statements(order_graph(sf_dir), Options(fuse_siblings=False), spark)


HEADLINE = {
    "lineitem_map": lineitem_map,
    "serialize_escaping": QUERIES["serialize_escaping"],
    "fn_uri_encode": QUERIES["fn_uri_encode"],
    "join_multi_key": QUERIES["join_multi_key"],
    "order_graph_all": QUERIES["order_graph_all"],
    "order_graph_unfused": unfused,
    "flagship_order_graph": QUERIES["flagship_order_graph"],
    "rml_end_to_end": QUERIES["rml_end_to_end"],
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in HEADLINE.items():
        best = float("inf")
        for turn in range(4):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if turn else best
        took[name] = round(best, 3)
    sf = (re.findall(r"sf([0-9.]+)", sf_dir) or ["0"])[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf)}))


if __name__ == "__main__":
    main()
