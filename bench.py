"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Each stage is run once to warm up and then twice; the better time counts. Building and writing are
measured with the `noop` sink, so that every row and column is really produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from graphlift.operators import checks as CK
from graphlift.operators import profile as P
from graphlift.plans import registry
from graphlift.plans.build import build_graph
from graphlift.plans.pipeline import analyze, migrate, validate
from graphlift.plans.sample import FILES, sample_source
from graphlift.sources import sinks


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def build(mode: str):
    def run(spark: SparkSession, d: str) -> None:
        g = build_graph(sample_source(spark, d), mode)
        for df in g.nodes.values():
            noop(df)
        noop(g.edges)

    return run


def profile(spark: SparkSession, d: str) -> None:
    noop(P.column_stats(sample_source(spark, d, FILES).tables))


def fk_profile(spark: SparkSession, d: str) -> None:
    noop(P.fk_profile(sample_source(spark, d)))


def reconcile(spark: SparkSession, d: str) -> None:
    s = sample_source(spark, d)
    noop(CK.findings(s, build_graph(s, assume_complete=True)))


def migrate_and_validate(spark: SparkSession, d: str) -> None:
    found = analyze(sample_source(spark, d))
    noop(validate(found.source, migrate(found, sinks.scratch_folder(spark)))["findings"])


def query(name: str):
    return lambda spark, d: noop(registry.QUERIES[name](spark, d))


STAGES = {
    "profile": profile,
    "fk_profile": fk_profile,
    "build_direct": build("direct"),
    "build_enriched": build("enriched"),
    "reconcile": reconcile,
    "migrate_and_validate": migrate_and_validate,
    **{
        n: query(n)
        for n in (
            "a3_ordered_batches", "b2_primary_keys", "b3_foreign_keys", "c6_data_cardinality", "d4_fk_edges",
            "d5_junction_edges", "d6_spread_endpoints", "d7_merged_nodes", "d12_unique_nodes", "f2_edge_counts",
            "f2_edges_per_segment", "f5_two_hops", "f6_collected", "e10_orphan_rows",
        )
    },
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphlift-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, stage in STAGES.items():
        best = float("inf")
        for i in range(3):
            start = time.perf_counter()
            stage(spark, d)
            if i:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    sf = os.path.basename(d.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
