"""Timed headline queries; prints one JSON line.

A query's time is the middle one of ``BENCH_RUNS`` runs (three), planning included.  ``machine`` is the time of a fixed calculation on one core,
by which runs on different machines compare; ``more`` are queries that earlier rounds did not time and the total leaves out.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from structscreen.bindings import load
from structscreen.plans.session import BUILD_SETTINGS

HEADLINE = (
    "all_policies_report", "select_rmsd_combined_rank", "average_ranks", "final_rerank", "weighted_affinity",
    "radius_pairs_per_supplier", "neighbor_graph_capped", "nearest_neighbors", "clash_score", "lddt_with_binding_site",
    "protein_and_pocket_rmsd", "kabsch_fit", "contact_precision", "variant_scores", "validation_metrics",
    "merge_screening", "hit_summary", "cluster_representatives", "token_ids", "alignment_columns", "batches_padded",
    "fasta_round_trip", "mean_embeddings", "balanced_sample", "knn_regression",
)
MORE = ("lddt_of_poses", "nearest_neighbors_whole", "rotatable_bonds", "diverse_subset", "variant_scores_whole")


def fixed_calculation() -> float:
    start = time.perf_counter()
    sum(i * i % 7 for i in range(3_000_000))
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("structscreen-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in BUILD_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # one untimed small run starts the JVM, the Python workers and the readers
    registry["weighted_affinity"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    def timed(name: str) -> float:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return round(median(took), 3)

    times = {name: timed(name) for name in names}
    more = {name: timed(name) for name in MORE} if names is HEADLINE else {}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    machine = round(median(fixed_calculation() for _ in range(5)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "runs": runs, "machine": machine, "more": more,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
