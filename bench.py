"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tagplane.plans import fixtures, registry

HEADLINE = (
    "count_bins", "count_windows_sliding", "count_windows_ext", "count_windows_shift", "count_regions", "count_regions_ext", "count_margins", "overlap_join",
    "diagnose_intra", "diagnose_inter", "strip_outward_kept", "cross_chrom_counts", "merge_libraries", "catalog", "compress_matrix", "pair_distance",
    "pair_alignments", "pair_diagnostics", "linker_classify", "linker_trim", "heatmap_bins", "log_cpm", "hwe_chisq", "bh_adjust", "tmm_factors", "normalize",
    "cluster_boxes", "store_catalog", "sam_pairs", "result_table", "reduce_regions", "store_cross_counts", "strip_counted", "prepare_counted", "stream_diagnostics",
    "fastq_pairs", "fitted_log_cpm", "loess_offsets", "coefficient_tests", "dispersion_grid", "model_tests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["pair_diagnostics"](spark, sf_dir).collect()  # starts the executors
    took = {}
    # Tables that several queries start from, each made once: tag pairs from lineitem, counts of window and region pairs.
    for name, make in {"store_pets": fixtures.pets, "store_window_counts": registry.window_counts, "store_region_counts": registry.interactions}.items():
        began = time.perf_counter()
        make(spark, sf_dir)
        took[name] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
