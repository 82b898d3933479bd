"""Times the headline queries and prints one JSON line.

Derived tables are written first and timed as their own entry, which counts in the total;
every other number is the operator's scan-to-result time (noop sink, best of two).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridspark.session import configured

HEADLINE = [
    "a01_work_profile", "a02_mean_flow_profile", "a05_demean", "a06_pressure_work", "a07_body_force",
    "a08_kinetic_energy", "a09_potential_energy", "a12_budget_residual", "a13_linear_flux_west_east",
    "a15_nonlinear_flux", "a19_vertical_mean_split", "a20_flux_decomposition", "a21_mean_of_last",
    "a22_field_statistics", "a23_layer_transport", "a24_advective_cfl", "a26_vorticity_statistics",
    "p04_middle_slice", "p05_strided_time", "j05_slice_with_surface", "w03_interface_weighted",
    "w04_face_to_centre", "w11_restart_overlap", "x01_tidal_average", "x02_shifted_average",
    "x05_phase_composite", "q01_mean_spectrum", "l02_metric_blocks", "l03_progress", "s13_run_log",
    "l04_job_status", "g10_bottom_diffusivity",
]


def session(cpus: int) -> SparkSession:
    spark = (
        configured(SparkSession.builder).master(f"local[{cpus}]").appName("gridspark-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    from gridspark.plans import QUERIES, load
    from gridspark.plans.tables import Tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    load()
    tables = Tables(spark, sf_dir)
    seconds = {"derive_tables": round(timed(lambda: [tables.cells.count(), tables.cells2d.count(), tables.grid2d.count(),
                                                     tables.records.count(), tables.columns.count(), tables.params.count()]), 3)}
    cells = tables.cells.count()
    # a job that no code of this package touches: tells a slow machine from slow code
    fixed = spark.range(0, 100_000_000, 1, 16).selectExpr("id % 1000 AS k", "xxhash64(id) % 1000 AS x").groupBy("k").sum("x")
    machine = min(timed(lambda: fixed.write.format("noop").mode("overwrite").save()) for _ in range(2))
    for name in HEADLINE:
        def run(query=QUERIES[name]):
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        seconds[name] = round(min(timed(run), timed(run)), 3)
    total = sum(seconds.values())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cells": cells, "machine_reference_sec": round(machine, 3),
    }))


if __name__ == "__main__":
    main()
