"""Headline queries on stored cell tables: one JSON line with seconds per query.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
threads.  Cells, hexagon geometry and tile index are stored first, as a deployment has them; storing
cells and index are timed too.  Every other query has one warm-up run and the median of three counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hexloom as hl
from hexloom import sources
from hexloom.plans import tables

FILTERS = {"l_quantity": {"min": 5, "max": 20}, "l_returnflag": {"choices": ["A", "R"]}}
PROPERTIES = [
    {"type": "number", "column": "l_quantity"},
    {"type": "number", "column": "l_extendedprice"},
    {"type": "number", "column": "tax"},
    {"type": "string", "column": "flag"},
    {"type": "boolean", "column": "discounted"},
]
RUNS = 3


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hexloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action, runs: int = RUNS, warm: bool = True) -> float:
    if warm:
        action()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tables.shared_folder(spark)
    derived = tables.cells(spark, sf_dir)
    results: dict[str, float] = {}

    run(derived)
    results["build_cells"] = seconds(lambda: sources.write_cells(derived, f"{folder}/cells"), runs=1)
    cells = spark.read.parquet(f"{folder}/cells")
    tables.cell_geometry(hl.hexagons(cells)).write.parquet(f"{folder}/geometry")
    geometry = spark.read.parquet(f"{folder}/geometry")
    results["build_tile_index"] = seconds(
        lambda: sources.write_tile_index(hl.build_tile_index(cells, geometry), f"{folder}/tiles"), runs=1
    )
    index = spark.read.parquet(f"{folder}/tiles")
    selected = cells.where("l_quantity = 50 AND l_partkey % 5 < 2").select("id").collect()
    ids = [row["id"] for row in selected]
    box = [[[-81.995, 24.55], [-81.972, 24.55], [-81.972, 25.2], [-81.995, 25.2]]]
    versions = spark.range(1, 4).select(F.col("id").alias("version"))
    tables.coarse_attributes(cells).write.parquet(f"{folder}/coarse")
    coarse = spark.read.parquet(f"{folder}/coarse")

    queries = {
        "count_cells": lambda: run(hl.count_cells(cells, FILTERS)),
        "hex_counts_r9": lambda: run(hl.hex_counts(cells, 9, FILTERS)),
        "tile_counts_z12": lambda: run(hl.tile_counts(cells, index, 12, 1116, 1759, FILTERS)),
        "tile_counts_z6": lambda: run(hl.tile_counts(cells, index, 6, 17, 27, FILTERS)),
        "tile_pyramid": lambda: run(hl.tile_pyramid(cells, index, FILTERS)),
        "stats_all": lambda: run(hl.stats(cells, PROPERTIES)),
        "stats_ids": lambda: run(hl.stats(hl.select_cells(cells, ids=ids), PROPERTIES)),
        "stats_polygon": lambda: run(hl.stats(hl.select_cells(cells, feature=box, centers=geometry), PROPERTIES)),
        "profile": lambda: run(hl.profile(cells, versions)),
        "histogram": lambda: run(hl.histogram(cells, "l_extendedprice")),
        "cell_pyramid": lambda: run(hl.build_cell_pyramid(cells.select("id"), geometry)),
        "join_attributes": lambda: run(hl.join_attributes(cells.select("id"), coarse)),
    }
    for name, action in queries.items():
        results[name] = seconds(action)
    total = round(sum(results.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": results, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
