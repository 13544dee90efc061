"""Cell tables derived from the star-schema tables, for the registered queries and the bench.

Every ``lineitem`` row becomes one attributed cell row: its order and line number are the base-7
digits of a cell id.  Hexagon positions are synthetic, a plain grid, not true cell positions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import cellid
from hexloom.operators.layers import build_tile_index, hexagons
from hexloom.sources.writers import write_cells, write_tile_index

# Base cell 34 (not a pentagon) at resolution 0.
ROOT_CELL = (1 << 59) | (34 << 45) | cellid.unused_digits(0)
CELLS_UNDER_ROOT = 7**cellid.FINEST

# Fixed values of the synthetic grid: resolution -> hexagon width in degrees, rows before wrapping.
GRID = {
    11: (0.0005, 80000),
    10: (0.00132, 30000),
    9: (0.0035, 11400),
    8: (0.00926, 4300),
    7: (0.0245, 1630),
    6: (0.0648, 610),
}
GRID_COLUMNS = 64
CORNERS = [(0.49, 0.0), (0.245, 0.424), (-0.245, 0.424), (-0.49, 0.0), (-0.245, -0.424), (0.245, -0.424)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell rows with hierarchy; several rows can share a cell, and some attributes have nulls."""
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) % F.lit(CELLS_UNDER_ROOT)
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        cellid.child_at(F.lit(ROOT_CELL).cast("long"), number, cellid.FINEST).alias("r11_id"),
        number.alias("n"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        F.when(line != 7, F.col("l_tax")).alias("tax"),
        F.when(line != 6, F.col("l_discount") > 0.05).alias("discounted"),
        F.when(line != 5, F.col("l_returnflag")).alias("flag"),
    )
    finest = F.col("r11_id")
    parents = [cellid.cell_to_parent(finest, r, checked=False).alias(f"r{r}_id") for r in range(10, 3, -1)]
    rest = [c for c in rows.columns if c != "r11_id"]
    return rows.select("r11_id", *parents, cellid.cell_to_string(finest).alias("id"), *rest)


def grid_number(cell):
    """Place of a cell among all cells of its resolution: its base-8 digits read in base 7."""
    digits = cell.bitwiseAND(F.lit((1 << 45) - 1).cast("long"))
    used = F.call_function("shiftright", digits, F.lit(3) * (F.lit(15) - cellid.resolution(cell)))
    return F.conv(F.conv(used.cast("string"), 10, 8), 7, 10).cast("long")


def cell_geometry(hexes: DataFrame) -> DataFrame:
    """``(id, resolution, lon, lat, ring)`` of every hexagon ``(id, resolution)``."""
    widths = F.create_map(*(F.lit(v) for res, (width, _) in GRID.items() for v in (res, width)))
    heights = F.create_map(*(F.lit(v) for res, (_, rows) in GRID.items() for v in (res, rows)))
    numbered = hexes.select(
        "id",
        "resolution",
        widths[F.col("resolution")].alias("w"),
        heights[F.col("resolution")].cast("long").alias("rows"),
        grid_number(F.col("id")).alias("idx"),
    )
    across = F.lit(GRID_COLUMNS).cast("long")
    row = F.call_function("div", F.col("idx"), across) % F.col("rows")
    centred = numbered.select(
        "id",
        "resolution",
        "w",
        (-82.0 + (F.col("idx") % across + 0.503) * F.col("w")).alias("lon"),
        (24.5 + (row + 0.507) * F.col("w")).alias("lat"),
    )
    corner = [
        F.struct(
            (F.col("lon") + F.col("w") * dx).alias("lon"), (F.col("lat") + F.col("w") * dy).alias("lat")
        )
        for dx, dy in CORNERS
    ]
    return centred.select("id", "resolution", "lon", "lat", F.array(*corner).alias("ring"))


def coarse_attributes(cell_rows: DataFrame) -> DataFrame:
    """Attributes of resolution-9 hexagons, some of the hexagons missing."""
    return (
        cell_rows.where("shiftright(r9_id, 18) % 3 <> 0")
        .groupBy("r9_id")
        .agg(F.min("l_extendedprice").alias("q"), F.max("flag").alias("f"))
        .select(cellid.cell_to_string(F.col("r9_id")).alias("id"), "q", "f")
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/hexloom-{uuid.uuid4().hex}"


_stored: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> DataFrame:
    """A table that ``write`` puts into a folder once per session and data folder, when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        folder = f"{shared_folder(spark)}/{name}"
        write(folder)
        _stored[key] = folder
    return spark.read.parquet(_stored[key])


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "cells", lambda folder: write_cells(cells(spark, sf_dir), folder))


def geometry(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """The rows of :func:`stored_geometry`, for a query that reads them once: rings are long and compress badly.

    ``ordered`` sorts them by id within a partition, so that near ones lie together.
    """
    hexes = hexagons(cells(spark, sf_dir))
    return cell_geometry(hexes.sortWithinPartitions("resolution", "id") if ordered else hexes)


def stored_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "geometry", lambda folder: geometry(spark, sf_dir, ordered=True).write.parquet(folder))


def stored_tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(folder: str) -> None:
        write_tile_index(build_tile_index(stored_cells(spark, sf_dir), stored_geometry(spark, sf_dir)), folder)

    return _store(spark, sf_dir, "tiles", write)
