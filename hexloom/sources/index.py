"""A tile index that grows by batches of cells."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.operators.joins import dealt, key_bytes, lookup_side
from hexloom.operators.layers import cover_hexagons, hexagons
from hexloom.sources.writers import ordered_index

INDEX_SCHEMA = "geohash string, id long, zoom int, resolution int, batch string"


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that ``append_tile_index`` keeps at ``path``; empty where nothing is yet."""
    try:
        rows = spark.read.schema(INDEX_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], INDEX_SCHEMA)
    return rows.select("geohash", "id", "resolution", "zoom", "batch")


def append_tile_index(cells: DataFrame, cell_geometry: DataFrame, path: str, batch: str) -> None:
    """Index the hexagons of ``cells`` that no other batch has indexed, as the given batch.

    The rows are worked out into a folder of their own first: a missing ring or a lost job fails there and leaves the
    index as it is. They then replace the partitions of this batch alone, so a batch that is run again, after a failure or
    with more cells, takes the place of its own earlier rows. ``path`` is a folder per resolution and batch.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, points, hyphens and underscores: {batch!r}")
    spark = cells.sparkSession
    known = read_tile_index(spark, path).where(F.col("batch") != batch).select("id").distinct()
    known = lookup_side(known, key_bytes(known.count()))
    fresh = dealt(hexagons(cells), "id").join(known, "id", "left_anti")
    staged = f"{path.rstrip('/')}-staged-{batch}-{uuid.uuid4().hex}"
    ordered_index(cover_hexagons(fresh, cell_geometry)).write.parquet(staged)
    rows = spark.read.parquet(staged).withColumn("batch", F.lit(batch))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resolution", "batch")
    writer.parquet(path)
