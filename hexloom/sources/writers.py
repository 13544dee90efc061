"""Stored tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import cellid, geometry
from hexloom.operators.profile import BUCKET_TYPE, EMPTY_BREAKS

STORED_LEVELS = [f"r{res}_id" for res in range(11, 3, -1)]

_STATS = ", ".join(
    ["avg:double", "stddev_samp:double", "stddev_pop:double", "stdev:double"]
    + [f"{name}:{BUCKET_TYPE}" for name in EMPTY_BREAKS]
    + [f"histogram:{BUCKET_TYPE}"]
)
ATTRIBUTES_SCHEMA = (
    "position int, key string, attribute string, type string, count long, countDistinct long, min double, "
    f"max double, values map<string,long>, stats struct<{_STATS}>, version long"
)
VALUES_SCHEMA = "attribute string, value string, count long"


#: Rows of one ancestor of this resolution go to one task, unless they are too many.
PLACED_RESOLUTION = 7
#: Rows in a Parquet page: range predicates skip pages within a row group.
PAGE_ROWS = 1024
#: Paths of the index are placed by all their digits but the last so many.
PLACED_DIGITS = 8


def _placed(rows: DataFrame, keys: list[Column], partitions: int | None = None) -> DataFrame:
    """Rows of equal keys brought together without a sampling pass.

    The shuffle is a rebalance: AQE splits the tasks of frequent keys and merges small ones. Where a row goes depends on
    its own values, so a repeated task writes equal rows.
    """
    names = {f"_place{k}": key for k, key in enumerate(keys)}
    return rows.withColumns(names).hint("rebalance", *([partitions] if partitions else []), *names)


def write_cells(cells: DataFrame, path: str, partitions: int | None = None) -> None:
    """Cells as Parquet clustered by ``r11_id``.

    Ids sort by place, so each page covers a narrow id range at every stored level and range predicates skip the others.
    The input is computed once.
    """
    family = cellid.cell_to_parent(F.col("r11_id"), PLACED_RESOLUTION, checked=False)
    placed = _placed(cells, [family], partitions).sortWithinPartitions("r11_id").select(cells.columns)
    placed.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def ordered_index(tile_index: DataFrame) -> DataFrame:
    """Index rows brought together by resolution and area and sorted by quadkey."""
    area = F.expr(f"substring(geohash, 1, length(geohash) - {PLACED_DIGITS})")
    return _placed(tile_index, [F.col("resolution"), area]).sortWithinPartitions("resolution", "geohash", "id").select(tile_index.columns)


def write_tile_index(tile_index: DataFrame, path: str) -> None:
    """Tile index as Parquet, one folder per resolution, sorted by quadkey for prefix skipping; computed once."""
    ordered_index(tile_index).write.mode("overwrite").partitionBy("resolution").parquet(path)


def write_cell_pyramid(layers: DataFrame, path: str, placed: bool = False) -> None:
    """Hexagon layers as Parquet, one folder per resolution, its rows brought together by their area.

    ``placed`` says that they are already, as those of ``build_cell_pyramid`` with geometry; their texts aren't moved then.
    """
    if not placed:
        layers = _placed(layers, [F.col("resolution"), F.col("r5_id")]).sortWithinPartitions("resolution", "id").select(layers.columns)
    layers.write.mode("overwrite").option("compression", "zstd").partitionBy("resolution").parquet(path)


def export_csv(cells: DataFrame, path: str) -> None:
    """Cells without their hierarchy columns, as CSV with a header."""
    cells.drop(*STORED_LEVELS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_joined_csv(joined: DataFrame, path: str) -> None:
    """Joined fine cells: ``id`` first, then the attributes."""
    attributes = [F.col(f"`{c}`") for c in joined.columns if c != "id"]
    joined.select("id", *attributes).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_id_list(ids: DataFrame, path: str) -> None:
    ids.select("id").write.mode("overwrite").text(path)


def write_profile(attributes: DataFrame, values: DataFrame, path: str) -> None:
    """Profile as JSON lines: one object per attribute, and all value frequencies beside them."""
    attributes.write.mode("overwrite").json(f"{path}/attributes", ignoreNullFields=False)
    values.write.mode("overwrite").json(f"{path}/values")


def geojson_features(features: DataFrame, cell_geometry: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per counted hexagon (``h3`` and the count columns).

    ``cell_geometry`` has the text id ``h3`` and the ``ring``; a hexagon without one fails the job.
    """
    located = features.join(cell_geometry.select("h3", "ring"), "h3", "left").withColumn("ring", geometry.required_ring("h3"))
    properties = F.struct(*(F.col(c) for c in features.columns))
    polygon = F.struct(
        F.lit("Polygon").alias("type"), geometry.ring_coordinates(F.col("ring")).alias("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), polygon.alias("geometry")
    )
    return located.select(F.to_json(feature).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """GeoJSON features, one per line; no rows give an empty collection."""
    features.select("feature").write.mode("overwrite").text(path)
