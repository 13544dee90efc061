"""Counts of matching cells: in total, per hexagon, per tile and for all tiles at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import cellid, tiles
from hexloom.operators.filters import Filters, apply_filters, count_matching
from hexloom.operators.joins import key_bytes, prune, scan_ranges
from hexloom.operators.layers import roll_up


def count_cells(cells: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Number of distinct finest cells that match."""
    return apply_filters(cells, filters).agg(F.count_distinct("r11_id").alias("count"))


def _grouped(cells: DataFrame, key: str, filters: Filters | None) -> DataFrame:
    return (
        cells.groupBy(F.col(key).alias("id"))
        .agg(count_matching(cells, filters).alias("count"), F.count(F.lit(1)).alias("all_count"))
        .where("count > 0")
    )


def _features(counts: DataFrame, res: int) -> DataFrame:
    return counts.select(
        cellid.cell_to_string(F.col("id")).alias("h3"),
        F.lit(True).alias("highlighted"),
        F.lit(res).alias("resolution"),
        "count",
        "all_count",
        (F.col("count") / F.col("all_count")).alias("fractionMatching"),
    )


def hex_counts(cells: DataFrame, resolution: int, filters: Filters | None = None) -> DataFrame:
    """Matching and all rows per hexagon of one stored resolution, hexagons with a match only."""
    key = f"r{resolution}_id"
    return _features(_grouped(cells.where(F.col(key).isNotNull()), key, filters), resolution)


def _tile_rows(tile_index: DataFrame, z: int, x: int, y: int) -> DataFrame:
    prefix = tiles.tile_quadkey(z, x, y)
    rows = tile_index.where(F.col("resolution") == tiles.resolution_for_zoom(z))
    return rows.where(F.col("geohash").startswith(prefix)).select("id")


def tile_members(tile_index: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Hexagons drawn in a tile: those whose index rows lie under its quadkey."""
    return _tile_rows(tile_index, z, x, y).distinct()


def tile_counts(
    cells: DataFrame, tile_index: DataFrame, z: int, x: int, y: int, filters: Filters | None = None
) -> DataFrame:
    """Counts per hexagon of one tile.

    A tile with few index rows prunes the cells first: broadcast semi-join, plus id ranges that skip
    Parquet row groups of clustered cells.  A tile with many (the low zooms of a large table)
    is grouped first, so what meets the members is one row per hexagon, never raw rows.
    """
    res = tiles.resolution_for_zoom(z)
    key = f"r{res}_id"
    members = _tile_rows(tile_index, z, x, y)
    rows, ranges = scan_ranges(members)
    if key_bytes(rows).fits():
        wanted = F.broadcast(members.withColumnRenamed("id", key))
        inside = prune(cells, ranges).join(wanted, key, "left_semi")
        counts = _grouped(inside, key, filters)
    else:
        counts = _grouped(cells, key, filters).join(members, "id", "left_semi")
    return _features(counts, res)


def tile_pyramid(cells: DataFrame, tile_index: DataFrame, filters: Filters | None = None) -> DataFrame:
    """:func:`tile_counts` of every tile of every zoom 0..14, keyed by ``(z, quadkey)``.

    Cells are counted once and rolled up, then meet the index on the hexagon id; a tile is a prefix
    of the index path taken by equality, not by LIKE.  No step groups by tile, so the one tile of
    zoom 0 is no hot key.
    """
    per_cell = (
        cells.where(F.col("r11_id").isNotNull())
        .groupBy("r11_id")
        .agg(count_matching(cells, filters).alias("count"), F.count(F.lit(1)).alias("all_count"))
    )
    counts = roll_up(per_cell, ["count", "all_count"]).where("count > 0").select("id", "count", "all_count")
    res = F.col("resolution")
    first = F.lit(0)
    for stop, (low, _) in tiles.zoom_bands().items():
        first = F.when(res == stop, low).otherwise(first)
    zooms = F.sequence(first, tiles.resolution_to_zoom(res))
    # the join leaves rows hashed by id, so the deduplication adds no shuffle
    return (
        counts.join(tile_index.select("id", "resolution", "geohash"), "id")
        .select("*", F.explode(zooms).alias("z"))
        .select("id", "resolution", "count", "all_count", "z", F.expr("substring(geohash, 1, z)").alias("quadkey"))
        .distinct()
        .select(
            "z",
            "quadkey",
            cellid.cell_to_string(F.col("id")).alias("h3"),
            "resolution",
            "count",
            "all_count",
            (F.col("count") / F.col("all_count")).alias("fractionMatching"),
        )
    )
