"""Selections of cells: mixed-resolution id lists and polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import cellid, geometry
from hexloom.operators.joins import key_bytes, prune, scan_ranges

COARSEST_STORED = 4


def as_ids(cells: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Selected ids as a DataFrame with one text column ``id``."""
    if isinstance(ids, DataFrame):
        return ids.select("id")
    if not ids:
        raise ValueError("a selection needs at least one cell id")
    return cells.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def _distinct_cells(ids: DataFrame) -> DataFrame:
    return ids.select(cellid.string_to_cell(F.col("id")).alias("id")).distinct()


def _describe(selected: DataFrame) -> dict[int, int]:
    """How many ids each resolution has (at most sixteen numbers). An invalid id is an error."""
    cell = F.col("id")
    counts = selected.groupBy(cellid.resolution(cell).alias("res")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~cellid.is_valid_cell(cell)).alias("invalid")
    )
    found = counts.collect()
    if any(row["invalid"] for row in found):
        raise ValueError(f"invalid cell ids in the selection: {sum(row['invalid'] for row in found)}")
    return {row["res"]: row["rows"] for row in found}


def _check_resolutions(rows: dict[int, int], finest: int) -> None:
    if rows and max(rows) > finest:
        raise ValueError(f"selected ids of resolution {max(rows)} are finer than {finest}")


def _ancestor(res: int, stored: Sequence[str]) -> Column:
    name = f"r{res}_id"
    return F.col(name) if name in stored else cellid.cell_to_parent(F.col("r11_id"), res)


def _with_hits(cells: DataFrame, selected: DataFrame, rows: dict[int, int]) -> DataFrame:
    """Rows of ``cells`` whose ancestor at any selected resolution is selected.

    One left join per resolution on distinct ids, so rows cannot multiply.  An id tells its
    resolution, so a selection that fits as a whole is broadcast once and probed for each.
    """
    whole = key_bytes(sum(rows.values())).fits()
    flagged, extra = cells, []
    for res, count in sorted(rows.items()):
        key, flag = f"_anc{res}", f"_hit{res}"
        wanted = selected if whole else selected.where(cellid.resolution(F.col("id")) == res)
        wanted = wanted.select(F.col("id").alias(key), F.lit(True).alias(flag))
        if key_bytes(count).fits():
            wanted = F.broadcast(wanted)
        flagged = flagged.withColumn(key, _ancestor(res, cells.columns)).join(wanted, key, "left")
        extra += [key, flag]
    hit = F.coalesce(*(F.col(name) for name in extra if name.startswith("_hit")), F.lit(False))
    return flagged.where(hit).drop(*extra)


def select_cells_compact(
    cells: DataFrame, ids: DataFrame | Sequence[str], resolution: int = cellid.FINEST
) -> DataFrame:
    """Cells under any of the given ids of mixed resolutions, without expanding them.

    Ids finer than ``resolution`` are an error.  The scan is cut to the id ranges of the selection.
    While every resolution's id set is small the cells are only filtered, no shuffle.  With larger sets the decision is made on the distinct cell
    ids alone, and the wide rows meet the result in one semi-join.
    """
    selected = _distinct_cells(as_ids(cells, ids))
    rows = _describe(selected)
    _check_resolutions(rows, resolution)
    if not rows:
        return cells.where(F.lit(False))
    cells = prune(cells, scan_ranges(selected)[1])
    if len(rows) == 1 and key_bytes(*rows.values()).fits():
        (res,) = rows
        if f"r{res}_id" in cells.columns:
            wanted = selected.withColumnRenamed("id", f"r{res}_id")
            return cells.join(F.broadcast(wanted), f"r{res}_id", "left_semi").select(cells.columns)
    if all(key_bytes(count).fits() for count in rows.values()):
        return _with_hits(cells, selected, rows).select(cells.columns)
    stored = [f"r{res}_id" for res in rows if f"r{res}_id" in cells.columns]
    narrow = cells.select(*{"r11_id", *stored}).distinct()
    hits = _with_hits(narrow, selected, rows).select("r11_id")
    return cells.join(hits, "r11_id", "left_semi").select(cells.columns)


def _drop_covered(selected: DataFrame, rows: dict[int, int]) -> DataFrame:
    """Selected ids without those that lie under another selected id."""
    cell, kept = F.col("id"), selected
    for res in sorted(rows)[:-1]:
        coarse = selected.where(cellid.resolution(cell) == res).select(cell.alias("above"))
        if key_bytes(rows[res]).fits():
            coarse = F.broadcast(coarse)
        # ids that are not finer get a key that matches nothing and is spread, unlike NULL
        above = F.when(cellid.resolution(cell) > res, cellid.cell_to_parent(cell, res)).otherwise(-cell)
        kept = kept.withColumn("above", above).join(coarse, "above", "left_anti").drop("above")
    return kept


def uncompact_cells(ids: DataFrame, resolution: int = cellid.FINEST) -> DataFrame:
    """All descendants at ``resolution`` of the given ids (text column ``id``), as a set of LONG ids.

    Expansion goes down at most four levels per step and spreads the rows between steps, so one
    coarse id never has to grow to its 7^11 cells inside one task or one array.
    """
    cell = F.col("id")
    own = cellid.resolution(cell)
    selected = _distinct_cells(ids)
    rows = _describe(selected)
    _check_resolutions(rows, resolution)
    current = _drop_covered(selected, rows)
    for target in [r for r in (4, 8) if r < resolution] + [resolution]:
        last = F.when(own < target, cellid.child_count(cell, target) - 1).otherwise(F.lit(0).cast("long"))
        numbered = current.select("id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
        child = F.when(own < target, cellid.child_at(cell, F.col("number"), target)).otherwise(cell)
        below = numbered.select(cellid.is_pentagon_base(cell).alias("pentagon"), child.alias("id"))
        current = below.where(~(F.col("pentagon") & cellid.in_deleted_sector(cell))).select("id")
        if target < resolution:
            current = current.repartition("id")
    return current


def cells_in_polygon(centers: DataFrame, polygon) -> DataFrame:
    """Rows of ``centers`` (LONG ``id``, ``lon``, ``lat``) whose point lies in the polygon.

    ``polygon`` is GeoJSON (text or dict) or a list of rings; further rings are holes.
    """
    rings = geometry.polygon_rings(polygon)
    return centers.where(geometry.in_polygon(rings, F.col("lon"), F.col("lat")))


def select_cells_polygon(
    cells: DataFrame, centers: DataFrame, polygon, resolution: int = cellid.FINEST
) -> DataFrame:
    """Cells whose hexagon at ``resolution`` has its centre in the polygon.

    ``centers`` may hold several resolutions; those of the wanted one are used.
    """
    key = f"r{resolution}_id"
    wanted = centers.where(cellid.resolution(F.col("id")) == resolution)
    inside = cells_in_polygon(wanted, polygon).select("id").distinct()
    count, ranges = scan_ranges(inside)
    inside = inside.withColumnRenamed("id", key)
    if key_bytes(count).fits():
        inside = F.broadcast(inside)
    return prune(cells, ranges).join(inside, key, "left_semi").select(cells.columns)


def select_cells(cells: DataFrame, *, ids=None, feature=None, centers: DataFrame | None = None) -> DataFrame:
    """Selection of a statistics request: ``ids`` when given, else the polygon ``feature``."""
    if ids is not None:
        return select_cells_compact(cells, ids)
    if feature is None:
        raise ValueError("give ids or feature")
    if centers is None:
        raise ValueError("a polygon selection needs the cell centres")
    return select_cells_polygon(cells, centers, feature)


__all__ = [
    "as_ids",
    "cells_in_polygon",
    "select_cells",
    "select_cells_compact",
    "select_cells_polygon",
    "uncompact_cells",
]
