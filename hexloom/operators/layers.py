"""Hexagon layers: the cells of every drawn resolution, their rows per layer and their tile index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.functions import cellid, geometry, tiles
from hexloom.operators.joins import dealt

COARSEST_STOP = min(tiles.STOPS)
#: Hexagons of one ancestor of this resolution and of one layer lie in one task: at most 7^6.
AREA_RESOLUTION = 5


def roll_up(per_cell: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """One row per hexagon of every stop resolution, from one row per finest cell (``r11_id``).

    The finest cells are shuffled once by their coarsest drawn ancestor.  All resolutions of a
    family then lie in one partition and are grouped there without further shuffles; a family has at
    most 7^5 cells, so no key is large however skewed the source rows were.
    """
    cell = F.col("r11_id")
    levels = F.array(
        *(
            F.struct(
                F.lit(res).alias("resolution"), cellid.cell_to_parent(cell, res, checked=False).alias("id")
            )
            for res in tiles.STOPS
        )
    )
    families = per_cell.withColumn("family", cellid.cell_to_parent(cell, COARSEST_STOP, checked=False))
    rows = dealt(families, "family").select("family", *sums, F.inline(levels))
    if not sums:
        return rows.distinct().select("id", "resolution")
    groups = rows.groupBy("family", "id", "resolution")
    return groups.agg(*(F.sum(c).alias(c) for c in sums)).select("id", "resolution", *sums)


def hexagons(cells: DataFrame) -> DataFrame:
    """Distinct hexagons ``(id, resolution)`` of every stop that hold at least one cell."""
    return roll_up(cells.select("r11_id").where(F.col("r11_id").isNotNull()).distinct())


def build_cell_pyramid(ids: DataFrame, cell_geometry: DataFrame | None = None) -> DataFrame:
    """Layers of all stops from finest cell ids (text column ``id``).

    Each row has its id, resolution and ``r0_id`` .. ``r11_id`` as text, finer ones NULL, and with
    ``cell_geometry(id, ring)`` its polygon as WKT; those rows are placed by area and sorted by resolution and id, as the
    store of layers wants them, before their long texts are made.
    """
    text = F.col("id")
    cell = cellid.string_to_cell(text)
    fits = cellid.is_valid_cell(cell) & (cellid.resolution(cell) == cellid.FINEST)
    problem = F.raise_error(F.concat(F.lit("not a finest cell id: "), F.coalesce(text, F.lit("NULL"))))
    checked = ids.select(F.when(fits, cell).otherwise(problem.cast("long")).alias("r11_id"))
    layers = roll_up(checked.distinct())
    parents = [
        cellid.cell_to_string(cellid.cell_to_parent(F.col("id"), res)).alias(f"r{res}_id")
        for res in range(cellid.FINEST + 1)
    ]
    if cell_geometry is None:
        return layers.select(cellid.cell_to_string(F.col("id")).alias("id"), "resolution", *parents)
    located = _in_areas(layers, cell_geometry).withColumn("ring", geometry.required_ring("id"))
    return located.select(
        cellid.cell_to_string(F.col("id")).alias("id"),
        "resolution",
        *parents,
        geometry.ring_to_wkt(F.col("ring")).alias("wkt"),
    )


def _in_areas(hexes: DataFrame, cell_geometry: DataFrame) -> DataFrame:
    """Hexagons ``(id, resolution, ring)`` joined with their geometry (one without has a NULL ring), placed and sorted.

    Rings move once, to the task of their area. There both tables lie sorted by id, and a window over the rows of an id
    does what a join would, which would deal rows out by id first.
    """
    # longitudes and latitudes move apart, which takes less room; a ring with a point that is NULL moves as it is
    point = lambda p: F.when(p.isNotNull(), F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    odd = F.when(F.exists("ring", lambda p: p.isNull()), F.transform("ring", point))
    known = cell_geometry.where(F.col("id").isNotNull()).select(
        "id", F.col("ring.lon").alias("lons"), F.col("ring.lat").alias("lats"), odd.alias("odd"), F.lit(False).alias("wanted")
    )
    nothing = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("lons", "lats", "odd")]
    both = known.unionAll(hexes.select("id", *nothing, F.lit(True).alias("wanted")))
    keys = {"resolution": cellid.resolution(F.col("id")), "area": cellid.cell_to_parent(F.col("id"), AREA_RESOLUTION, checked=False)}
    same = Window.partitionBy(*keys, "id")
    met = dealt(both.withColumns(keys), *keys).select(
        "*", F.max("wanted").over(same).alias("is_wanted"), F.min("wanted").over(same).alias("is_missing")
    )
    # the sort is that of the window; it is named so that what is written needs no other
    ordered = met.where(F.when(F.col("wanted"), F.col("is_missing")).otherwise(F.col("is_wanted"))).sortWithinPartitions(*keys, "id")
    ring = F.coalesce("odd", F.zip_with("lons", "lats", lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))))
    return ordered.select("id", "resolution", ring.alias("ring"))


def _boxes(polygons: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep``, the ring's longitudes and latitudes and the range of tiles of its box, from ``(zoom, ring)``."""
    across, lons, lats = F.col("across"), F.col("lons"), F.col("lats")
    points = polygons.select(
        *keep,
        tiles.tiles_across(F.col("zoom")).alias("across"),
        tiles.unwrap_longitudes(F.col("ring.lon")).alias("lons"),
        F.col("ring.lat").alias("lats"),
    )

    def row(lat):
        inside = F.greatest(F.lit(0.0), F.least(across - 1, tiles.lat_to_tile(lat, across)))
        return F.floor(inside).cast("long")

    return points.select(
        *keep,
        "across",
        "lons",
        "lats",
        F.floor(tiles.lon_to_tile(F.array_min(lons), across)).cast("long").alias("x0"),
        F.floor(tiles.lon_to_tile(F.array_max(lons), across)).cast("long").alias("x1"),
        row(F.array_max(lats)).alias("y0"),
        row(F.array_min(lats)).alias("y1"),
    )


def _alone() -> Column:
    """Whether a box lies in one tile."""
    return (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))


def _tile_path(x: Column, y: Column) -> Column:
    return tiles.quadkey(F.pmod(x, F.col("across").cast("long")), y, F.col("zoom"))


def tile_cover(polygons: DataFrame) -> DataFrame:
    """Tiles touched by convex rings: input ``(id, resolution, zoom, ring)``, one output row per tile.

    The tile range comes from the ring's box in plain generated code.  A hexagon inside one tile,
    nearly all of them, is done then; only the others build edges for the exact test.  A column
    ``tile``, if there is one, holds that one tile where it is known already, and no ring is read.
    """
    keep = ["id", "resolution", "zoom"]
    known = F.col("tile") if "tile" in polygons.columns else F.lit(None).cast("string")
    across, lons, lats = F.col("across"), F.col("lons"), F.col("lats")
    box = ["x0", "x1", "y0", "y1"]
    boxes = _boxes(polygons.withColumn("tile", known), [*keep, "tile"]).withColumns(
        {c: F.when(F.col("tile").isNotNull(), F.lit(0).cast("long")).otherwise(F.col(c)) for c in box}
    )
    in_tiles = F.when(~_alone(), tiles.to_tile_space(lons, lats, across)).alias("points")
    edged = boxes.select(*keep, "tile", "across", *box, in_tiles).select(
        *keep, "tile", "across", *box, tiles.ring_edges(F.col("points")).alias("edges")
    )
    turned = edged.select("*", tiles.ring_turn(F.col("edges")).alias("turn"))
    candidates = turned.select("*", F.explode(F.sequence("x0", "x1")).alias("x")).select(
        "*", F.explode(F.sequence("y0", "y1")).alias("y")
    )
    touched = candidates.where(
        F.col("edges").isNull() | tiles.touches_tile(F.col("edges"), F.col("turn"), F.col("x"), F.col("y"))
    )
    return touched.select(F.coalesce("tile", _tile_path(F.col("x"), F.col("y"))).alias("geohash"), *keep)


def cover_hexagons(hexes: DataFrame, cell_geometry: DataFrame) -> DataFrame:
    """:func:`tile_cover` of hexagons ``(id, resolution)`` by their rings; one without a ring fails the job.

    A ring inside one tile is replaced by that tile before it is shuffled, so few rings move.
    """
    zoomed = cell_geometry.select("id", tiles.resolution_to_zoom(cellid.resolution(F.col("id"))).alias("zoom"), "ring")
    boxes = _boxes(zoomed, ["id", "zoom", "ring"])
    one = F.coalesce(_alone(), F.lit(False))
    narrow = boxes.select("id", F.when(one, _tile_path(F.col("x0"), F.col("y0"))).alias("tile"), F.when(~one, F.col("ring")).alias("ring"))
    located = hexes.join(dealt(narrow, "id"), "id", "left").withColumn(
        "ring", F.when(F.col("tile").isNull(), geometry.required_ring("id"))
    )
    return tile_cover(located.withColumn("zoom", tiles.resolution_to_zoom(F.col("resolution"))))


def build_tile_index(cells: DataFrame, cell_geometry: DataFrame) -> DataFrame:
    """Tile index ``(geohash, id, resolution, zoom)``: for every stop, the tiles of the stop's zoom
    that each occupied hexagon touches.

    ``cell_geometry`` has one row per hexagon of any resolution, ``(id LONG, ring)``.  All stops share
    one join: the id already says the resolution.  A hexagon without geometry fails the job.
    """
    return cover_hexagons(hexagons(cells), cell_geometry)
