"""Containment of cell centres in a table of polygons.

A polygon is covered by map tiles, coarse ones first: a tile that no edge touches lies inside or outside as a whole, the
others are split until the finest level. Inner tiles of any level and finest border tiles meet the centres by an
equi-join on the tile path; only centres in border tiles are tested, against the few edges that matter in their tile.

Pairs of centres and polygons grow with the product of both tables, so what is done for a pair is generated code over
plain columns, and tiles are cut by what they hold: none without a centre is kept, border ones with many centres are cut
once more, and inner ones with very many are dealt out as their children.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import tiles
from hexloom.operators.joins import Size, dealt, lookup_side

#: Zooms at which tiles are decided; a border tile has 64 children on the next one.
LEVELS = (2, 5, 8, 11, 14)
#: Border tiles of the last level are cut into those of this zoom where they hold many centres.
CLOSE = 16
#: From more centres on cutting a border tile costs less than testing them all: by edges in columns, or one after the other.
BORDER_CENTRES, SLOW_CENTRES = 1 << 15, 250
#: An inner tile of more centres is replaced by its children, so that no key has too many pairs.
INNER_CENTRES = 1 << 15
#: A border tile of up to so many edges has them as columns.
MOST_EDGES = 8
#: A polygon whose box reaches over up to so many tiles each way on a level isn't decided on coarser ones.
FIRST_TILES = 4
ENDS = ("x1", "y1", "x2", "y2")
#: Tiles are taken larger by so many degrees, against rounding at their borders.
MARGIN = 1e-9


def _edges(rings: Column) -> Column:
    def of_ring(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.struct(*(c.alias(end) for c, end in zip((a["lon"], a["lat"], b["lon"], b["lat"]), ENDS))),
        )

    return F.flatten(F.transform(rings, of_ring))


def crosses(edge: Column, lon: Column, lat: Column) -> Column:
    """Whether a ray to the east crosses the edge."""
    x = (edge["x2"] - edge["x1"]) * F.try_divide(lat - edge["y1"], edge["y2"] - edge["y1"]) + edge["x1"]
    return ((edge["y1"] > lat) != (edge["y2"] > lat)) & (lon < x)


def _odd(edges: Column, start: Column, lon: Column, lat: Column) -> Column:
    return F.aggregate(edges, start, lambda inside, e: inside != F.coalesce(crosses(e, lon, lat), F.lit(False)))


def _prepared(polygons: DataFrame) -> DataFrame:
    """polygon_id, wraps, edges and box of each polygon, unwrapped over the antimeridian."""
    rings = F.col("rings")
    few = F.exists(rings, lambda ring: F.coalesce(F.size(F.array_distinct(ring)) < 3, F.lit(True)))
    problem = F.raise_error(F.concat(F.lit("a ring needs three distinct points, polygon "), F.coalesce(F.col("polygon_id").cast("string"), F.lit("NULL"))))
    checked = polygons.where(rings.isNotNull() & (F.size(rings) > 0)).where(F.when(few, problem.cast("boolean")).otherwise(F.lit(True)))
    raw = checked.select("polygon_id", "rings", F.exists(_edges(rings), lambda e: F.abs(e["x1"] - e["x2"]) > 180.0).alias("wraps"))
    east = F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(F.when(F.col("wraps") & (p["lon"] < 0.0), p["lon"] + 360.0).otherwise(p["lon"]).alias("lon"), p["lat"].alias("lat"))
        ),
    )
    # an edge's box beside it, as each level looks at it again
    sides = {"west": F.least, "east": F.greatest, "south": F.least, "north": F.greatest}
    boxed = F.transform(
        _edges(east),
        lambda e: F.struct(*(e[end].alias(end) for end in ENDS), *(pick(*(e[end] for end in (ENDS[k // 2 :: 2]))).alias(side) for k, (side, pick) in enumerate(sides.items()))),
    )
    edged = raw.select("polygon_id", "wraps", boxed.alias("edges"))
    across = F.lit(float(1 << CLOSE))

    def extreme(side: str) -> Column:
        best, margin = (F.array_min, -MARGIN) if side in ("west", "south") else (F.array_max, MARGIN)
        return best(F.transform("edges", lambda e: e[side])) + margin

    placed = edged.select(
        "*",
        F.floor(tiles.lon_to_tile(extreme("west"), across)).cast("long").alias("x0"),
        F.floor(tiles.lon_to_tile(extreme("east"), across)).cast("long").alias("x1"),
        _row(extreme("north")).alias("y0"),
        _row(extreme("south")).alias("y1"),
    )
    start = F.lit(None).cast("int")
    for zoom in LEVELS:
        within = [F.shiftright(f"{axis}1", CLOSE - zoom) - F.shiftright(f"{axis}0", CLOSE - zoom) < FIRST_TILES for axis in SIDES]
        start = F.when(within[0] & within[1], F.lit(zoom)).otherwise(start)
    return placed.select("*", F.coalesce(start, F.lit(LEVELS[0])).alias("start"))


def _row(lat: Column) -> Column:
    """Tile row of a latitude on the closest zoom; beyond the map's edge the first or the last one."""
    across = 1 << CLOSE
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(across - 1).cast("long"), F.floor(tiles.lat_to_tile(lat, F.lit(float(across)))).cast("long")))


BOX = ["start", "x0", "x1", "y0", "y1"]


def _lat_of_row(y: Column, across: int) -> Column:
    inner = F.degrees(F.atan(F.sinh(F.pi() * (1.0 - y * (2.0 / across)))))
    return F.when(y <= 0, 90.0).when(y >= across, -90.0).otherwise(inner)


def _bounds(axis: str, tile: Column, zoom: int) -> list[Column]:
    """The least and the largest longitude or latitude of a tile, with the margin."""
    across, place = 1 << zoom, tile.cast("double")
    if axis == "x":
        return [place * (360.0 / across) - (180.0 + MARGIN), (place + 1) * (360.0 / across) - (180.0 - MARGIN)]
    return [_lat_of_row(place + 1, across) - MARGIN, _lat_of_row(place, across) + MARGIN]


SIDES = {"x": ("west", "east"), "y": ("south", "north")}


def _split(rows: DataFrame, zoom: int, before: int) -> DataFrame:
    """Tiles marked ``cut`` as those of this zoom, as far as the polygon's box reaches; the others stay as they are.

    Polygons that start here have no tile yet: x and y are NULL. Bounds are output of the generator, so that no later
    condition works them out again for every edge.
    """
    shift = CLOSE - zoom
    for axis, sides in SIDES.items():
        low, high = (F.shiftright(f"{axis}{k}", shift) for k in (0, 1))
        parts = 1 << (zoom - before)
        low, high = F.greatest(low, F.col(axis) * parts), F.least(high, F.col(axis) * parts + (parts - 1))
        cut = F.transform(F.sequence(low, high), lambda t: F.struct(t.alias(axis), *(b.alias(side) for b, side in zip(_bounds(axis, t, zoom), sides))))
        cut = F.when(F.col("cut"), cut).otherwise(F.array(F.struct(axis, *sides)))
        rows = rows.select(*[c for c in rows.columns if c not in (axis, *sides)], F.inline(cut))
    own = tiles.quadkey(F.pmod(F.col("x"), F.lit(1 << zoom).cast("long")), F.col("y"), zoom)
    return rows.withColumn("path", F.when(F.col("cut"), own).otherwise(F.col("path")))


def _decided(rows: DataFrame) -> DataFrame:
    """Rows (polygon_id, wraps, x, y, edges, odd, inner, path) without outer tiles; inner ones have no edges.

    For a point in a tile, odd and the crossings of its edges together tell whether it lies inside. An edge that every
    ray out of the tile crosses goes into odd, one that none crosses is dropped.
    """
    west, east, south, north = (F.col(c) for c in ("west", "east", "south", "north"))

    def in_band(e: Column) -> Column:
        return (e["north"] > south) & (e["south"] <= north) & (e["east"] >= west)

    def always(e: Column) -> Column:
        return (e["west"] > east) & (e["south"] <= south) & (e["north"] > north)

    def touches(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        (a, b), (c, d) = [dx * (cy - e["y1"]) for cy in (south, north)], [dy * (cx - e["x1"]) for cx in (west, east)]
        return (e["west"] <= east) & (F.least(a, b) <= F.greatest(c, d)) & (F.greatest(a, b) >= F.least(c, d))

    open_ = F.col("cut") & ~F.col("inner")
    kept = ["polygon_id", "wraps", *BOX, "x", "y", "west", "east", "south", "north", "path", "inner", "cut", *(c for c in rows.columns if c == "n")]
    near = rows.select(*kept, "odd", _once(F.when(open_, F.filter("edges", in_band)).otherwise(F.col("edges")).alias("edges")))
    fewer = near.select(
        *kept,
        _once(
            (F.col("odd") != (open_ & (F.size(F.filter("edges", always)) % 2 == 1))).alias("odd"),
            F.when(open_, F.filter("edges", lambda e: ~always(e))).otherwise(F.col("edges")).alias("edges"),
        ),
    )
    inside = _odd(F.col("edges"), F.col("odd"), (west + east) / 2, (south + north) / 2)
    state = (
        F.when(F.col("inner"), F.lit("inner"))
        .when(~F.col("cut") | F.exists("edges", touches), F.lit("border"))
        .when(inside, F.lit("inner"))
        .otherwise(F.lit("outer"))
    )
    judged = fewer.select(*kept, "edges", "odd", _once(state.alias("state"))).where("state <> 'outer'")
    border = F.when(F.col("state") == "border", F.col("edges")).alias("edges")
    return judged.select(*(c for c in kept if c not in ("inner", "cut")), border, "odd", (F.col("state") == "inner").alias("inner"))


def _once(*columns: Column) -> Column:
    """Columns as output of a generator, so that conditions on them don't work them out a second time."""
    return F.inline(F.array(F.struct(*columns)))


def _cover(polygons: DataFrame, occupied: DataFrame | None = None, size: Size | None = None) -> DataFrame:
    """Tiles of each polygon, cut and dropped by the centres in them where ``occupied`` (path, n) is given."""
    # polygons are few rows with much work each: a given number of partitions isn't coalesced
    spread = polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), "polygon_id")
    none = F.lit(None).cast("double")
    start = {"odd": F.lit(False), "inner": F.lit(False), "path": none.cast("string"), **{axis: none.cast("long") for axis in SIDES}}
    rows = _prepared(spread).withColumns(start | {side: none for sides in SIDES.values() for side in sides})
    begun, dense = F.col("path").isNotNull(), F.lit(False)
    for before, zoom in zip((0, *LEVELS), (*LEVELS, *([CLOSE] if occupied is not None else []))):
        cut = F.when(begun, ~F.col("inner") | dense).otherwise(F.col("start") == zoom)
        if zoom == CLOSE:
            many = F.when(F.size("edges") <= MOST_EDGES, BORDER_CENTRES).otherwise(SLOW_CENTRES)
            cut = F.coalesce(F.when(F.col("inner"), dense).otherwise(F.col("n") > many), F.lit(False))
        rows = _split(rows.withColumn("cut", cut), zoom, before)
        if occupied is not None and zoom > LEVELS[0]:
            rows = _of_occupied(rows.drop("n"), occupied, size)
            dense = F.coalesce(F.col("n") > INNER_CENTRES, F.lit(False))
        rows = _decided(rows)
    return rows


def polygon_cover(polygons: DataFrame) -> DataFrame:
    """``(polygon_id, path, edges, odd, wraps)``: the tiles of each polygon, inner ones of any level with NULL edges.

    ``polygons`` has a ``polygon_id`` and ``rings``, an array of rings; all rings together count even-odd, so holes and
    several parts are possible. A polygon with an edge over more than 180 degrees crosses the antimeridian. NULL or
    no rings cover nothing; a ring of fewer than three distinct points raises an error.
    """
    plain = F.transform("edges", lambda e: F.struct(*(e[end].alias(end) for end in ENDS)))
    return _cover(polygons).select("polygon_id", "path", plain.alias("edges"), "odd", "wraps")


def _occupied(placed: DataFrame) -> DataFrame:
    """``(path, n)``: the tiles of all levels but the first that hold centres, and how many."""
    counted = placed.groupBy("finest").agg(F.count(F.lit(1)).alias("n"))
    paths = F.array(*(F.substring("finest", 1, zoom) for zoom in (*LEVELS[1:], CLOSE)))
    return counted.select(F.explode(paths).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))


def _of_occupied(rows: DataFrame, occupied: DataFrame, size: Size) -> DataFrame:
    """Tiles that hold centres, with their number; those of the first level and polygons not yet begun stay in any case."""
    spread = rows if size.fits() else dealt(rows, "path")
    found = spread.join(lookup_side(occupied, size), "path", "left")
    return found.where(F.col("n").isNotNull() | F.col("path").isNull() | (F.length("path") == LEVELS[0]))


def _near(centers: DataFrame, polygons: DataFrame) -> DataFrame:
    """Centres between the least and the largest latitude of all polygons: plain comparisons that reach the scan."""
    lats = F.flatten(F.transform("rings", lambda ring: ring["lat"]))
    bounds = polygons.select(F.array_max(lats).alias("most"), F.array_min(lats).alias("least")).agg(F.max("most").alias("most"), F.min("least").alias("least"))
    top, bottom = bounds.select(_row(F.col("most") + MARGIN), _row(F.col("least") - MARGIN)).first()
    if top is None:
        return centers.where(F.lit(False))

    def lat(y: int) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1.0 - y * (2.0 / (1 << CLOSE))))))

    if top > 0:
        centers = centers.where(F.col("lat") <= lat(top) + MARGIN)
    if bottom < (1 << CLOSE) - 1:
        centers = centers.where(F.col("lat") >= lat(bottom + 1) - MARGIN)
    return centers


def _crossable(edges: str) -> Column:
    """Edges that a ray can cross: not those without one of their ends, nor level ones."""
    whole = F.filter(edges, lambda e: e["x1"].isNotNull() & e["x2"].isNotNull() & (e["y1"] != e["y2"]))
    return F.transform(whole, lambda e: F.struct(*(e[end].alias(end) for end in ENDS)))


def _kept(cover: DataFrame) -> DataFrame:
    """The cover, computed once where there is a folder for it: it is much work for few rows, and is read twice."""
    return cover.checkpoint() if cover.sparkSession.conf.get("spark.checkpoint.dir", None) else cover


def cells_in_polygons(centers: DataFrame, polygons: DataFrame) -> DataFrame:
    """``(polygon_id, id)``: rows of ``centers`` (``id``, ``lon``, ``lat``) that lie in each polygon of a table.

    One equi-join on the tile path, the cover broadcast where its measured size allows. A centre on a border goes by
    even-odd ray casting, as in ``cells_in_polygon``. Centres without a position lie nowhere.
    """
    across = F.lit(float(1 << CLOSE))
    x = F.pmod(F.floor(tiles.lon_to_tile(F.col("lon"), across)), F.lit(1 << CLOSE).cast("long"))
    near = _near(centers.where("lon is not null and lat is not null"), polygons)
    placed = near.select("id", "lon", "lat", tiles.quadkey(x, _row(F.col("lat")), CLOSE).alias("finest"))
    occupied = _occupied(placed)
    held = occupied.count()
    cover = _kept(_cover(polygons, occupied, Size(held, 64 * held)).select("polygon_id", "path", "wraps", "inner", "odd", _once(_crossable("edges").alias("edges"))))
    zooms = (*LEVELS, CLOSE)
    more = F.coalesce(F.size("edges") > MOST_EDGES, F.lit(False))
    counts = [F.count_if(kind & (F.length("path") == zoom)) for kind in (~more, more) for zoom in zooms]
    edges, *rows = cover.agg(F.coalesce(F.sum(F.when(more, F.size("edges"))), F.lit(0)), *counts).first()
    few, many = rows[: len(zooms)], rows[len(zooms) :]
    lon = F.when(F.col("wraps") & (F.col("lon") < 0.0), F.col("lon") + 360.0).otherwise(F.col("lon"))

    def meeting(side: DataFrame, at: list[int], width: int) -> DataFrame:
        # a centre has no key of a zoom without tiles: coarse ones are few, and all centres would meet in their partitions
        keys = F.array(*(F.substring("finest", 1, zoom) for zoom, n in zip(zooms, at) if n)).cast("array<string>")
        keyed = placed.select("id", "lon", "lat", F.explode(keys).alias("path"))
        if Size(sum(at), width).fits():
            return keyed.join(F.broadcast(side), "path")
        # tiles are the streamed side: the centres of one are looked through once for each of its polygons
        return dealt(side, "path").hint("merge").join(dealt(keyed, "path"), "path")

    # an edge that isn't there is level: no ray crosses it
    points = [F.coalesce(F.get("edges", F.lit(k))[end], F.lit(0.0)).alias(f"{end}_{k}") for k in range(MOST_EDGES) for end in ENDS]
    inside = F.col("odd")
    for k in range(MOST_EDGES):
        inside = inside != crosses({end: F.col(f"{end}_{k}") for end in ENDS}, lon, F.col("lat"))
    plain = cover.where(~more).select("polygon_id", "path", "wraps", "inner", "odd", *points)
    found = meeting(plain, few, (100 + 32 * MOST_EDGES) * sum(few)).where(F.col("inner") | inside).select("polygon_id", "id")
    if not sum(many):
        return found
    # the test of any number of edges isn't generated code, so it is kept out of the way of all other tiles
    rest = meeting(cover.where(more), many, 100 * sum(many) + 48 * edges).where(_odd(F.col("edges"), F.col("odd"), lon, F.col("lat")))
    return found.unionAll(rest.select("polygon_id", "id"))


__all__ = ["cells_in_polygons", "polygon_cover"]
