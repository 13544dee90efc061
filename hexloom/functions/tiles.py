"""Web-map tiles: zoom bands, quadkeys, tile fractions and the tiles a hexagon touches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell resolution -> deepest zoom at which it is drawn.
STOPS = {11: 14, 10: 13, 9: 12, 8: 10, 7: 8, 6: 6}

MAX_ZOOM = max(STOPS.values())
MAX_LATITUDE = 85.0511287798066


def zoom_bands() -> dict[int, tuple[int, int]]:
    """Resolution -> (first zoom, last zoom); every zoom 0..14 falls in exactly one band."""
    zooms = sorted(STOPS.values())
    return {
        res: (max((z + 1 for z in zooms if z < zoom), default=0), zoom) for res, zoom in STOPS.items()
    }


def resolution_for_zoom(zoom: int) -> int:
    """Cell resolution drawn at a zoom; deeper zooms than the last stop keep the finest cells."""
    for res, (_, last) in sorted(zoom_bands().items()):
        if zoom <= last:
            return res
    return max(STOPS)


def zoom_to_resolution(zoom: Column) -> Column:
    bands = sorted(zoom_bands().items())
    (first_res, (_, first_last)), *rest = bands
    expr = F.when(zoom <= first_last, first_res)
    for res, (_, last) in rest:
        expr = expr.when(zoom <= last, res)
    return expr.otherwise(max(STOPS)).cast("int")


def resolution_to_zoom(res: Column) -> Column:
    """Index zoom of a stop resolution, NULL for others."""
    (first_res, first_zoom), *rest = STOPS.items()
    expr = F.when(res == first_res, first_zoom)
    for stop_res, zoom in rest:
        expr = expr.when(res == stop_res, zoom)
    return expr.cast("int")


def check_tile(z: int, x: int, y: int) -> None:
    if not all(isinstance(v, int) and not isinstance(v, bool) for v in (z, x, y)):
        raise ValueError(f"tile address must be integers: {z}/{x}/{y}")
    if z < 0 or not (0 <= x < 2**z and 0 <= y < 2**z):
        raise ValueError(f"no such tile: {z}/{x}/{y}")


def tile_quadkey(z: int, x: int, y: int) -> str:
    """Quadkey of one literal tile address."""
    check_tile(z, x, y)
    return "".join(str((x >> k & 1) + 2 * (y >> k & 1)) for k in reversed(range(z)))


def quadkey(x: Column, y: Column, zoom: Column | int) -> Column:
    """Tile path of ``zoom`` digits, each being x-bit + 2 * y-bit.

    The binary digits of x and y are read as decimal numbers; adding them never carries, so one LONG
    addition forms all digits at once (enough for zoom 19).
    """
    digits = F.bin(x).cast("long") + F.bin(y).cast("long") * 2
    width = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.lpad(digits.cast("string"), width, F.lit("0"))


def tiles_across(zoom: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), zoom).cast("double")


def lon_to_tile(lon: Column, across: Column) -> Column:
    return (lon + 180.0) / 360.0 * across


def lat_to_tile(lat: Column, across: Column) -> Column:
    inside = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    s = F.sin(inside * F.pi() / 180.0)
    return (0.5 - 0.25 * F.ln((1.0 + s) / (1.0 - s)) / F.pi()) * across


def unwrap_longitudes(lons: Column) -> Column:
    """Longitudes of a ring, moved to 0..360 where the ring crosses the antimeridian."""
    wraps = F.array_max(lons) - F.array_min(lons) > 180.0
    return F.when(wraps, F.transform(lons, lambda v: F.when(v < 0.0, v + 360.0).otherwise(v))).otherwise(lons)


def to_tile_space(lons: Column, lats: Column, across: Column) -> Column:
    """Ring points as (x, y) tile fractions."""
    return F.zip_with(
        lons,
        lats,
        lambda lon, lat: F.struct(lon_to_tile(lon, across).alias("x"), lat_to_tile(lat, across).alias("y")),
    )


def ring_edges(points: Column) -> Column:
    """Edges (x, y, dx, dy) of a ring, closed whether or not the last point repeats the first."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(
        points,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")
        ),
    )


def ring_turn(edges: Column) -> Column:
    """Twice the signed area of the ring; its sign is the winding direction."""
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + (e["x"] * e["dy"] - e["dx"] * e["y"]))


def touches_tile(edges: Column, turn: Column, x: Column, y: Column) -> Column:
    """Whether a convex ring overlaps the unit tile (x, y), given that their boxes overlap.

    Separating-axis test: the tile is outside exactly when all four corners lie on the outer side of
    (or on) some edge.  Zero-length edges separate nothing.
    """
    x0, y0 = x.cast("double"), y.cast("double")
    direction = F.signum(turn)

    def side(edge: Column, cx: Column, cy: Column) -> Column:
        return direction * (edge["dx"] * (cy - edge["y"]) - edge["dy"] * (cx - edge["x"]))

    def has_inner_corner(edge: Column) -> Column:
        best = F.greatest(
            side(edge, x0, y0), side(edge, x0 + 1.0, y0), side(edge, x0, y0 + 1.0), side(edge, x0 + 1.0, y0 + 1.0)
        )
        return (best > 0.0) | ((edge["dx"] == 0.0) & (edge["dy"] == 0.0))

    return F.forall(edges, has_inner_corner)
