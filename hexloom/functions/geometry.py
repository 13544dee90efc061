"""Rings, WKT and GeoJSON as Column expressions.

A ring is ``array<struct<lon: double, lat: double>>``.  Hexagon positions are input data
(a ``cell_geometry`` table); nothing here invents coordinates.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<lon:double,lat:double>>"

Ring = Sequence[Sequence[float]]


def required_ring(id_column: str) -> Column:
    """The column ``ring``; a row without one raises an error that names its id."""
    problem = F.raise_error(F.concat(F.lit("no geometry for hexagon "), F.coalesce(F.col(id_column).cast("string"), F.lit("NULL"))))
    return F.when(F.col("ring").isNotNull(), F.col("ring")).otherwise(problem.cast(RING_TYPE))


def close_polygon_wkt(wkt: Column) -> Column:
    """POLYGON text with every open ring, holes included, closed by its first point.

    Closed rings stay; text that is no polygon, or an empty one, is returned as is.
    """
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def closed(ring: Column) -> Column:
        points = F.transform(F.split(ring, ","), lambda point: F.trim(point))
        last_first = F.when(F.element_at(points, -1) == points[0], F.array().cast("array<string>")).otherwise(F.slice(points, 1, 1))
        return F.concat(F.lit("("), F.array_join(F.concat(points, last_first), ", "), F.lit(")"))

    text = F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, closed), ", "), F.lit(")"))
    return F.when(F.upper(F.ltrim(wkt)).startswith("POLYGON") & (F.size(rings) > 0), text).otherwise(wkt)


def id_to_polygon(id_text: Column, multipolygon: Column) -> Column:
    """The closed single polygon of a hexagon: ``(id, wkt)`` from its multipolygon text; the first part counts."""
    return F.struct(id_text.alias("id"), close_polygon_wkt(F.get(multipolygon_parts(multipolygon), 0)).alias("wkt"))


def multipolygon_parts(wkt: Column) -> Column:
    """The POLYGON texts inside a MULTIPOLYGON (holes stay with their part); a POLYGON is its own part."""
    inner = F.regexp_replace(wkt, r"(?i)^\s*MULTIPOLYGON\s*\(\s*\(\(|\)\)\s*\)\s*$", "")
    parts = F.transform(
        F.split(inner, r"\)\)\s*,\s*\(\("), lambda p: F.concat(F.lit("POLYGON (("), F.trim(p), F.lit("))"))
    )
    is_multi = F.upper(F.ltrim(wkt)).startswith("MULTIPOLYGON")
    return F.when(is_multi & F.upper(wkt).endswith("EMPTY"), F.array().cast("array<string>")).when(
        is_multi, parts
    ).otherwise(F.array(wkt))


def geojson_rings(text: Column) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon, as a geometry or a feature; NULL for other text."""
    ring = "array<array<array<double>>>"
    simple, several = (F.from_json(text, f"type string, coordinates {t}, geometry struct<type:string,coordinates:{t}>") for t in (ring, f"array<{ring}>"))
    kind = F.coalesce(simple["geometry"]["type"], simple["type"])
    parts = F.coalesce(several["geometry"]["coordinates"], several["coordinates"])
    rings = F.when(kind == "Polygon", F.coalesce(simple["geometry"]["coordinates"], simple["coordinates"])).when(kind == "MultiPolygon", F.flatten(parts))
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))


def wkt_rings(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON text; NULL for other text."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(F.get(xy, 0).try_cast("double").alias("lon"), F.get(xy, 1).try_cast("double").alias("lat"))

    return F.when(F.upper(F.ltrim(wkt)).rlike("^(MULTI)?POLYGON"), F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point)))


def wkt_to_ring(wkt: Column) -> Column:
    """Outer ring of a POLYGON text, NULL for other text."""
    body = F.split_part(F.split_part(wkt, F.lit("(("), F.lit(2)), F.lit(")"), F.lit(1))
    # a point is split once, not once for each coordinate
    pairs = F.transform(F.split(body, ","), lambda text: F.split(F.trim(text), r"\s+"))

    def point(xy: Column) -> Column:
        return F.struct(F.get(xy, 0).try_cast("double").alias("lon"), F.get(xy, 1).try_cast("double").alias("lat"))

    return F.when(F.upper(F.ltrim(wkt)).startswith("POLYGON"), F.transform(pairs, point))


def close_ring(ring: Column) -> Column:
    first = F.element_at(ring, 1)
    return F.when(F.element_at(ring, -1) == first, ring).otherwise(F.concat(ring, F.array(first)))


def ring_to_wkt(ring: Column) -> Column:
    points = F.transform(
        close_ring(ring), lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))
    )
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def ring_coordinates(ring: Column) -> Column:
    """GeoJSON ``coordinates`` of a Polygon with one closed ring."""
    return F.array(F.transform(close_ring(ring), lambda p: F.array(p["lon"], p["lat"])))


def polygon_rings(feature: str | dict | Sequence[Ring]) -> list[list[tuple[float, float]]]:
    """Rings of one polygon given as GeoJSON (feature or geometry, text or dict) or as coordinates."""
    if isinstance(feature, str):
        feature = json.loads(feature)
    if isinstance(feature, dict):
        geometry = feature.get("geometry", feature)
        if not isinstance(geometry, dict) or geometry.get("type") != "Polygon":
            raise ValueError("the selection must be one GeoJSON Polygon")
        feature = geometry["coordinates"]
    rings = [[(float(p[0]), float(p[1])) for p in ring] for ring in feature]
    if not rings or any(len(set(ring)) < 3 for ring in rings):
        raise ValueError("every ring of a polygon needs three distinct points")
    return rings


def crosses_antimeridian(rings: Sequence[Ring]) -> bool:
    """Whether an edge spans more than 180 degrees; it then runs the short way, over the antimeridian."""
    return any(abs(a[0] - b[0]) > 180.0 for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]))


def unwrapped(rings: Sequence[Ring], lon: Column) -> tuple[Sequence[Ring], Column]:
    """Rings and longitudes in one piece: both moved to 0..360 where the polygon crosses the antimeridian."""
    if not crosses_antimeridian(rings):
        return rings, lon
    east = [[(x + 360.0 if x < 0.0 else x, y) for x, y, *_ in ring] for ring in rings]
    return east, F.when(lon < 0.0, lon + 360.0).otherwise(lon)


def in_bounding_box(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Box around the outer ring: plain comparisons that reach the Parquet scan, also over the antimeridian."""
    whole = unwrapped(rings, lon)[0]
    xs, ys = [p[0] for p in whole[0]], [p[1] for p in whole[0]]
    across = lon.between(min(xs), max(xs))
    if max(xs) > 180.0:
        across = (lon >= min(xs)) | (lon <= max(xs) - 360.0)
    return across & lat.between(min(ys), max(ys))


def in_polygon(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Even-odd ray casting over all rings together, so holes are cut out."""
    box = in_bounding_box(rings, lon, lat)
    rings, lon = unwrapped(rings, lon)
    edges = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:  # a level edge never crosses a horizontal ray
                edges.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2})

    def crosses(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)

    if len(edges) <= 32:
        tests = [crosses(*(F.lit(e[k]) for k in ("x1", "y1", "x2", "y2"))) for e in edges]
        return box & reduce(lambda a, b: a != b, tests)
    table = F.from_json(F.lit(json.dumps(edges)), "array<struct<x1:double,y1:double,x2:double,y2:double>>")
    odd = F.aggregate(
        table, F.lit(False), lambda acc, e: acc != crosses(e["x1"], e["y1"], e["x2"], e["y2"])
    )
    return box & odd
