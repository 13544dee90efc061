"""The registered queries: one per operator, each with equal SQL where SQL can say it."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hexloom as hl
from hexloom import sources
from hexloom.functions import cellid, geometry, tiles
from hexloom.functions.sql import register_sql_functions
from hexloom.operators import profile as prof
from hexloom.operators.attributes import join_attributes
from hexloom.operators.joins import dealt
from hexloom.operators.stats import stats
from hexloom.plans import tables
from hexloom.plans.oracle import CELLS, CENTERS, HEXES, QUADKEY, VERTICES, over_cells, over_tiles, parent, sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


# --- ids and hierarchy -------------------------------------------------------------------------


@register("h3_string_roundtrip", over_cells("SELECT id, r11_id AS cell, id AS text FROM cells"))
def _(spark, d):
    cell = cellid.string_to_cell(F.col("id"))
    return tables.cells(spark, d).select("id", cell.alias("cell"), cellid.cell_to_string(cell).alias("text"))


@register(
    "h3_hierarchy",
    over_cells(
        "SELECT DISTINCT r11_id, "
        + ", ".join(f"{parent('r11_id', r)} AS r{r}" for r in range(11))
        + ", CAST(NULL AS BIGINT) AS r12 FROM cells"
    ),
)
def _(spark, d):
    cell = F.col("r11_id")
    levels = [cellid.cell_to_parent(cell, r).alias(f"r{r}") for r in (*range(11), 12)]
    return tables.cells(spark, d).select("r11_id").distinct().select("r11_id", *levels)


@register(
    "h3_resolution",
    over_cells(
        " UNION ALL ".join(
            f"SELECT CAST({r} AS INTEGER) AS resolution, count(DISTINCT r{r}_id) AS hexagons FROM cells"
            for r in range(4, 12)
        )
    ),
)
def _(spark, d):
    ids = tables.cells(spark, d).select(F.explode(F.array(*(f"r{r}_id" for r in range(4, 12)))).alias("id"))
    return (
        ids.distinct()
        .groupBy(cellid.resolution(F.col("id")).alias("resolution"))
        .agg(F.count(F.lit(1)).alias("hexagons"))
    )


_VALID_TEXT = """
  SELECT n, CASE n % 6 WHEN 0 THEN id WHEN 1 THEN upper(id) WHEN 2 THEN substr(id, 1, 6)
    WHEN 3 THEN substr(id, 1, 14) || '0' WHEN 4 THEN 'zz' || substr(id, 3)
    ELSE lower(hex((r11_id & ~(CAST(127 AS BIGINT) << 45)) | ((n % 128) << 45))) END AS text
  FROM cells"""


@register(
    "h3_valid",
    sql(
        CELLS,
        f"texts AS ({_VALID_TEXT})",
        "nums AS (SELECT n, text, TRY_CAST('0x' || text AS BIGINT) AS h FROM texts)",
        "parts AS (SELECT n, text, h, (h >> 45) & 127 AS base, [(h >> (3 * (15 - i))) & 7 for i in range(1, 12)] AS ds"
        " FROM nums)",
        query="""SELECT n, text, coalesce(length(text) = 15 AND (h >> 56) = 8 AND ((h >> 52) & 15) = 11 AND base <= 121
          AND len(list_filter(ds, lambda v: v = 7)) = 0 AND (h & 4095) = 4095
          AND NOT (base IN (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
                   AND coalesce(list_filter(ds, lambda v: v <> 0)[1], 0) = 1), false) AS valid
        FROM parts""",
    ),
)
def _(spark, d):
    id_, n = F.col("id"), F.col("n")
    rebased = F.col("r11_id").bitwiseAND(F.lit(~(127 << 45)).cast("long")).bitwiseOR(F.shiftleft(n % 128, 45))
    kind = n % 6
    text = (
        F.when(kind == 0, id_)
        .when(kind == 1, F.upper(id_))
        .when(kind == 2, F.substring(id_, 1, 6))
        .when(kind == 3, F.concat(F.substring(id_, 1, 14), F.lit("0")))
        .when(kind == 4, F.concat(F.lit("zz"), F.expr("substring(id, 3)")))
        .otherwise(cellid.cell_to_string(rebased))
    )
    texts = tables.cells(spark, d).select("n", text.alias("text"))
    return texts.withColumn("valid", cellid.is_valid_cell_string(F.col("text")))


@register(
    "sql_functions",
    over_cells(
        """SELECT n, r11_id AS cell, r9_id AS parent, id AS text, CAST(11 AS INTEGER) AS resolution, true AS valid,
             CAST(CASE WHEN n % 17 <= 6 THEN 6 WHEN n % 17 <= 8 THEN 7 WHEN n % 17 <= 10 THEN 8 WHEN n % 17 <= 12 THEN 9
               WHEN n % 17 = 13 THEN 10 ELSE 11 END AS INTEGER) AS zoom_resolution FROM cells"""
    ),
)
def _(spark, d):
    register_sql_functions(spark)
    return tables.cells(spark, d).selectExpr(
        "n",
        "h3_string_to_h3(id) AS cell",
        "h3_cell_to_parent(r11_id, 9) AS parent",
        "h3_h3_to_string(r11_id) AS text",
        "h3_get_resolution(r11_id) AS resolution",
        "h3_is_valid_cell(r11_id) AS valid",
        "zoom_to_h3_resolution(CAST(n % 17 AS INT)) AS zoom_resolution",
    )


_ALL = (
    "r11_id, r10_id, r9_id, r8_id, r7_id, r6_id, r5_id, r4_id, id, n, l_quantity, l_extendedprice, l_discount, "
    "l_partkey, l_returnflag, l_linestatus, tax, discounted, flag"
)


@register("build_cells", over_cells(f"SELECT {_ALL} FROM cells"))
def _(spark, d):
    return sources.with_hierarchy(tables.cells(spark, d).drop(*sources.STORED_LEVELS))


@register("build_cells_csv", over_cells(f"SELECT {_ALL} FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    raw = tables.cells(spark, d).drop(*sources.STORED_LEVELS).withColumnRenamed("id", "GRID_ID")
    raw.write.csv(folder, header=True)
    return sources.build_cells(spark, folder)


@register("cells_store", over_cells(f"SELECT {_ALL} FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    sources.write_cells(tables.cells(spark, d), folder)
    return spark.read.parquet(folder)


@register("row_count", "SELECT count(*) AS rows FROM lineitem")
def _(spark, d):
    return sources.row_count(tables.table(spark, d, "lineitem"))


@register("id_list_scan", over_cells("SELECT DISTINCT id FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    sources.write_id_list(tables.cells(spark, d).select(F.concat(F.lit(" "), "id").alias("id")), folder)
    return sources.read_id_list(spark, folder)


@register("id_csv_scan", over_cells("SELECT id FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    tables.cells(spark, d).select("id").write.csv(folder)
    return sources.read_id_csv(spark, folder)


# --- counts under filters ----------------------------------------------------------------------

_MIXED = {"l_quantity": {"min": 5, "max": 20}, "l_returnflag": {"choices": ["A", "R"]}}
_MIXED_SQL = "l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A', 'R')"

_FILTERS = {
    "count_all": (None, "true"),
    "filter_range": ({"l_quantity": {"min": 5, "max": 20}}, "l_quantity >= 5 AND l_quantity <= 20"),
    "filter_min_only": ({"l_extendedprice": {"min": 50000.5}}, "l_extendedprice >= 50000.5e0"),
    "filter_max_only": ({"tax": {"max": 0.03}}, "tax <= 0.03e0"),
    "filter_bool": ({"discounted": {"bool": False}}, "discounted = false"),
    "filter_choices": ({"flag": {"choices": ["A", "N"]}}, "flag IN ('A', 'N')"),
    "filter_conjunction": ({**_MIXED, "discounted": {"bool": True}}, f"{_MIXED_SQL} AND discounted"),
    "filter_empty_choices": ({"flag": {"choices": []}, "l_quantity": {"min": 30}}, "l_quantity >= 30"),
    "filter_null_bound": ({"l_quantity": {"min": None, "max": 20}}, "l_quantity >= NULL AND l_quantity <= 20"),
    "filter_unknown_shape": ({"flag": {"like": "A%"}}, "true"),
}

for _name, (_filters, _where) in _FILTERS.items():

    @register(_name, over_cells(f"SELECT count(DISTINCT r11_id) AS count FROM cells WHERE {_where}"))
    def _(spark, d, filters=_filters):
        return hl.count_cells(tables.cells(spark, d), filters)


@register(
    "filter_from_text",
    over_cells("SELECT count(DISTINCT r11_id) AS count FROM cells WHERE l_quantity <= 10 AND discounted"),
)
def _(spark, d):
    text = "%7B%22l_quantity%22%3A%7B%22max%22%3A10%7D%2C%22discounted%22%3A%7B%22bool%22%3Atrue%7D%7D"
    return hl.count_cells(tables.cells(spark, d), hl.parse_filters(text))


_HEX_SQL = """
  SELECT lower(hex({key})) AS h3, true AS highlighted, CAST({res} AS INTEGER) AS resolution,
    count(*) FILTER (WHERE {where}) AS count, count(*) AS all_count,
    count(*) FILTER (WHERE {where}) / count(*) AS "fractionMatching"
  FROM {source} GROUP BY {key} HAVING count(*) FILTER (WHERE {where}) > 0"""

for _res in range(6, 11):

    @register(
        f"hex_counts_r{_res}",
        over_cells(_HEX_SQL.format(key=f"r{_res}_id", res=_res, where=_MIXED_SQL, source="cells")),
    )
    def _(spark, d, res=_res):
        return hl.hex_counts(tables.cells(spark, d), res, _MIXED)


# --- tiles -------------------------------------------------------------------------------------


@register(
    "zoom_resolution",
    over_cells(
        """SELECT n % 17 AS zoom, CAST(CASE WHEN n % 17 <= 6 THEN 6 WHEN n % 17 <= 8 THEN 7 WHEN n % 17 <= 10 THEN 8
             WHEN n % 17 <= 12 THEN 9 WHEN n % 17 = 13 THEN 10 ELSE 11 END AS INTEGER) AS resolution, count(*) AS rows
           FROM cells GROUP BY ALL"""
    ),
)
def _(spark, d):
    zooms = tables.cells(spark, d).select((F.col("n") % 17).alias("zoom"))
    return zooms.groupBy("zoom", tiles.zoom_to_resolution(F.col("zoom")).alias("resolution")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@register(
    "quadkey",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        """zooms AS (SELECT id, lon, lat, zoom FROM centers UNION ALL SELECT id, lon, lat, 0 FROM centers)""",
        """xy AS (SELECT id, zoom, CAST(floor((lon + 180e0) / 360e0 * (1 << zoom)) AS BIGINT) AS x,
          CAST(floor((0.5e0 - 0.25e0 * ln((1e0 + sin(lat * pi() / 180e0)) / (1e0 - sin(lat * pi() / 180e0))) / pi())
            * (1 << zoom)) AS BIGINT) AS y FROM zooms)""",
        query=f"SELECT id, zoom, {QUADKEY.format(z='zoom')} AS quadkey FROM xy",
    ),
)
def _(spark, d):
    centers = tables.cell_geometry(hl.hexagons(tables.cells(spark, d)))
    zoom = tiles.resolution_to_zoom(F.col("resolution"))
    rows = centers.select("id", "lon", "lat", F.explode(F.array(zoom, F.lit(0))).alias("zoom"))
    across = tiles.tiles_across(F.col("zoom"))
    x = F.floor(tiles.lon_to_tile(F.col("lon"), across))
    y = F.floor(tiles.lat_to_tile(F.col("lat"), across))
    return rows.select("id", "zoom", tiles.quadkey(x, y, F.col("zoom")).alias("quadkey"))


@register(
    "tile_cover",
    over_tiles("SELECT geohash, id, resolution, zoom FROM tile_index").replace(
        "FROM vertices)", "FROM (SELECT * REPLACE (zoom + 1 AS zoom) FROM vertices))"
    ),
)
def _(spark, d):
    located = tables.cell_geometry(hl.hexagons(tables.cells(spark, d)))
    return hl.tile_cover(located.withColumn("zoom", tiles.resolution_to_zoom(F.col("resolution")) + 1))


@register("tile_index", over_tiles("SELECT geohash, id, resolution, zoom FROM tile_index"))
def _(spark, d):
    cells = tables.stored_cells(spark, d)
    return hl.build_tile_index(cells, tables.stored_geometry(spark, d))


@register("tile_index_store", over_tiles("SELECT geohash, id, resolution, zoom FROM tile_index"))
def _(spark, d):
    return tables.stored_tile_index(spark, d).select("geohash", "id", "resolution", "zoom")


_TILES = {
    "tile_counts": ((12, 1116, 1759), None, "true"),
    "tile_counts_filtered": ((10, 279, 439), _MIXED, _MIXED_SQL),
    "tile_counts_coarse": ((7, 34, 55), {"flag": {"choices": ["R"]}}, "flag = 'R'"),
    "tile_counts_world": ((0, 0, 0), _MIXED, _MIXED_SQL),
    "tile_counts_too_deep": ((15, 8929, 14076), None, "true"),
}


def _members_sql(z: int, x: int, y: int) -> str:
    return (
        f"SELECT DISTINCT id FROM tile_index WHERE resolution = {tiles.resolution_for_zoom(z)}"
        f" AND geohash LIKE '{tiles.tile_quadkey(z, x, y)}%'"
    )


@register("tile_members", over_tiles(_members_sql(10, 279, 439)))
def _(spark, d):
    return hl.tile_members(tables.stored_tile_index(spark, d), 10, 279, 439)


for _name, (_tile, _filters, _where) in _TILES.items():
    _key = f"r{tiles.resolution_for_zoom(_tile[0])}_id"

    @register(
        _name,
        over_tiles(
            _HEX_SQL.format(
                key=_key,
                res=tiles.resolution_for_zoom(_tile[0]),
                where=_where,
                source=f"(SELECT * FROM cells WHERE {_key} IN ({_members_sql(*_tile)}))",
            )
        ),
    )
    def _(spark, d, tile=_tile, filters=_filters):
        return hl.tile_counts(tables.stored_cells(spark, d), tables.stored_tile_index(spark, d), *tile, filters)


_PYRAMID_SQL = f"""
  , counted AS ({" UNION ALL ".join(
      f"SELECT r{r}_id AS id, count(*) FILTER (WHERE {_MIXED_SQL}) AS count, count(*) AS all_count FROM cells GROUP BY 1"
      for r in range(6, 12))}),
  zooms AS (SELECT DISTINCT CAST(z AS INTEGER) AS z, left(geohash, z) AS quadkey, id, resolution
    FROM tile_index, range(0, 15) r(z)
    WHERE z <= zoom AND z >= CASE resolution WHEN 6 THEN 0 WHEN 7 THEN 7 WHEN 8 THEN 9 WHEN 9 THEN 11
      WHEN 10 THEN 13 ELSE 14 END)"""


@register(
    "tile_pyramid",
    over_tiles(
        _PYRAMID_SQL
        + """ SELECT z, quadkey, lower(hex(id)) AS h3, resolution, count, all_count,
          count / all_count AS "fractionMatching" FROM zooms JOIN counted USING (id) WHERE count > 0"""
    ),
)
def _(spark, d):
    return hl.tile_pyramid(tables.stored_cells(spark, d), tables.stored_tile_index(spark, d), _MIXED)


_GEOJSON = (
    "type string, properties struct<h3:string,highlighted:boolean,resolution:int,count:long,all_count:long,"
    "fractionMatching:double>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
)


@register(
    "tile_geojson",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        f"counted AS ({_HEX_SQL.format(key='r9_id', res=9, where=_MIXED_SQL, source='cells')})",
        query="""SELECT 'Feature' AS type, h3, highlighted, c.resolution, count, all_count,
          round("fractionMatching", 9) AS fraction, 'Polygon' AS shape, CAST(7 AS INTEGER) AS points,
          round(lon + w * 0.49e0, 9) AS lon, round(lat, 9) AS lat
        FROM counted c JOIN centers ON lower(hex(id)) = h3""",
    ),
)
def _(spark, d):
    folder = tables.shared_folder(spark)
    rings = tables.stored_geometry(spark, d).select(cellid.cell_to_string(F.col("id")).alias("h3"), "ring")
    sources.write_geojson(sources.geojson_features(hl.hex_counts(tables.cells(spark, d), 9, _MIXED), rings), folder)
    ring = F.col("geometry.coordinates")[0]
    return spark.read.json(folder, schema=_GEOJSON).select(
        "type",
        *(f"properties.{c}" for c in ("h3", "highlighted", "resolution", "count", "all_count")),
        F.round("properties.fractionMatching", 9).alias("fraction"),
        F.col("geometry.type").alias("shape"),
        F.size(ring).alias("points"),
        F.round(F.element_at(ring, -1)[0], 9).alias("lon"),
        F.round(F.element_at(ring, -1)[1], 9).alias("lat"),
    )


@register("feature_ids", over_cells("SELECT DISTINCT lower(hex(r9_id)) AS id FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    rings = tables.stored_geometry(spark, d).select(cellid.cell_to_string(F.col("id")).alias("h3"), "ring")
    sources.write_geojson(sources.geojson_features(hl.hex_counts(tables.cells(spark, d), 9), rings), folder)
    return hl.extract_cell_ids(sources.read_features(spark, folder, "h3"), "h3")


# --- selections and statistics -----------------------------------------------------------------

_SELECTED_SQL = """
  SELECT r7_id AS id FROM cells GROUP BY r7_id HAVING avg(l_quantity) > 25.6e0
  UNION SELECT r9_id FROM cells GROUP BY r9_id HAVING avg(l_quantity) > 29e0
  UNION SELECT r11_id FROM cells WHERE l_quantity >= 49"""


def _above(cells: DataFrame, res: int, quantity: float) -> DataFrame:
    """Hexagons whose mean quantity is above a value."""
    groups = cells.groupBy(F.col(f"r{res}_id").alias("id")).agg(F.avg("l_quantity").alias("mean"))
    return groups.where(F.col("mean") > quantity).select("id")


def _selected(cells: DataFrame) -> DataFrame:
    """A mixed-resolution selection, some of whose ids lie under others."""
    finest = cells.where("l_quantity >= 49").select(F.col("r11_id").alias("id"))
    ids = _above(cells, 7, 25.6).union(_above(cells, 9, 29.0)).union(finest)
    return ids.distinct().select(cellid.cell_to_string(F.col("id")).alias("id"))


_COMPACT_SQL = """SELECT * FROM cells WHERE r7_id IN (SELECT id FROM selected) OR r9_id IN (SELECT id FROM selected)
  OR r11_id IN (SELECT id FROM selected)"""


@register(
    "select_compact",
    sql(CELLS, f"selected AS ({_SELECTED_SQL})", query=f"SELECT r11_id, n, l_extendedprice FROM ({_COMPACT_SQL})"),
)
def _(spark, d):
    cells = tables.stored_cells(spark, d)
    return hl.select_cells_compact(cells, _selected(cells)).select("r11_id", "n", "l_extendedprice")


@register(
    "uncompact",
    sql(
        CELLS,
        "selected AS (SELECT r8_id AS id, 343 AS kids FROM cells GROUP BY r8_id HAVING avg(l_quantity) > 25.5e0"
        " UNION SELECT r9_id, 49 FROM cells UNION SELECT r11_id, 1 FROM cells)",
        "spread AS (SELECT id, kids, unnest(range(0, kids)) AS i FROM selected)",
        query="""SELECT DISTINCT CASE kids WHEN 1 THEN id ELSE
            (id & ~(CAST(15 AS BIGINT) << 52) & ~(CASE kids WHEN 343 THEN 511 ELSE 63 END << 12)) | (CAST(11 AS BIGINT) << 52)
            | ((i % 7) << 12) | ((i // 7 % 7) << 15) | (CASE kids WHEN 343 THEN (i // 49 % 7) << 18 ELSE 0 END) END AS id
          FROM spread""",
    ),
)
def _(spark, d):
    cells = tables.stored_cells(spark, d)
    ids = _above(cells, 8, 25.5).union(cells.select("r9_id")).union(cells.select("r11_id")).distinct()
    return hl.uncompact_cells(ids.select(cellid.cell_to_string(F.col("id")).alias("id")))


_BOX = [[-81.95, 24.51], [-81.85, 24.51], [-81.85, 24.60], [-81.95, 24.60], [-81.95, 24.51]]
_HOLE = [[-81.92, 24.53], [-81.88, 24.53], [-81.88, 24.57], [-81.92, 24.57], [-81.92, 24.53]]
_FINE_BOX = [[-81.995, 24.55], [-81.972, 24.55], [-81.972, 25.2], [-81.99, 25.1], [-81.995, 24.55]]
_STAR = [
    [-81.9 + r * math.cos(math.pi * i / 24), 24.56 + r * math.sin(math.pi * i / 24)]
    for i in range(48)
    for r in (0.05 if i % 2 else 0.02,)
]


def _polygon_sql(rings: list, res: int | str) -> str:
    sides = ", ".join(
        f"({a[0]!r}e0, {a[1]!r}e0, {b[0]!r}e0, {b[1]!r}e0)" for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])
    )
    return f"""
      SELECT id FROM centers LEFT JOIN (VALUES {sides}) s(x1, y1, x2, y2)
        ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
      WHERE resolution = {res} GROUP BY id HAVING count(x1) % 2 = 1"""


_POLYGONS = {
    "select_polygon": ([_FINE_BOX], 11),
    "select_polygon_hole": ([_BOX, _HOLE], 9),
    "select_polygon_many_edges": ([_STAR], 9),
}

for _name, (_rings, _res) in _POLYGONS.items():

    @register(
        _name,
        sql(
            CELLS,
            HEXES,
            CENTERS,
            query=f"SELECT r11_id, n, l_quantity FROM cells WHERE r{_res}_id IN ({_polygon_sql(_rings, _res)})",
        ),
    )
    def _(spark, d, rings=_rings, res=_res):
        cells, centers = tables.stored_cells(spark, d), tables.stored_geometry(spark, d)
        return hl.select_cells_polygon(cells, centers, rings, res).select("r11_id", "n", "l_quantity")


@register(
    "cells_in_polygon",
    sql(CELLS, HEXES, CENTERS, query=_polygon_sql([_BOX, _HOLE], "resolution")),
)
def _(spark, d):
    centers = tables.stored_geometry(spark, d)
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [_BOX, _HOLE]}}
    return hl.cells_in_polygon(centers, feature).select("id")


# Corners of the synthetic polygons (a star and a hole in it), in units of their size.
_STAR_CORNERS = [(1.0, 0.1), (0.3, 0.4), (0.2, 1.1), (-0.3, 0.35), (-1.05, 0.2), (-0.35, -0.3), (-0.1, -1.2), (0.35, -0.33)]
_HOLE_CORNERS = [(0.15, 0.02), (-0.02, 0.17), (-0.16, -0.03), (0.01, -0.14)]
_SIZED = """SELECT c_custkey AS polygon_id, -82.0e0 + (c_custkey * 37 % 100) * 0.0013e0 AS cx, 24.5e0 + (c_custkey * 53 % 401) * 0.0093e0 AS cy,
  CASE WHEN c_custkey % 97 = 0 THEN 0.9e0 ELSE 0.004e0 + (c_custkey % 11) * 0.003e0 END AS r FROM customer"""


def _shifted(lon: str, shift: float) -> str:
    moved = f"({lon} - {shift}e0)"
    return f"CASE WHEN {moved} < -180e0 THEN {moved} + 360e0 ELSE {moved} END" if shift else lon


def _polygons(spark, d, shift: float = 0.0) -> DataFrame:
    """A star for each customer, every third with a hole."""
    tables.table(spark, d, "customer").createOrReplaceTempView("polygon_customers")
    sized = spark.sql(_SIZED.replace("FROM customer", "FROM polygon_customers"))

    def ring(corners):
        return F.array(*(F.struct(F.expr(_shifted(f"(cx + r * {x}e0)", shift)).alias("lon"), F.expr(f"cy + r * {y}e0").alias("lat")) for x, y in corners))

    both = F.when(F.col("polygon_id") % 3 == 0, F.array(ring(_STAR_CORNERS), ring(_HOLE_CORNERS))).otherwise(F.array(ring(_STAR_CORNERS)))
    return sized.select("polygon_id", both.alias("rings"))


def _polygons_sql(shift: float = 0.0) -> str:
    """Centres in stars by ray casting over all edges; a shifted case is tested in unshifted longitudes."""
    edges = [(*a, *b, "true") for a, b in zip(_STAR_CORNERS, _STAR_CORNERS[1:] + _STAR_CORNERS[:1])]
    edges += [(*a, *b, "polygon_id % 3 = 0") for a, b in zip(_HOLE_CORNERS, _HOLE_CORNERS[1:] + _HOLE_CORNERS[:1])]

    def x(corner: float) -> str:
        lon = _shifted(f"(cx + r * {corner}e0)", shift)
        return f"(CASE WHEN wraps AND {lon} < 0 THEN {lon} + 360e0 ELSE {lon} END)" if shift else f"(cx + r * {corner}e0)"

    tests = " + ".join(
        f"CASE WHEN {when} AND ((cy + r * {y1}e0) > lat) <> ((cy + r * {y2}e0) > lat)"
        f" AND lon < ({x(x2)} - {x(x1)}) * (lat - (cy + r * {y1}e0)) / ((cy + r * {y2}e0) - (cy + r * {y1}e0)) + {x(x1)} THEN 1 ELSE 0 END"
        for x1, y1, x2, y2, when in edges
    )
    centre = _shifted("lon", shift)
    wraps = f"abs(({_shifted('(cx + r * 1.0e0)', shift)}) - ({_shifted('(cx - r * 1.05e0)', shift)})) > 180" if shift else "false"
    near = f"SELECT polygon_id, id, cx, cy, r, {wraps} AS wraps, {centre} AS seen, lat FROM sized JOIN centers ON lat BETWEEN cy - 1.3e0 * r AND cy + 1.3e0 * r AND lon BETWEEN cx - 1.2e0 * r AND cx + 1.2e0 * r"
    return f"SELECT polygon_id, id FROM (SELECT *, CASE WHEN wraps AND seen < 0 THEN seen + 360e0 ELSE seen END AS lon FROM ({near})) WHERE ({tests}) % 2 = 1"


def _dateline_centers(spark, d) -> DataFrame:
    return tables.stored_geometry(spark, d).withColumn("lon", F.expr(_shifted("lon", _DATELINE)))


_DATELINE = 98.01

for _name, _shift in {"cells_in_polygons": 0.0, "cells_in_polygons_dateline": _DATELINE}.items():

    @register(_name, sql(CELLS, HEXES, CENTERS, f"sized AS ({_SIZED})", query=_polygons_sql(_shift)))
    def _(spark, d, shift=_shift):
        centers = _dateline_centers(spark, d) if shift else tables.stored_geometry(spark, d)
        return hl.cells_in_polygons(centers, _polygons(spark, d, shift))


# a box over the antimeridian with a hole, in the longitudes of the shifted centres
_DATELINE_RINGS = [[[179.9, 24.51], [-179.9, 24.51], [-179.9, 24.9], [179.9, 24.9]], [[179.96, 24.6], [-179.95, 24.6], [-179.95, 24.7], [179.96, 24.7]]]


@register(
    "select_polygon_dateline",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        f"moved AS (SELECT id, resolution, lat, {_shifted('lon', _DATELINE)} AS lon FROM centers)",
        query="""SELECT r11_id, n, l_quantity FROM cells WHERE r9_id IN (SELECT id FROM (
          SELECT *, CASE WHEN lon < 0 THEN lon + 360e0 ELSE lon END AS east FROM moved WHERE resolution = 9)
          WHERE east BETWEEN 179.9e0 AND 180.1e0 AND lat BETWEEN 24.51e0 AND 24.9e0
            AND NOT (east BETWEEN 179.96e0 AND 180.05e0 AND lat BETWEEN 24.6e0 AND 24.7e0))""",
    ),
)
def _(spark, d):
    feature = {"type": "Polygon", "coordinates": _DATELINE_RINGS}
    return hl.select_cells_polygon(tables.stored_cells(spark, d), _dateline_centers(spark, d), feature, 9).select("r11_id", "n", "l_quantity")


_NUMBERS = ("l_quantity", "l_extendedprice", "tax", "l_partkey")


def _stats_sql(source: str, kinds: tuple = ("number", "string", "boolean")) -> str:
    null = "CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS count"
    none = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg"
    numbers = [
        f"SELECT '{c}' AS property, 'number' AS type, {null}, CAST(min({c}) AS DOUBLE) AS min,"
        f" CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 7) AS avg FROM {source}"
        for c in _NUMBERS
    ]
    values = [
        f"SELECT '{c}', '{t}', CAST({c} AS VARCHAR), count({c}), {none} FROM {source} GROUP BY {c}"
        for c, t in (("l_linestatus", "string"), ("flag", "string"), ("discounted", "boolean"))
    ]
    return " UNION ALL ".join(part for part in numbers + values if any(f"'{kind}'" in part for kind in kinds))


def _stats(cells: DataFrame, kinds: tuple = ("number", "string", "boolean")) -> DataFrame:
    wanted = [{"type": "number", "column": c} for c in _NUMBERS]
    wanted += [{"type": "string", "column": "l_linestatus"}, {"type": "string", "column": "flag"}]
    wanted += [{"type": "boolean", "column": "discounted"}]
    return stats(cells, [w for w in wanted if w["type"] in kinds]).withColumn("avg", F.round("avg", 7))


_STATS_COLUMNS = "property, type, value, count, min, max, avg"

for _kind, _name in (("number", "stats_numeric"), ("string", "stats_string"), ("boolean", "stats_boolean")):

    @register(
        _name, over_cells(f"SELECT * FROM ({_stats_sql('cells', (_kind,))}) AS s({_STATS_COLUMNS})")
    )
    def _(spark, d, kind=_kind):
        return _stats(tables.cells(spark, d), (kind,))



@register("stats_all", over_cells(_stats_sql("cells")))
def _(spark, d):
    return _stats(tables.cells(spark, d))


@register(
    "stats_compact",
    sql(CELLS, f"selected AS ({_SELECTED_SQL})", f"chosen AS ({_COMPACT_SQL})", query=_stats_sql("chosen")),
)
def _(spark, d):
    cells = tables.stored_cells(spark, d)
    return _stats(hl.select_cells(cells, ids=_selected(cells)))


@register(
    "stats_polygon",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        f"chosen AS (SELECT * FROM cells WHERE r11_id IN ({_polygon_sql([_FINE_BOX], 11)}))",
        query=_stats_sql("chosen"),
    ),
)
def _(spark, d):
    cells, centers = tables.stored_cells(spark, d), tables.stored_geometry(spark, d)
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [_FINE_BOX]}}
    return _stats(hl.select_cells(cells, feature=feature, centers=centers))


@register("stats_empty", over_cells(_stats_sql("(SELECT * FROM cells WHERE n < 0)")))
def _(spark, d):
    return _stats(tables.cells(spark, d).where("n < 0"))


# --- profiles ----------------------------------------------------------------------------------


def _histogram_sql(column: str, bins: int = 49) -> str:
    """Each value joined to the bin whose bounds it lies between; the last bin has the maximum too."""
    return f"""
      SELECT CAST(bin AS INTEGER) AS bin, low AS bin_start, high AS bin_end, count(v) AS count
      FROM (SELECT bin, least_v + (bin - 1) * step AS low, CASE bin WHEN {bins} THEN most_v ELSE least_v + bin * step END AS high
            FROM (SELECT unnest(generate_series(1, {bins})) AS bin, least_v, most_v, (most_v - least_v) / {bins}e0 AS step
                  FROM (SELECT CAST(min({column}) AS DOUBLE) AS least_v, CAST(max({column}) AS DOUBLE) AS most_v FROM cells)))
      LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS v FROM cells) ON v >= low AND (bin = {bins} OR v < high)
      GROUP BY bin, low, high"""


@register("histogram", over_cells(_histogram_sql("l_extendedprice")))
def _(spark, d):
    return hl.histogram(tables.cells(spark, d), "l_extendedprice")


@register("histogram_10", over_cells(_histogram_sql("l_partkey", 10)))
def _(spark, d):
    return hl.histogram(tables.cells(spark, d), "l_partkey", 10)


@register("histogram_constant", over_cells(_histogram_sql("(l_quantity * 0 + 1)")))
def _(spark, d):
    return hl.histogram(tables.cells(spark, d).select((F.col("l_quantity") * 0 + 1).alias("one")), "one")


@register("histogram_all_null", over_cells(_histogram_sql("CASE WHEN n < 0 THEN l_quantity END")))
def _(spark, d):
    nulls = tables.cells(spark, d).select(F.when(F.col("n") < 0, F.col("l_quantity")).alias("none"))
    return hl.histogram(nulls, "none")


_PROFILED_NUMBERS = ("n", "l_quantity", "l_extendedprice", "l_discount", "l_partkey", "tax")
_PROFILED_TEXTS = ("l_returnflag", "l_linestatus", "flag")


@register(
    "histograms",
    over_cells(
        " UNION ALL ".join(f"SELECT '{c}' AS attribute, * FROM ({_histogram_sql(c)})" for c in _PROFILED_NUMBERS)
    ),
)
def _(spark, d):
    return hl.histograms(tables.cells(spark, d), _PROFILED_NUMBERS)


def _numeric_sql(column: str, deviation: str = "stddev_samp") -> str:
    return f"""SELECT '{column}' AS attribute, 'number' AS type, count({column}) AS count,
      count(DISTINCT {column}) AS "countDistinct", CAST(min({column}) AS DOUBLE) AS min,
      CAST(max({column}) AS DOUBLE) AS max, round(avg({column}), 7) AS avg,
      round({deviation}({column}), 7) AS stddev FROM cells"""


def _plain_sql(column: str, kind: str, value: str, count: str = "count") -> str:
    return f"""SELECT '{column}' AS attribute, '{kind}' AS type, count({value}) AS count,
      count(DISTINCT {value}) AS "countDistinct", CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
      CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS stddev FROM cells"""


_BOOLEAN_TEXT = "coalesce(CAST(discounted AS VARCHAR), 'null')"

_PROFILE_SQL = " UNION ALL ".join(
    [_numeric_sql(c) for c in _PROFILED_NUMBERS]
    + [_plain_sql(c, "string", c) for c in _PROFILED_TEXTS]
    + [_plain_sql("discounted", "boolean", _BOOLEAN_TEXT)]
    + [_plain_sql("id", "string", "DISTINCT id").replace("DISTINCT DISTINCT", "DISTINCT")]
)


def _versions(spark, d):
    return tables.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("version"))


def _flat(document: DataFrame, deviation: str = "stddev_samp") -> DataFrame:
    return document.select(
        "attribute",
        "type",
        "count",
        "countDistinct",
        "min",
        "max",
        F.round("stats.avg", 7).alias("avg"),
        F.round(f"stats.{deviation}", 7).alias("stddev"),
    )


def _values_sql() -> str:
    texts = [f"SELECT '{c}' AS attribute, {c} AS value, count(*) AS count FROM cells WHERE {c} IS NOT NULL GROUP BY {c}"
             for c in _PROFILED_TEXTS]
    flags = f"SELECT 'discounted', {_BOOLEAN_TEXT}, count(*) FROM cells GROUP BY 2"
    return " UNION ALL ".join([*texts, flags])


@register("profile", over_cells(f"SELECT *, (SELECT max(l_linenumber) FROM lineitem) AS version FROM ({_PROFILE_SQL})"))
def _(spark, d):
    document = hl.profile(tables.cells(spark, d), _versions(spark, d))
    version = document.select("attribute", F.col("version").cast("int").alias("version"))
    return _flat(document).drop("version").join(version, "attribute")


@register("profile_map", over_cells(_values_sql()))
def _(spark, d):
    document = hl.profile(tables.cells(spark, d), _versions(spark, d))
    return document.select("attribute", F.explode("values").alias("value", "count"))


@register("profile_values", over_cells(_values_sql()))
def _(spark, d):
    return hl.profile_values(tables.cells(spark, d))


@register(
    "profile_value_chunks",
    over_cells(f"SELECT *, true AS bounded FROM ({_values_sql()} UNION ALL SELECT 'cell_text', id, count(*) FROM cells GROUP BY id)"),
)
def _(spark, d):
    cells = tables.cells(spark, d).withColumn("cell_text", F.col("id"))
    chunks = hl.profile_value_chunks(cells, size=1000)
    return chunks.select("attribute", F.explode("values").alias("value", "count"), (F.size("values") <= 1000).alias("bounded"))


@register(
    "profile_histogram",
    over_cells(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS attribute, CAST(bin - 1 AS INTEGER) AS pos, bin_start AS break, count FROM ({_histogram_sql(c)})
            UNION ALL SELECT '{c}', 49, CAST(max({c}) AS DOUBLE), NULL FROM cells"""
            for c in _PROFILED_NUMBERS
        )
    ),
)
def _(spark, d):
    numbers = prof.numeric_summary(tables.cells(spark, d), _PROFILED_NUMBERS)
    return numbers.select("attribute", F.posexplode("histogram").alias("pos", "bucket")).select(
        "attribute", "pos", "bucket.break", "bucket.count"
    )


@register("profile_numeric", over_cells(" UNION ALL ".join(_numeric_sql(c) for c in _PROFILED_NUMBERS)))
def _(spark, d):
    numbers = prof.numeric_summary(tables.cells(spark, d), _PROFILED_NUMBERS)
    named = numbers.select("attribute", F.lit("number").alias("type"), "count", "countDistinct", "min", "max", "avg",
                           F.col("stddev_samp").alias("stddev"))
    return named.withColumn("avg", F.round("avg", 7)).withColumn("stddev", F.round("stddev", 7))


_SUMMARY_SQL = """SELECT '{0}' AS attribute, count({1}) AS count, count(DISTINCT {1}) AS "countDistinct" FROM cells"""


@register("profile_string", over_cells(" UNION ALL ".join(_SUMMARY_SQL.format(c, c) for c in _PROFILED_TEXTS)))
def _(spark, d):
    return prof.value_summary(prof.value_frequencies(tables.cells(spark, d), _PROFILED_TEXTS))


@register("profile_boolean", over_cells(_SUMMARY_SQL.format("discounted", _BOOLEAN_TEXT)))
def _(spark, d):
    return prof.value_summary(prof.value_frequencies(tables.cells(spark, d), ["discounted"]))


@register("profile_id", over_cells("SELECT 'id' AS attribute, count(DISTINCT id) AS count FROM cells"))
def _(spark, d):
    return prof.id_summary(tables.cells(spark, d), F.count_distinct("id")).select("attribute", "count")


@register(
    "value_topn",
    over_cells(
        " UNION ALL ".join(
            f"""(SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM cells
              WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, value LIMIT {limit})"""
            for c, limit in (("n", 10), ("l_partkey", 10), ("id", 50), ("flag", 50), ("discounted", 50))
        )
    ),
)
def _(spark, d):
    cells = tables.cells(spark, d)
    kinds = {"number": ["n", "l_partkey"], "string": ["id", "flag"], "boolean": ["discounted"]}
    limits = {c: prof.LISTED_VALUES[kind] for kind, names in kinds.items() for c in names}
    return prof.top_values(prof.all_frequencies(cells, kinds), limits).drop("rank")


def _bucket_sql(column: str, bins: int) -> str:
    return f"""
      SELECT '{column}' AS attribute, CAST(b AS INTEGER) AS bin, lo + (b - 1) * w AS break,
        round(count(v) / any_value(total), 9) AS count
      FROM (SELECT lo, hi, total, (hi - lo) / {bins}e0 AS w FROM (SELECT min({column}) AS lo, max({column}) AS hi,
              count({column}) AS total FROM cells)) CROSS JOIN range(1, {bins + 1}) r(b)
      LEFT JOIN (SELECT {column} AS v FROM cells) ON v >= lo + (b - 1) * w AND (b = {bins} OR v < lo + b * w)
      GROUP BY b, lo, w
      UNION ALL SELECT '{column}', {bins + 1}, max({column}), NULL FROM cells"""


@register("bucket_fraction", over_cells(_bucket_sql("l_extendedprice", 49) + " UNION ALL " + _bucket_sql("tax", 49)))
def _(spark, d):
    buckets = hl.equal_interval_buckets(tables.cells(spark, d), ["l_extendedprice", "tax"], fraction=True)
    return buckets.withColumn("count", F.round("count", 9))


@register(
    "eligible_columns",
    over_cells(
        " UNION ALL ".join(
            f"SELECT '{c}' AS attribute, '{t}' AS type, count({c}) AS count FROM cells"
            for c, t in [("id", "string"), *((c, "number") for c in _PROFILED_NUMBERS),
                         *((c, "string") for c in _PROFILED_TEXTS), ("discounted", "boolean")]
        )
    ),
)
def _(spark, d):
    cells = tables.cells(spark, d)
    listed = [F.struct(F.lit(c).alias("attribute"), F.lit(t).alias("type"), F.count(c).alias("count"))
              for c, t in hl.eligible_columns(cells)]
    return cells.agg(F.array(*listed).alias("rows")).select(F.inline("rows"))


@register("max_version", "SELECT CAST(max(l_linenumber) AS BIGINT) AS version FROM lineitem")
def _(spark, d):
    return prof.latest_version(_versions(spark, d))


# --- layers, geometry text, attribute joins ----------------------------------------------------


@register(
    "cell_pyramid",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        query="SELECT lower(hex(id)) AS id, CAST(resolution AS INTEGER) AS resolution, "
        + ", ".join(
            f"CASE WHEN {r} <= resolution THEN lower(hex({parent('id', r)})) END AS r{r}_id" for r in range(12)
        )
        + ", CAST(7 AS INTEGER) AS points, round(lon + w * 0.49e0, 9) AS lon, round(lat, 9) AS lat FROM centers",
    ),
)
def _(spark, d):
    folder = tables.shared_folder(spark)
    layers = hl.build_cell_pyramid(tables.cells(spark, d).select("id"), tables.geometry(spark, d, ordered=True))
    sources.write_cell_pyramid(layers, folder, placed=True)
    ring = geometry.wkt_to_ring(F.col("wkt"))
    return spark.read.parquet(folder).select(
        "id",
        "resolution",
        *(f"r{r}_id" for r in range(12)),
        F.size(ring).alias("points"),
        F.round(F.element_at(ring, -1)["lon"], 9).alias("lon"),
        F.round(F.element_at(ring, -1)["lat"], 9).alias("lat"),
    )


@register("extract_ids", over_cells("SELECT id, count(*) AS rows FROM cells GROUP BY id"))
def _(spark, d):
    ids = hl.extract_cell_ids(tables.cells(spark, d).withColumnRenamed("id", "GRID_ID"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


_TEXT_SQL = """texts AS (SELECT id, 'POLYGON((' || string_agg(CAST(CAST(round((lon + {shift}) * 1e6) AS BIGINT) AS VARCHAR)
  || ' ' || CAST(CAST(round(lat * 1e6) AS BIGINT) AS VARCHAR), ', ' ORDER BY k) || '))' AS wkt
  FROM vertices GROUP BY id)"""


def _open_wkt(ring, shift: float = 0.0):
    def point(p):
        whole = [F.round((p["lon"] + shift) * 1e6).cast("long"), F.round(p["lat"] * 1e6).cast("long")]
        return F.concat_ws(" ", *(w.cast("string") for w in whole))

    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, point), ", "), F.lit("))"))


@register(
    "close_wkt",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        VERTICES,
        _TEXT_SQL.format(shift="0e0"),
        query="""SELECT id, 'POLYGON((' || regexp_extract(wkt, '\\(\\((.*)\\)\\)', 1) || ', '
          || regexp_extract(wkt, '\\(\\(([^,]*),', 1) || '))' AS wkt FROM texts""",
    ),
)
def _(spark, d):
    rings = tables.stored_geometry(spark, d)
    return rings.select("id", geometry.close_polygon_wkt(_open_wkt(F.col("ring"))).alias("wkt"))


@register(
    "multipolygon_parts",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        VERTICES,
        _TEXT_SQL.format(shift="0e0"),
        _TEXT_SQL.format(shift="1e0").replace("texts AS", "shifted AS"),
        query="""SELECT id, CAST(0 AS INTEGER) AS part, replace(wkt, 'POLYGON((', 'POLYGON ((') AS wkt FROM texts
          UNION ALL SELECT id, 1, replace(wkt, 'POLYGON((', 'POLYGON ((') FROM shifted""",
    ),
)
def _(spark, d):
    rings = tables.geometry(spark, d)
    first = F.regexp_replace(_open_wkt(F.col("ring")), "^POLYGON", "")
    second = F.regexp_replace(_open_wkt(F.col("ring"), 1.0), "^POLYGON", "")
    both = F.concat(F.lit("MULTIPOLYGON ("), first, F.lit(", "), second, F.lit(")"))
    texts = rings.select("id", both.alias("text"))  # a column, so that the function's uses of it don't build the text again
    return texts.select("id", F.posexplode(geometry.multipolygon_parts(F.col("text"))).alias("part", "wkt"))


_COARSE_SQL = """
coarse_rows AS (
  SELECT lower(hex(r9_id)) AS id, r9_id AS cell, n, l_extendedprice AS p, flag AS f
  FROM cells WHERE (r9_id >> 18) % 3 <> 0),
coarse AS (
  SELECT id, cell, p, f, row_number() OVER (ORDER BY cell) - 1 AS place, count(*) OVER () AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p DESC) AS rn FROM coarse_rows) WHERE rn = 1)"""


def _coarse(cells: DataFrame) -> DataFrame:
    """All rows of the hexagons that the table has, two thirds of them; ids are repeated, the last by (n, p) counts."""
    return cells.where("shiftright(r9_id, 18) % 3 <> 0").select(
        cellid.cell_to_string(F.col("r9_id")).alias("id"),
        F.col("l_extendedprice").alias("p"),
        F.col("flag").alias("f"),
        "n",
        F.col("l_extendedprice").alias("price"),
    )


@register(
    "join_attributes",
    sql(CELLS, _COARSE_SQL, query="SELECT c.id, a.p, a.f FROM cells c LEFT JOIN coarse a ON a.cell = c.r9_id"),
)
def _(spark, d):
    cells = tables.cells(spark, d)
    return join_attributes(cells.select("id"), _coarse(cells), order_by=["n", "price"], fallback=False).select("id", "p", "f")


_FALLBACK_SQL = """
  SELECT c.id, CASE WHEN a.id IS NOT NULL THEN a.p ELSE b.p END AS p, CASE WHEN a.id IS NOT NULL THEN a.f ELSE b.f END AS f
  FROM cells c LEFT JOIN coarse a ON a.cell = c.r9_id
  LEFT JOIN coarse b ON b.place = CAST('0x' || substr(md5(c.id || '7'), 1, 15) AS BIGINT) % b.total"""


@register("join_attributes_fallback", sql(CELLS, _COARSE_SQL, query=_FALLBACK_SQL))
def _(spark, d):
    cells = tables.cells(spark, d)
    return join_attributes(cells.select("id"), _coarse(cells), order_by=["n", "price"], seed="7").select("id", "p", "f")


# --- files -------------------------------------------------------------------------------------


@register("csv_export_roundtrip", over_cells(f"SELECT {_ALL.split('r4_id, ')[1]} FROM cells"))
def _(spark, d):
    folder = tables.shared_folder(spark)
    sources.export_csv(tables.cells(spark, d), folder)
    return sources.read_cells_csv(spark, folder, id_column="id")


@register("joined_csv_roundtrip", sql(CELLS, _COARSE_SQL, query=_FALLBACK_SQL))
def _(spark, d):
    cells, folder = tables.cells(spark, d), tables.shared_folder(spark)
    _coarse(cells).write.csv(f"{folder}/coarse", header=True)
    coarse = sources.read_coarse_csv(spark, f"{folder}/coarse")
    typed = coarse.withColumn("n", F.col("n").cast("long")).withColumn("price", F.col("price").cast("double"))
    joined = join_attributes(
        cells.select("id"), typed, order_by=["n", "price", "_file", "_block", "_line"], seed="7"
    )
    sources.write_joined_csv(joined, f"{folder}/joined")
    return spark.read.csv(f"{folder}/joined", header=True, schema="id string, p double, f string")


@register(
    "profile_file",
    over_cells(
        " UNION ALL ".join(
            [_numeric_sql(c, "stddev_pop") for c in _PROFILED_NUMBERS]
            + [_plain_sql(c, "string", c) for c in _PROFILED_TEXTS]
            + [_plain_sql("discounted", "boolean", "discounted")]
            + [_plain_sql("id", "string", "id")]
        )
    ),
)
def _(spark, d):
    folder = tables.shared_folder(spark)
    sources.export_csv(tables.cells(spark, d), folder)
    return _flat(hl.profile_file(sources.read_cells_csv(spark, folder, id_column="id")), "stdev")


@register("profile_json_roundtrip", over_cells(f"SELECT * FROM ({_PROFILE_SQL})"))
def _(spark, d):
    cells, folder = tables.cells(spark, d), tables.shared_folder(spark)
    sources.write_profile(hl.profile(cells, _versions(spark, d)), hl.profile_values(cells), folder)
    attributes, _ = sources.read_profile(spark, folder)
    return _flat(attributes)


# --- batches, filter tables, sketches, texts ---------------------------------------------------


@register("tile_index_append", over_tiles("SELECT geohash, id, resolution, zoom FROM tile_index"))
def _(spark, d):
    cells, geo, folder = tables.stored_cells(spark, d), tables.stored_geometry(spark, d), tables.shared_folder(spark)
    for batch, part in (("first", "n % 3 = 0"), ("second", "n % 3 > 0"), ("first", "n % 3 < 2")):
        sources.append_tile_index(cells.where(part), geo, folder, batch)
    return sources.read_tile_index(spark, folder).drop("batch")


#: Every filter of the filter queries and one for each pair of a quantity and a flag, as rows.
_FILTER_ROWS = [(name, filters, where) for name, (filters, where) in _FILTERS.items()] + [
    (f"{low}-{flag}", {"l_quantity": {"min": low}, "flag": {"choices": [flag]}}, f"l_quantity >= {low} AND flag = '{flag}'")
    for low in range(1, 51, 7)
    for flag in "ANR"
]


@register(
    "count_filters",
    over_cells(
        " UNION ALL ".join(
            f"SELECT '{name}' AS filter_id, count(DISTINCT r11_id) AS count FROM cells WHERE {where}" for name, _, where in _FILTER_ROWS
        )
    ),
)
def _(spark, d):
    rows = [(name, None if filters is None else json.dumps(filters)) for name, filters, _ in _FILTER_ROWS]
    return hl.count_filters(tables.cells(spark, d), spark.createDataFrame(rows, "filter_id string, filter string"))


@register(
    "filter_dispatch",
    over_cells(
        "SELECT 'number' AS shape, count(DISTINCT r11_id) AS count FROM cells WHERE l_quantity >= 30"
        " UNION ALL SELECT 'boolean', count(DISTINCT r11_id) FROM cells WHERE discounted"
    ),
)
def _(spark, d):
    shapes = {
        "number": {"l_quantity": {"choices": ["1"], "bool": True, "min": 30}},
        "boolean": {"discounted": {"choices": ["false"], "bool": True}},
    }
    counts = [hl.count_cells(tables.cells(spark, d), f).select(F.lit(shape).alias("shape"), "count") for shape, f in shapes.items()]
    return counts[0].unionAll(counts[1])


_SKETCHED_SQL = " UNION ALL ".join(
    f"SELECT r{r}_id AS id, CAST({r} AS INTEGER) AS resolution, count(DISTINCT l_partkey) AS parts, true AS close FROM cells GROUP BY r{r}_id"
    for r in tiles.STOPS
)


@register("distinct_sketch_pyramid", over_cells(_SKETCHED_SQL))
def _(spark, d):
    """The exact count of each hexagon, and whether the sketch's is within a tenth (six standard errors) of it."""
    cells = tables.cells(spark, d)
    above = {r: cellid.cell_to_parent(F.col("r11_id"), r, checked=False) for r in tiles.STOPS}
    levels = F.array(*(F.struct(cell.alias("id"), F.lit(r).alias("resolution")) for r, cell in above.items()))
    # values of a cell move once, by the coarsest hexagon, and are spread to all resolutions there
    values = dealt(cells.select("r11_id", "l_partkey").distinct().withColumn("family", above[min(tiles.STOPS)]), "family")
    spread = values.select("family", F.inline(levels), "l_partkey").groupBy("family", "id", "resolution")
    exact = spread.agg(F.count_distinct("l_partkey").alias("parts")).select("id", "resolution", "parts")
    guess = hl.distinct_sketch_pyramid(cells, "l_partkey").select("id", F.hll_sketch_estimate("sketch").alias("guess"))
    close = F.abs(F.col("guess") - F.col("parts")) <= 0.1 * F.col("parts")
    return exact.join(guess, "id").select("id", "resolution", "parts", close.alias("close"))


@register("approximate_count", over_cells(f"SELECT count(DISTINCT r11_id) AS cells, true AS close FROM cells WHERE {_MIXED_SQL}"))
def _(spark, d):
    cells = tables.cells(spark, d)
    exact = hl.count_cells(cells, _MIXED).select(F.lit(1).alias("one"), F.col("count").alias("cells"))
    guess = hl.approximate_count(cells, _MIXED).select(F.lit(1).alias("one"), F.col("count").alias("guess"))
    return exact.join(guess, "one").select("cells", (F.abs(F.col("guess") - F.col("cells")) <= 0.1 * F.col("cells")).alias("close"))


@register(
    "inline_ids",
    over_cells("SELECT r11_id, n FROM cells WHERE r11_id IN (SELECT r11_id FROM cells WHERE n % 97 = 5) OR r7_id = (SELECT max(r7_id) FROM cells)"),
)
def _(spark, d):
    """Ids given as literals, of two resolutions."""
    cells = tables.stored_cells(spark, d)
    some = [r.id for r in cells.where("n % 97 = 5").select("id").distinct().collect()]
    last = cells.agg(cellid.cell_to_string(F.max("r7_id"))).first()[0]
    return hl.select_cells(cells, ids=[*some, last]).select("r11_id", "n")


@register("bucket_counts", over_cells(re.sub(r"round\(count\(v\) / any_value\(total\), 9\)", "CAST(count(v) AS DOUBLE)", _bucket_sql("l_extendedprice", 49) + " UNION ALL " + _bucket_sql("tax", 49))))
def _(spark, d):
    return hl.equal_interval_buckets(tables.cells(spark, d), ["l_extendedprice", "tax"]).withColumn("count", F.col("count").cast("double"))


@register(
    "csv_quoted",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', \"' || c_mktsegment || '\"' AS name, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS nation,"
    " CASE WHEN c_custkey % 5 > 0 THEN c_acctbal > 0 END AS paid FROM customer",
)
def _(spark, d):
    """Texts with commas and quotes, written as CSV and read back with a type for each column."""
    folder = tables.shared_folder(spark)
    named = tables.table(spark, d, "customer").selectExpr(
        "cast(c_custkey as string) as GRID_ID", "c_name || ', \"' || c_mktsegment || '\"' as name", "c_acctbal as balance",
        "c_nationkey as nation", "case when c_custkey % 5 > 0 then c_acctbal > 0 end as paid",
    )
    named.write.csv(folder, header=True, quote='"', escape='"')
    kinds = {"bigint": "bigint", "int": "bigint", "double": "double"}
    nation = kinds[dict(named.dtypes)["nation"]]
    return sources.read_cells_csv(spark, folder, schema=f"GRID_ID string, name string, balance double, nation {nation}, paid boolean")


@register(
    "id_to_polygon",
    sql(
        CELLS,
        HEXES,
        CENTERS,
        VERTICES,
        _TEXT_SQL.format(shift="0e0"),
        query="""SELECT lower(hex(id)) AS id, 'POLYGON((' || regexp_extract(wkt, '\\(\\((.*)\\)\\)', 1) || ', '
          || regexp_extract(wkt, '\\(\\(([^,]*),', 1) || '))' AS wkt FROM texts""",
    ),
)
def _(spark, d):
    """Each hexagon's multipolygon text as one closed polygon, by the SQL function."""
    register_sql_functions(spark)
    several = F.concat(F.lit("MULTIPOLYGON ("), F.regexp_replace(_open_wkt(F.col("ring")), "^POLYGON", ""), F.lit(")"))
    texts = tables.geometry(spark, d).select(cellid.cell_to_string(F.col("id")).alias("id"), several.alias("multipolygon"))
    return texts.select(F.expr("h3_id_to_simple_polygon(id, multipolygon)").alias("polygon")).select("polygon.*")
