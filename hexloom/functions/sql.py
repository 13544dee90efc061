"""The cell, tile and WKT functions for SQL text, as temporary SQL functions.

Spark inlines their bodies into the plan, so they cost what the Column forms cost.  Names follow the
usual ones of cell and spatial SQL extensions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from hexloom.functions.cellid import PENTAGON_BASE_CELLS
from hexloom.functions.tiles import zoom_bands

_PENTAGONS = ", ".join(str(cell) for cell in PENTAGON_BASE_CELLS)
_ZOOMS = " ".join(f"WHEN zoom <= {last} THEN {res}" for res, (_, last) in sorted(zoom_bands().items())[:-1])

SQL_FUNCTIONS = {
    "h3_string_to_h3": (
        "id STRING",
        "BIGINT",
        "CASE WHEN id RLIKE '^0?[0-9a-fA-F]{15}$' THEN CAST(conv(id, 16, 10) AS BIGINT) END",
    ),
    "h3_h3_to_string": ("cell BIGINT", "STRING", "lower(hex(cell))"),
    "h3_get_resolution": ("cell BIGINT", "INT", "CAST(shiftright(cell, 52) & 15 AS INT)"),
    "h3_cell_to_parent": (
        "cell BIGINT, res INT",
        "BIGINT",
        "CASE WHEN res BETWEEN 0 AND (shiftright(cell, 52) & 15) THEN (cell & ~shiftleft(15L, 52))"
        " | shiftleft(CAST(res AS BIGINT), 52) | (shiftleft(1L, 3 * (15 - res)) - 1) END",
    ),
    "h3_is_valid_cell": (
        "cell BIGINT",
        "BOOLEAN",
        "coalesce(shiftright(cell, 56) = 8 AND (shiftright(cell, 45) & 127) <= 121"
        " AND substr(lpad(conv(CAST(cell & (shiftleft(1L, 45) - 1) AS STRING), 10, 8), 15, '0'),"
        " CAST(shiftright(cell, 52) & 15 AS INT) + 1) RLIKE '^7*$'"
        " AND NOT contains(substr(lpad(conv(CAST(cell & (shiftleft(1L, 45) - 1) AS STRING), 10, 8), 15, '0'), 1,"
        " CAST(shiftright(cell, 52) & 15 AS INT)), '7')"
        f" AND NOT ((shiftright(cell, 45) & 127) IN ({_PENTAGONS})"
        " AND substr(lpad(conv(CAST(cell & (shiftleft(1L, 45) - 1) AS STRING), 10, 8), 15, '0'), 1,"
        " CAST(shiftright(cell, 52) & 15 AS INT)) RLIKE '^0*1'), false)",
    ),
    "tile_to_quadkey": (
        "x BIGINT, y BIGINT, zoom INT",
        "STRING",
        "lpad(CAST(CAST(bin(x) AS BIGINT) + 2 * CAST(bin(y) AS BIGINT) AS STRING), zoom, '0')",
    ),
    "zoom_to_h3_resolution": ("zoom INT", "INT", f"CASE {_ZOOMS} ELSE {max(zoom_bands())} END"),
    "close_polygon_wkt": (
        "wkt STRING",
        "STRING",
        # the rings, each trimmed point by point, with the first point again where the last one differs
        r"CASE WHEN upper(ltrim(wkt)) LIKE 'POLYGON%' AND size(regexp_extract_all(wkt, r'\(([^()]+)\)', 1)) > 0 THEN"
        r" concat('POLYGON(', array_join(transform(transform(regexp_extract_all(wkt, r'\(([^()]+)\)', 1),"
        " ring -> transform(split(ring, ','), point -> trim(point))),"
        " points -> concat('(', array_join(points, ', '), if(element_at(points, -1) = points[0], '', concat(', ', points[0])), ')')),"
        " ', '), ')') ELSE wkt END",
    ),
    "polygon_from_multipolygon_wkt": (
        "wkt STRING",
        "ARRAY<STRING>",
        "CASE WHEN upper(ltrim(wkt)) LIKE 'MULTIPOLYGON%EMPTY' THEN array()"
        " WHEN upper(ltrim(wkt)) LIKE 'MULTIPOLYGON%' THEN transform(split(regexp_replace(wkt,"
        r" r'(?i)^\s*MULTIPOLYGON\s*\(\s*\(\(|\)\)\s*\)\s*$', ''), r'\)\)\s*,\s*\(\('),"
        " part -> concat('POLYGON ((', trim(part), '))')) ELSE array(wkt) END",
    ),
    # uses the two above: create them in this order
    "h3_id_to_simple_polygon": (
        "id STRING, multipolygon STRING",
        "STRUCT<id: STRING, wkt: STRING>",
        "named_struct('id', id, 'wkt', close_polygon_wkt(get(polygon_from_multipolygon_wkt(multipolygon), 0)))",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
