"""DuckDB SQL equal to the registered queries: independent statements over the same tables."""

from __future__ import annotations

CELLS = """
cells_n AS (
  SELECT CAST((l_orderkey * 8 + l_linenumber) % 1977326743 AS BIGINT) AS n, l_quantity, l_extendedprice, l_discount,
    l_partkey, l_returnflag, l_linestatus,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount > 0.05e0 END AS discounted,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag
  FROM lineitem),
cells_h AS (
  SELECT (CAST(1 AS BIGINT) << 59) + (CAST(11 AS BIGINT) << 52) + (CAST(34 AS BIGINT) << 45) + 4095
    + ((n // 282475249 % 7) << 42) + ((n // 40353607 % 7) << 39) + ((n // 5764801 % 7) << 36)
    + ((n // 823543 % 7) << 33) + ((n // 117649 % 7) << 30) + ((n // 16807 % 7) << 27)
    + ((n // 2401 % 7) << 24) + ((n // 343 % 7) << 21) + ((n // 49 % 7) << 18)
    + ((n // 7 % 7) << 15) + ((n % 7) << 12) AS r11_id, *
  FROM cells_n),
cells AS (
  SELECT r11_id, {parents}, lower(hex(r11_id)) AS id, n, l_quantity, l_extendedprice, l_discount, l_partkey,
    l_returnflag, l_linestatus, tax, discounted, flag
  FROM cells_h)"""


def parent(cell: str, res: int) -> str:
    return (
        f"(({cell} & ~(CAST(15 AS BIGINT) << 52)) | (CAST({res} AS BIGINT) << 52)"
        f" | ((CAST(1 AS BIGINT) << {3 * (15 - res)}) - 1))"
    )


CELLS = CELLS.format(parents=", ".join(f"{parent('r11_id', r)} AS r{r}_id" for r in range(10, 3, -1)))

HEXES = "hexes AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT r{res}_id AS id, {res} AS resolution, n // {7 ** (11 - res)} AS idx FROM cells"
    for res in range(6, 12)
) + ")"

CENTERS = """
centers AS (
  SELECT id, h.resolution, w, zoom, -82.0e0 + (idx % 64 + 0.503e0) * w AS lon,
    24.5e0 + ((idx // 64) % nrows + 0.507e0) * w AS lat
  FROM hexes h JOIN (VALUES (11, 0.0005e0, 80000, 14), (10, 0.00132e0, 30000, 13), (9, 0.0035e0, 11400, 12),
    (8, 0.00926e0, 4300, 10), (7, 0.0245e0, 1630, 8), (6, 0.0648e0, 610, 6)) g(resolution, w, nrows, zoom)
  ON g.resolution = h.resolution)"""

VERTICES = """
vertices AS (
  SELECT id, resolution, zoom, k, lon + w * dx AS lon, lat + w * dy AS lat
  FROM centers CROSS JOIN (VALUES (0, 0.49e0, 0.0e0), (1, 0.245e0, 0.424e0), (2, -0.245e0, 0.424e0),
    (3, -0.49e0, 0.0e0), (4, -0.245e0, -0.424e0), (5, 0.245e0, -0.424e0)) c(k, dx, dy))"""

QUADKEY = "array_to_string([((x >> b) & 1) + 2 * ((y >> b) & 1) for b in range({z} - 1, -1, -1)], '')"

COVER = f"""
fractions AS (
  SELECT id, resolution, zoom, k, (lon + 180e0) / 360e0 * (1 << zoom) AS px,
    (0.5e0 - 0.25e0 * ln((1e0 + sin(lat * pi() / 180e0)) / (1e0 - sin(lat * pi() / 180e0))) / pi()) * (1 << zoom) AS py
  FROM vertices),
sides AS (
  SELECT a.id, a.px, a.py, b.px - a.px AS dx, b.py - a.py AS dy
  FROM fractions a JOIN fractions b ON a.id = b.id AND b.k = (a.k + 1) % 6),
columns_x AS (
  SELECT id, resolution, zoom, unnest(range(x0, x1 + 1)) AS x, y0, y1
  FROM (SELECT id, resolution, zoom, CAST(floor(min(px)) AS BIGINT) AS x0, CAST(floor(max(px)) AS BIGINT) AS x1,
          CAST(floor(min(py)) AS BIGINT) AS y0, CAST(floor(max(py)) AS BIGINT) AS y1
        FROM fractions GROUP BY id, resolution, zoom)),
candidates AS (SELECT id, resolution, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM columns_x),
touched AS (
  SELECT c.id, resolution, zoom, x, y
  FROM candidates c JOIN sides s ON c.id = s.id
  GROUP BY c.id, resolution, zoom, x, y
  HAVING max(least(dx * (y - py) - dy * (x - px), dx * (y - py) - dy * (x + 1 - px),
                   dx * (y + 1 - py) - dy * (x - px), dx * (y + 1 - py) - dy * (x + 1 - px))) < 0),
tile_index AS (
  SELECT {QUADKEY.format(z="zoom")} AS geohash, id, resolution, zoom FROM touched)"""


def sql(*ctes: str, query: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + query


def over_cells(query: str) -> str:
    return sql(CELLS, query=query)


def over_tiles(query: str) -> str:
    return sql(CELLS, HEXES, CENTERS, VERTICES, COVER, query=query)
