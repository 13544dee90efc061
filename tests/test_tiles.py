import math

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.functions import tiles

SAMPLE_RING = [
    (-81.9336880175533, 24.532357165118),
    (-81.9377015564132, 24.5349778311727),
    (-81.9420523013835, 24.532796637661),
    (-81.9423890725121, 24.5279947373529),
    (-81.938375407226, 24.5253743322599),
    (-81.9340250972132, 24.5275555665127),
    (-81.9336880175533, 24.532357165118),
]


def tile_of(lon, lat, zoom):
    n, s = 2**zoom, math.sin(math.radians(lat))
    return int((lon + 180) / 360 * n), int((0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi) * n)


def lon_of(x, zoom):
    return x / 2**zoom * 360 - 180


def lat_of(y, zoom):
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**zoom))))


def cover(spark, ring, zoom):
    rows = spark.createDataFrame([(1, 9, zoom, ring)], "id long, resolution int, zoom int, ring array<struct<lon:double,lat:double>>")
    return {r["geohash"] for r in hl.tile_cover(rows).collect()}


@pytest.mark.parametrize(
    "zoom, res",
    [(0, 6), (6, 6), (7, 7), (8, 7), (9, 8), (10, 8), (11, 9), (12, 9), (13, 10), (14, 11), (15, 11), (20, 11)],
)
def test_resolution_for_zoom(spark, zoom, res):
    assert tiles.resolution_for_zoom(zoom) == res
    assert spark.range(1).select(tiles.zoom_to_resolution(F.lit(zoom))).first()[0] == res


def test_zoom_bands_cover_each_zoom_once():
    zooms = [z for low, high in tiles.zoom_bands().values() for z in range(low, high + 1)]
    assert sorted(zooms) == list(range(15))


@pytest.mark.parametrize("z, x, y, key", [(0, 0, 0, ""), (1, 1, 0, "1"), (3, 3, 5, "213"), (4, 1, 0, "0001"), (19, 2**19 - 1, 2**19 - 1, "3" * 19)])
def test_quadkey(spark, z, x, y, key):
    assert tiles.tile_quadkey(z, x, y) == key
    assert spark.range(1).select(tiles.quadkey(F.lit(x).cast("long"), F.lit(y).cast("long"), z)).first()[0] == key


@pytest.mark.parametrize("tile", [(-1, 0, 0), (2, 4, 0), (2, 0, -1), (2, 1.5, 0), ("2", 0, 0), (True, 0, 0)])
def test_bad_tiles(tile):
    with pytest.raises(ValueError):
        tiles.check_tile(*tile)


@pytest.mark.parametrize("zoom", [6, 12, 14, 16, 18])
def test_cover_of_a_ring_is_found_by_points(spark, zoom):
    """Every tile with a point of the hexagon is found, and every found tile is in its box."""
    found = cover(spark, SAMPLE_RING, zoom)
    mid = [sum(p[i] for p in SAMPLE_RING[:-1]) / 6 for i in (0, 1)]
    seen = set()
    for a, b in zip(SAMPLE_RING, SAMPLE_RING[1:]):
        for i in range(60):
            for j in range(60 - i):
                u, v = i / 60, j / 60
                lon = mid[0] + u * (a[0] - mid[0]) + v * (b[0] - mid[0])
                lat = mid[1] + u * (a[1] - mid[1]) + v * (b[1] - mid[1])
                x, y = tile_of(lon, lat, zoom)
                seen.add(tiles.tile_quadkey(zoom, x, y))
    assert seen <= found
    assert len(found) <= len(seen) + 4


def test_cover_ignores_winding_and_closing(spark):
    opened = SAMPLE_RING[:-1]
    assert cover(spark, SAMPLE_RING, 16) == cover(spark, opened, 16) == cover(spark, opened[::-1], 16)


def test_cover_leaves_out_a_box_corner(spark):
    """A diamond around a tile corner touches four tiles; moved away from it, the box does but it does not."""
    x, y, zoom = 1116, 1759, 12
    size = 0.2

    def diamond(cx, cy):
        points = [(cx + size, cy), (cx, cy - size), (cx - size, cy), (cx, cy + size)]
        return [(lon_of(px, zoom), lat_of(py, zoom)) for px, py in points]

    assert len(cover(spark, diamond(x, y), zoom)) == 4
    assert len(cover(spark, diamond(x + 0.15, y + 0.15), zoom)) == 3
    assert len(cover(spark, diamond(x + 0.5, y + 0.5), zoom)) == 1


def test_touching_only_an_edge_is_no_overlap(spark):
    """A square that ends exactly on a tile edge does not touch the next tile."""
    ring = [(0.0, 0.0), (lon_of(2048.5, 12), 0.0), (lon_of(2048.5, 12), lat_of(2047.5, 12)), (0.0, lat_of(2047.5, 12))]
    assert cover(spark, ring, 12) == {tiles.tile_quadkey(12, 2048, 2047)}


def test_cover_over_the_antimeridian(spark):
    ring = [(179.99, 10.0), (-179.99, 10.0), (-179.99, 10.02), (179.99, 10.02)]
    columns = {key[0] for key in cover(spark, ring, 1)}
    assert columns == {"0", "1"}
    assert len(cover(spark, ring, 10)) <= 4


def test_every_hexagon_is_in_the_index(cells, tile_index):
    assert hl.hexagons(cells).join(tile_index, ["id", "resolution"], "left_anti").count() == 0


def test_index_zooms(tile_index):
    pairs = {(r["resolution"], r["zoom"]) for r in tile_index.select("resolution", "zoom").distinct().collect()}
    assert pairs <= set(tiles.STOPS.items())
    assert tile_index.where(F.length("geohash") != F.col("zoom")).count() == 0


def test_pyramid_equals_single_tiles(cells, tile_index):
    filters = {"l_quantity": {"min": 5, "max": 20}}
    pyramid = hl.tile_pyramid(cells, tile_index, filters).cache()
    keys = pyramid.select("z", "quadkey").distinct().orderBy("z", "quadkey").collect()
    picks = {r["z"]: r["quadkey"] for r in keys}
    assert sorted(picks) == list(range(15))
    for z, key in picks.items():
        x = sum((int(d) & 1) << (z - 1 - i) for i, d in enumerate(key))
        y = sum((int(d) >> 1) << (z - 1 - i) for i, d in enumerate(key))
        columns = ["h3", "count", "all_count", "resolution", "fractionMatching"]
        one = hl.tile_counts(cells, tile_index, z, x, y, filters).select(columns)
        rows = pyramid.where((F.col("z") == z) & (F.col("quadkey") == key)).select(columns)
        assert sorted(one.collect()) == sorted(rows.collect())
    pyramid.unpersist()


def test_counts_are_bounded(cells, tile_index):
    rows = hl.tile_counts(cells, tile_index, 0, 0, 0, {"flag": {"choices": ["A"]}}).collect()
    assert rows and all(0 < r["count"] <= r["all_count"] for r in rows)


def test_large_tile_takes_the_grouped_way(cells, tile_index, no_broadcast):
    from hexloom.plans.registry import QUERIES  # noqa: F401  (the same tables)

    filters = {"l_returnflag": {"choices": ["A", "R"]}}
    rows = hl.tile_counts(cells, tile_index, 0, 0, 0, filters)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    expected = cells.groupBy("r6_id").agg(
        F.count_if(F.col("l_returnflag").isin("A", "R")).alias("count"), F.count("*").alias("all_count")
    )
    assert sorted((r["count"], r["all_count"]) for r in rows.collect()) == sorted(
        (r["count"], r["all_count"]) for r in expected.collect()
    )
