"""Containment in a table of polygons against plain ray casting."""

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.functions import geometry
from hexloom.operators import containment


def plain(rings, lon, lat):
    wraps = any(abs(a[0] - b[0]) > 180 for r in rings for a, b in zip(r, r[1:] + r[:1]))
    east = lambda x: x + 360 if wraps and x < 0 else x
    inside = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            x1, x2 = east(x1), east(x2)
            if (y1 > lat) != (y2 > lat) and east(lon) < (x2 - x1) * ((lat - y1) / (y2 - y1)) + x1:
                inside = not inside
    return inside


POLYGONS = {
    "box": [[(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)]],
    "holed": [[(-40.0, 0.0), (0.0, -40.0), (40.0, 0.0), (0.0, 40.0)], [(-5.0, -5.0), (5.0, -5.0), (0.0, 5.0)]],
    "dateline": [[(170.0, -20.0), (-160.0, -25.0), (-170.0, 30.0), (175.0, 20.0), (-178.0, 0.0)]],
    "pole": [[(0.0, 80.0), (90.0, 84.0), (170.0, 89.5), (100.0, 70.0)]],
    "wide": [[(-170.0, -60.0), (0.0, -50.0), (170.0, -60.0), (170.0, 60.0), (0.0, 10.0), (-170.0, 60.0)]],
    "sliver": [[(20.001, 20.0), (20.002, 20.0), (20.0025, 20.4)]],
    "parts": [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)], [(60.0, 50.0), (61.0, 50.0), (61.0, 51.0)]],
}


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [(name, [[{"lon": x, "lat": y} for x, y in r] for r in rings]) for name, rings in POLYGONS.items()]
    return spark.createDataFrame([*rows, ("none", None), ("empty", [])], "polygon_id string, rings array<array<struct<lon:double,lat:double>>>")


@pytest.fixture(scope="module")
def centers(spark):
    points = [(-180 + i * 7.37 % 360, -89.5 + i * 3.71 % 179) for i in range(3000)]
    points += [(20 + i * 0.0001, 20 + i * 0.007) for i in range(50)] + [(50.5 + i % 3 * 5, 50 + i * 0.02) for i in range(40)]
    points += [(180.0, 0.5), (-180.0, 0.5), (179.99, -3.0), (-10.0, -10.0), (10.0, 10.0), (0.0, 90.0), (90.0, -90.0)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "id long, lon double, lat double")


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_ray_casting(request, polygons, centers, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    want = {(n, r.id) for r in centers.where("id >= 0").collect() for n, rings in POLYGONS.items() if plain(rings, r.lon, r.lat)}
    found = [tuple(r) for r in hl.cells_in_polygons(centers, polygons).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {n for n, _ in want} == set(POLYGONS)


def test_literal_polygon_over_the_antimeridian(centers):
    rings = [[list(p) for p in r] for r in POLYGONS["dateline"]]
    found = {r.id for r in hl.cells_in_polygon(centers, {"type": "Polygon", "coordinates": rings}).collect()}
    assert found == {r.id for r in centers.where("id >= 0").collect() if plain(POLYGONS["dateline"], r.lon, r.lat)}


def test_large_tiles_are_decided_whole(polygons):
    cover = hl.polygon_cover(polygons.where("polygon_id = 'box'"))
    inner = cover.where("edges is null")
    assert inner.select(F.length("path")).distinct().count() > 1
    assert inner.where(F.length("path") < max(containment.LEVELS)).count() > 0
    assert cover.where("edges is not null").select(F.max(F.size("edges"))).first()[0] <= 4


def test_short_rings_fail(spark, centers):
    bad = spark.createDataFrame([("two", [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])], "polygon_id string, rings array<array<struct<lon:double,lat:double>>>")
    with pytest.raises(Exception, match="three distinct points, polygon two"):
        hl.cells_in_polygons(centers, bad).collect()


def test_rings_of_texts(spark):
    texts = [
        ('{"type": "Polygon", "coordinates": [[[0, 1], [2, 3], [4, 5.5]]]}', "POLYGON ((0 1, 2 3, 4 5.5))"),
        ('{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 1], [2, 3], [4, 5]]], [[[6, 7], [8, 9], [1, 1]]]]}}', "MULTIPOLYGON (((0 1, 2 3, 4 5)), ((6 7, 8 9, 1 1)))"),
        ('{"type": "Point", "coordinates": [0, 1]}', "POINT (0 1)"),
    ]
    rows = spark.createDataFrame(texts, "j string, w string").select(geometry.geojson_rings(F.col("j")).alias("j"), geometry.wkt_rings(F.col("w")).alias("w")).collect()
    assert all(r.j == r.w for r in rows) and rows[2].j is None and [len(r.j) for r in rows[:2]] == [1, 2]


def test_tiles_cut_by_their_centres_find_the_same(monkeypatch, polygons, centers):
    want = {(n, r.id) for r in centers.where("id >= 0").collect() for n, rings in POLYGONS.items() if plain(rings, r.lon, r.lat)}
    for name, value in {"INNER_CENTRES": 1, "BORDER_CENTRES": 0, "SLOW_CENTRES": 0, "MOST_EDGES": 1}.items():
        monkeypatch.setattr(containment, name, value)
    # by rays both ways: edges in columns, and one after the other in tiles with more than one
    both = hl.cells_in_polygons(centers, polygons)
    found = [tuple(r) for r in both.collect()]
    assert "Union" in both._jdf.queryExecution().executedPlan().toString()
    assert len(found) == len(set(found)) and set(found) == want


def test_pairs_are_tested_by_generated_code_and_the_cover_is_computed_once(polygons, centers):
    box = polygons.where("polygon_id in ('box', 'holed', 'parts')")
    text = hl.cells_in_polygons(centers, box)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in text and "quadkey" not in text
    assert "Scan ExistingRDD" in text and "exists(" not in text


def test_tiles_without_centres_are_dropped(spark, polygons):
    one = spark.createDataFrame([(1, 0.5, 0.5), (2, 50.9, 50.5), (3, 120.0, 0.0)], "id long, lon double, lat double")
    placed = one.select("id", containment.tiles.quadkey(F.expr(f"cast(floor((lon + 180) / 360 * {1 << containment.CLOSE}) as long)"), containment._row(F.col("lat")), containment.CLOSE).alias("finest"))
    cover = containment._cover(polygons.where("polygon_id in ('box', 'parts')"), containment._occupied(placed), containment.Size(0, 0))
    assert {(r.polygon_id, r.n) for r in cover.select("polygon_id", "n").collect()} == {("box", 1), ("parts", 1)}
    assert cover.count() == 2
    assert sorted(map(tuple, hl.cells_in_polygons(one, polygons.where("polygon_id in ('box', 'parts')")).collect())) == [("box", 1), ("parts", 2)]
