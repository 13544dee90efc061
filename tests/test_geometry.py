import json

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geometry
from hexloom.operators.selection import cells_in_polygon


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, closed",
    [
        ("POLYGON((1 2, 3 4, 5 6))", "POLYGON((1 2, 3 4, 5 6, 1 2))"),
        ("POLYGON ((1 2,3 4,5 6))", "POLYGON((1 2, 3 4, 5 6, 1 2))"),
        ("POLYGON((0 0, 9 0, 9 9), (1 1, 2 1, 2 2))", "POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))"),
        ("POLYGON((0 0, 9 0, 9 9, 0 0))", "POLYGON((0 0, 9 0, 9 9, 0 0))"),
        ("POLYGON EMPTY", "POLYGON EMPTY"),
        ("POINT(1 2)", "POINT(1 2)"),
        (None, None),
    ],
)
def test_close(spark, text, closed):
    assert one(spark, geometry.close_polygon_wkt, text) == closed


@pytest.mark.parametrize(
    "text, parts",
    [
        ("POLYGON((0 0, 1 0, 1 1))", ["POLYGON((0 0, 1 0, 1 1))"]),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1)))", ["POLYGON ((0 0, 1 0, 1 1))"]),
        (
            "MULTIPOLYGON(((0 0,1 0,1 1)),((5 5,6 5,6 6),(5.1 5.1,5.2 5.1,5.2 5.2)))",
            ["POLYGON ((0 0,1 0,1 1))", "POLYGON ((5 5,6 5,6 6),(5.1 5.1,5.2 5.1,5.2 5.2))"],
        ),
        ("MULTIPOLYGON EMPTY", []),
    ],
)
def test_parts(spark, text, parts):
    assert one(spark, geometry.multipolygon_parts, text) == parts


def test_id_to_polygon_chain(spark):
    """Multipolygon text of one cell to a closed polygon, as the tile index wants it."""
    chain = lambda c: geometry.close_polygon_wkt(geometry.multipolygon_parts(c)[0])
    assert one(spark, chain, "MULTIPOLYGON (((0 0, 1 0, 1 1)))") == "POLYGON((0 0, 1 0, 1 1, 0 0))"


def test_wkt_roundtrip(spark):
    ring = [(-81.5, 24.25), (-81.25, 24.5), (-81.75, 24.5)]
    text = one(spark, geometry.ring_to_wkt, ring, geometry.RING_TYPE)
    assert text == "POLYGON((-81.5 24.25, -81.25 24.5, -81.75 24.5, -81.5 24.25))"
    assert [tuple(p) for p in one(spark, geometry.wkt_to_ring, text)] == ring + ring[:1]
    assert one(spark, geometry.wkt_to_ring, "POINT(1 2)") is None


def test_closed_ring_stays(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert [tuple(p) for p in one(spark, geometry.close_ring, ring, geometry.RING_TYPE)] == ring


SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]


def many(ring, n=12):
    """The same ring with many points on its sides, so the edge table is used."""
    return [[a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n] for a, b in zip(ring, ring[1:]) for i in range(n)]


@pytest.mark.parametrize("rings", [[SQUARE, HOLE], [many(SQUARE), many(HOLE)], [SQUARE[::-1], HOLE]])
def test_in_polygon(spark, rings):
    points = [(i, x + 0.5, y + 0.5) for i, (x, y) in enumerate((x, y) for x in range(-2, 12) for y in range(-2, 12))]
    centers = spark.createDataFrame(points, "id long, lon double, lat double")
    inside = {r["id"] for r in cells_in_polygon(centers, rings).collect()}
    expected = {
        i for i, x, y in points if 0 < x < 10 and 0 < y < 10 and not (4 < x < 6 and 4 < y < 6)
    }
    assert inside == expected


def test_polygon_inputs():
    shape = {"type": "Polygon", "coordinates": [SQUARE]}
    for given in (shape, {"type": "Feature", "geometry": shape}, json.dumps(shape), [SQUARE]):
        assert geometry.polygon_rings(given)[0][1] == (10.0, 0.0)
    for bad in ({"type": "Point", "coordinates": [0, 0]}, {"type": "Feature", "geometry": None}, [], [[[0, 0], [1, 1]]]):
        with pytest.raises(ValueError):
            geometry.polygon_rings(bad)
