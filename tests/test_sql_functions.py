import pytest
from pyspark.sql import functions as F

from hexloom.functions import cellid, geometry, tiles
from hexloom.functions.sql import register_sql_functions
from hexloom.plans.registry import QUERIES


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register_sql_functions(spark)


def test_same_as_columns(spark, cells):
    cells.select("id", "r11_id", "n").createOrReplaceTempView("some_cells")
    rows = spark.sql(
        """SELECT h3_string_to_h3(id) = r11_id, h3_h3_to_string(r11_id) = id, h3_get_resolution(r11_id) = 11,
             h3_cell_to_parent(r11_id, 7) AS p7, h3_cell_to_parent(r11_id, 12) IS NULL, r11_id FROM some_cells"""
    )
    different = rows.where(F.col("p7") != cellid.cell_to_parent(F.col("r11_id"), 7)).count()
    assert different == 0
    assert rows.where(" OR ".join(f"NOT `{c}`" for c in rows.columns if c not in ("p7", "r11_id"))).count() == 0


def test_valid(spark, sf_dir):
    texts = QUERIES["h3_valid"](spark, sf_dir)
    assert texts.where("valid <> h3_is_valid_cell(h3_string_to_h3(text))").count() == 0
    assert texts.where("valid").count() > 0


@pytest.mark.parametrize("zoom", range(17))
def test_zoom(spark, zoom):
    assert spark.sql(f"SELECT zoom_to_h3_resolution({zoom})").first()[0] == tiles.resolution_for_zoom(zoom)


@pytest.mark.parametrize("z, x, y", [(0, 0, 0), (3, 3, 5), (12, 1116, 1759)])
def test_quadkey(spark, z, x, y):
    assert spark.sql(f"SELECT tile_to_quadkey({x}, {y}, {z})").first()[0] == tiles.tile_quadkey(z, x, y)


@pytest.mark.parametrize("text", ["POLYGON((1 2, 3 4, 5 6))", "POINT(1 2)"])
def test_close(spark, text):
    row = spark.createDataFrame([(text,)], "v string").select(
        geometry.close_polygon_wkt(F.col("v")), F.expr("close_polygon_wkt(v)")
    ).first()
    assert row[0] == row[1]


@pytest.mark.parametrize("text", ["MULTIPOLYGON (((1 2, 3 4, 5 6), (1 1, 2 2, 3 1)), ((7 8, 9 9, 1 0)))", "multipolygon empty", "POLYGON((1 2, 3 4, 5 6))", None])
def test_polygons_of_a_hexagon(spark, text):
    parts, polygon, want_parts, want = spark.createDataFrame([("8944e1a0b03ffff", text)], "id string, v string").select(
        F.expr("polygon_from_multipolygon_wkt(v)"), F.expr("h3_id_to_simple_polygon(id, v)"),
        geometry.multipolygon_parts(F.col("v")), F.struct("id", geometry.close_polygon_wkt(F.get(geometry.multipolygon_parts(F.col("v")), 0)).alias("wkt")),
    ).first()
    assert parts == want_parts and tuple(polygon) == tuple(want)
