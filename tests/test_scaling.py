"""What large tables need: stores of what a query reads only, and tasks whose size doesn't hang on compressed bytes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.operators import layers
from hexloom.plans import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark, tmp_path):
    """A small lineitem table of its own."""
    rows = [(order, line, 100 + order, float(order % 9), 10.5 * order, 0.05, 0.01, "ANR"[order % 3], "O") for order in range(40) for line in (1, 5, 6, 7)]
    schema = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string"
    )
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_stores_hold_only_what_was_asked_for(spark, lines):
    def stored() -> set[str]:
        return {name for _, folder, name in tables._stored if folder == lines}

    assert tables.stored_cells(spark, lines).count() == 160
    assert stored() == {"cells"}
    assert tables.stored_geometry(spark, lines).count() > 160
    assert stored() == {"cells", "geometry"}
    assert tables.stored_tile_index(spark, lines).count() > 160
    assert stored() == {"cells", "geometry", "tiles"}


def test_hexagons_are_found_in_a_given_number_of_tasks(spark, lines):
    assert "REPARTITION_BY_NUM" in plan(hl.hexagons(tables.cells(spark, lines)))


def test_rings_inside_one_tile_are_not_shuffled(spark, lines):
    geometry = tables.cell_geometry(hl.hexagons(tables.cells(spark, lines)))
    index = hl.build_tile_index(tables.cells(spark, lines), geometry)
    assert "tile" in plan(index)
    located = hl.hexagons(tables.cells(spark, lines)).join(geometry.select("id", "ring"), "id")
    whole = layers.tile_cover(located.withColumn("zoom", hl_zoom()))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, whole.collect()))


def hl_zoom():
    from hexloom.functions import tiles

    return tiles.resolution_to_zoom(F.col("resolution"))


@pytest.mark.parametrize("ring, rows", [("array()", 0), ("null", None)])
def test_empty_rings_have_no_tiles_and_missing_ones_fail(spark, lines, ring, rows):
    cells = tables.cells(spark, lines)
    geometry = tables.cell_geometry(hl.hexagons(cells)).withColumn("ring", F.expr(f"if(resolution = 6, cast({ring} as {layers.geometry.RING_TYPE}), ring)"))
    index = hl.build_tile_index(cells, geometry)
    if rows is None:
        with pytest.raises(Exception, match="no geometry for hexagon"):
            index.collect()
    else:
        assert index.where("resolution = 6").count() == rows
        assert index.where("resolution = 7").count() > 0


def test_a_csv_line_is_parsed_once(spark, lines):
    from hexloom import sources

    sources.export_csv(tables.cells(spark, lines), f"{lines}/csv")
    rows = sources.read_cells_csv(spark, f"{lines}/csv", id_column="id")
    assert plan(rows).count("from_csv") == 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, tables.cells(spark, lines).drop(*sources.STORED_LEVELS).collect()))


def test_lines_with_and_without_quotes_are_read_alike(spark, tmp_path):
    from hexloom import sources

    fields = ["", " ", "x", " y ", "1", "a b", "\\", "'"]
    rows = [f"{a},{b},{c}" for a in fields for b in fields for c in fields] + ["k", "k,", "k,m", "k,m,n,", "k,m,n,,", "k,m,n,,p", "k,m,n,o", ",,,"]
    whole = "GRID_ID string, a string, b string"
    for name, lines_ in (("plain", rows), ("quoted", ['"q",' + row for row in rows])):
        header = "GRID_ID,a,b" if name == "plain" else "first,GRID_ID,a,b"
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *lines_]) + "\n")

    def read(name: str) -> list:
        schema = sources.narrow_schema(spark.createDataFrame([], whole).schema, "GRID_ID")
        judged = sources.csv_with_verdicts(spark, str(tmp_path / f"{name}.csv"), schema)
        return sorted((str(r.id), str(r.a), str(r.b), str(r._problem), r._row.removeprefix('"q",')) for r in judged.collect())

    assert read("plain") == read("quoted")
    assert len(read("plain")) == len([row for row in rows if row.strip(" ")])


def test_masks_and_rows_count_the_same(spark, lines, monkeypatch):
    import json

    from hexloom.operators import filter_table

    specs = [None, {}, {"l_quantity": {"min": 3, "max": 6}}, {"discounted": {"bool": False}}, {"flag": {"choices": ["A", "N"]}}]
    specs += [{"flag": {"min": 1}}, {"l_quantity": {"choices": ["3.0"]}}, {"l_quantity": {"bool": True}}] + [{"l_partkey": {"max": 100 + k}} for k in range(70)]
    table = spark.createDataFrame([(k, None if s is None else json.dumps(s)) for k, s in enumerate(specs)], "filter_id long, filter string")
    cells = tables.cells(spark, lines)
    by_masks = hl.count_filters(cells, table)
    assert "bit_or" in plan(by_masks)
    monkeypatch.setattr(filter_table, "MOST_MASKS", 0)
    by_rows = hl.count_filters(cells, table)
    assert "bit_or" not in plan(by_rows)
    assert sorted(map(tuple, by_masks.collect())) == sorted(map(tuple, by_rows.collect()))


def test_values_of_sketches_move_once_per_cell(spark, lines):
    from hexloom.plans import registry

    text = plan(registry.QUERIES["distinct_sketch_pyramid"](spark, lines))
    assert text.count("REPARTITION_BY_NUM") >= 2
    assert hl.distinct_sketch_pyramid(tables.cells(spark, lines), "l_partkey").where("resolution = 11").count() == 160


@pytest.fixture
def stars(spark):
    ring = [(0.0, 0.0), (3.0, 1.0), (1.0, 4.0)]
    rows = [(k, [[{"lon": x + k / 10, "lat": y} for x, y in ring]]) for k in range(20)]
    polygons = spark.createDataFrame(rows, "polygon_id long, rings array<array<struct<lon:double,lat:double>>>")
    centers = spark.range(400).selectExpr("id", "(id % 20) * 0.3 as lon", "(id div 20) * 0.2D as lat")
    return centers.withColumn("lon", F.col("lon").cast("double")), polygons


def test_a_cover_beyond_the_bound_is_not_broadcast_by_sparks_estimate(spark, stars, monkeypatch):
    from hexloom.operators import joins

    small = hl.cells_in_polygons(*stars)
    assert "BroadcastHashJoin" in plan(small)
    want = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    large = hl.cells_in_polygons(*stars)
    assert sorted(map(tuple, large.collect())) == want and len(want) > 100
    assert "SortMergeJoin" in plan(large) and "Broadcast" not in plan(large)


def test_centres_have_keys_of_the_zooms_with_tiles_only(stars):
    centers, polygons = stars
    text = plan(hl.cells_in_polygons(centers, polygons))
    assert "substring(finest" in text and ", 1, 14)" in text and ", 1, 2)" not in text
    assert hl.cells_in_polygons(centers, polygons.limit(0)).count() == 0


@pytest.mark.parametrize("name, texts", [("multipolygon_parts", 2), ("id_to_polygon", 1)])
def test_texts_are_built_once_from_geometry_that_is_not_stored(spark, lines, name, texts):
    from hexloom.plans import registry

    frame = registry.QUERIES[name](spark, lines)
    assert plan(frame).count("concat_ws") == texts
    assert frame.count() == texts * tables.geometry(spark, lines).count() > 160
    assert not any(folder == lines for _, folder, _ in tables._stored)


def test_conditions_on_the_cell_do_not_read_the_id_again(spark, lines):
    from hexloom.operators.attributes import join_attributes, last_per_id
    from hexloom.plans import registry

    cells = tables.cells(spark, lines)
    lookup = last_per_id(registry._coarse(cells), ["n", "price"])
    assert plan(lookup.select("cell").where("cell is not null")).count("RLIKE") == 1
    joined = join_attributes(cells.select("id"), registry._coarse(cells), order_by=["n", "price"], seed="7")
    assert joined.count() == 160 and joined.where("p is null").count() == 0


def test_attributes_may_be_called_cell(spark):
    from hexloom.operators.attributes import join_attributes

    coarse = spark.createDataFrame([("8944e1a0b2fffff", 7)], "id string, cell int")
    fine = spark.createDataFrame([("8b44e1a0b2c3fff",), ("no id",), (None,)], "id string")
    assert [r.cell for r in join_attributes(fine, coarse).collect()] == [7, 7, None]


def test_top_values_are_counted_in_a_given_number_of_tasks(spark):
    from hexloom.operators import profile as prof

    rows = [(k % 5, float(k % 3), f"t{k % 4}", k % 2 == 0) for k in range(60)] + [(None, float("nan"), None, None), (0, -0.0, "", None)]
    frame = spark.createDataFrame(rows, "part long, x double, v0 string, b boolean")
    found = prof.all_frequencies(frame, {"number": ["part", "x"], "string": ["v0"], "boolean": ["b"]})
    assert plan(found).count("REPARTITION_BY_NUM") == 6 and "ENSURE_REQUIREMENTS" not in plan(found)
    counts = {(r.attribute, r.value): r["count"] for r in found.collect()}
    assert counts[("part", "0")] == 13 and counts[("x", "0")] == 21 and counts[("v0", "t1")] == 15 and counts[("b", "true")] == 30
    assert len(counts) == found.count() == 5 + 4 + 5 + 2


def test_layers_are_placed_before_their_texts_are_made(spark, lines, tmp_path):
    from hexloom import sources

    cells = tables.cells(spark, lines).select("id")
    layers_ = hl.build_cell_pyramid(cells, tables.geometry(spark, lines))
    text = plan(layers_)
    moved = text[text.index("Exchange") :]
    # the texts of rings and parents stand above the only shuffle of rings; there is no join that deals them out by id
    assert "concat_ws" in text and "concat_ws" not in moved and "Join" not in text
    sources.write_cell_pyramid(layers_, f"{tmp_path}/placed", placed=True)
    sources.write_cell_pyramid(layers_, f"{tmp_path}/moved")
    placed, again = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("placed", "moved"))
    assert sorted(map(str, placed.collect())) == sorted(map(str, again.collect()))
    assert placed.count() == tables.geometry(spark, lines).count() > 160
    files = os.listdir(f"{tmp_path}/placed/resolution=11")
    assert all(".zstd." in name for name in files if name.endswith(".parquet"))


def test_geometry_of_layers_is_matched_as_by_a_join(spark, lines):
    from hexloom.functions import geometry as geo

    cells = tables.cells(spark, lines).select("id")
    known = tables.geometry(spark, lines).select("id", "ring")
    other = known.where("id % 2 = 0").withColumn("ring", F.slice("ring", 1, 3))
    gap = known.limit(1).withColumn("ring", F.concat(F.array(F.lit(None).cast("struct<lon:double,lat:double>")), "ring"))
    elsewhere = spark.createDataFrame([(0x8B44E1A0B2C3FFF, [(1.0, 2.0)]), (None, [(1.0, 2.0)])], known.schema)
    rings = known.unionAll(other).unionAll(gap).unionAll(elsewhere)
    found = hl.build_cell_pyramid(cells, rings).select("id", "wkt")
    want = known.select("id").join(rings, "id").select(F.lower(F.hex("id")).alias("id"), geo.ring_to_wkt(F.col("ring")).alias("wkt"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    last = known.agg(F.max("id")).first()[0]
    for missing in (known.where(F.col("id") != last), known.withColumn("ring", F.when(F.col("id") != last, F.col("ring")))):
        with pytest.raises(Exception, match="no geometry for hexagon"):
            hl.build_cell_pyramid(cells, missing).collect()
