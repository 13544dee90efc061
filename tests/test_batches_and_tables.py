"""Batches of the tile index, tables of filters and distinct sketches."""

import json

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom import sources
from hexloom.plans import tables


def index_rows(spark, path):
    return sorted(tuple(r) for r in sources.read_tile_index(spark, path).drop("batch").collect())


def test_batches_equal_the_whole_index(spark, tmp_path, cells, geometry):
    path = str(tmp_path / "index")
    assert index_rows(spark, path) == []
    sources.append_tile_index(cells.where("n % 2 = 0"), geometry, path, "even")
    sources.append_tile_index(cells, geometry, path, "all")
    whole = sorted(tuple(r) for r in hl.build_tile_index(cells, geometry).select("geohash", "id", "resolution", "zoom").collect())
    assert index_rows(spark, path) == whole
    sources.append_tile_index(cells, geometry, path, "all")  # run again: the same rows
    assert index_rows(spark, path) == whole


def test_a_failing_batch_changes_nothing(spark, tmp_path, cells, geometry):
    path = str(tmp_path / "index")
    sources.append_tile_index(cells.where("n % 5 = 0"), geometry, path, "first")
    before = index_rows(spark, path)
    lost = geometry.where("resolution <> 11")
    for batch in ("second", "first"):
        with pytest.raises(Exception, match="no geometry for hexagon"):
            sources.append_tile_index(cells, lost, path, batch)
        assert index_rows(spark, path) == before
    with pytest.raises(ValueError, match="a batch is named"):
        sources.append_tile_index(cells, geometry, path, "a/b")


FILTERS = [
    {}, None, {"l_quantity": {"min": 5, "max": 20}, "flag": {"choices": ["A", "R"]}}, {"discounted": {"bool": True}}, {"tax": {"max": None}}, {"flag": {"choices": []}},
    {"flag": {"like": "x"}}, {"L_QUANTITY": {"min": 10.5}}, {"flag": {"min": 3}}, {"tax": {"min": 0.02}, "l_partkey": {"max": 60}, "discounted": {"bool": False}}, {"l_returnflag": {"choices": ["nothing"]}},
]


def test_a_table_of_filters_equals_single_counts(spark, cells):
    rows = [(k, None if f is None else json.dumps(f)) for k, f in enumerate(FILTERS)]
    found = hl.count_filters(cells, spark.createDataFrame(rows, "filter_id int, filter string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    counts = {r.filter_id: r["count"] for r in found.collect()}
    for k, f in enumerate(FILTERS):
        assert counts[k] == (0 if k == 8 else hl.count_cells(cells, f).first()[0]), f


def test_bad_filter_tables(spark, cells):
    def counts(text, **options):
        return hl.count_filters(cells, spark.createDataFrame([(1, text)], "filter_id int, filter string"), **options).collect()

    with pytest.raises(ValueError, match="unknown column"):
        counts('{"nope": {"min": 1}}')
    with pytest.raises(ValueError):
        counts("{nope")
    assert counts("{nope", lenient=True)[0]["count"] == hl.count_cells(cells).first()[0]
    assert hl.count_filters(cells, spark.createDataFrame([], "filter_id int, filter string")).count() == 0
    assert counts("%7B%22l_quantity%22%3A%7B%22max%22%3A10%7D%7D")[0]["count"] == hl.count_cells(cells, {"l_quantity": {"max": 10}}).first()[0]


def test_sketches_are_merged_up_the_pyramid(spark, cells):
    sketches = hl.distinct_sketch_pyramid(cells, "l_partkey")
    exact = cells.groupBy("r6_id").agg(F.count_distinct("l_partkey").alias("parts"))
    both = sketches.where("resolution = 6").join(exact, F.col("id") == F.col("r6_id")).select("parts", F.hll_sketch_estimate("sketch").alias("guess")).collect()
    assert both and all(abs(r.guess - r.parts) <= 0.1 * r.parts for r in both)
    whole = sketches.where("resolution = 11").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).first()[0]
    assert abs(whole - cells.select("l_partkey").distinct().count()) <= 0.1 * whole
    nothing = hl.distinct_sketch_pyramid(cells.withColumn("flag", F.lit(None).cast("string")), "flag")
    assert {r[0] for r in nothing.select(F.hll_sketch_estimate("sketch")).distinct().collect()} == {0}
    assert hl.approximate_count(cells.where("false")).first()[0] == 0
