import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom import sources
from hexloom.functions import cellid


def test_ids_are_never_numbers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("GRID_ID,depth,n,reef,name\n8e10,1.5,3,TRUE,a\n8e11,2,4,False,\n8e12,3\n")
    rows = sources.read_cells_csv(spark, str(tmp_path / "c.csv"))
    assert dict(rows.dtypes) == {"id": "string", "depth": "double", "n": "bigint", "reef": "boolean", "name": "string"}
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [
        ("8e10", 1.5, 3, True, "a"), ("8e11", 2.0, 4, False, None), ("8e12", 3.0, None, None, None)
    ]


def test_dates_stay_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text("GRID_ID,day\n8b44e1a0b2c3fff,2024-01-02\n")
    assert dict(sources.read_cells_csv(spark, str(tmp_path / "c.csv")).dtypes)["day"] == "string"


def test_build_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text("GRID_ID,v\n8b44e1a0b2c3fff,1\nbroken,2\n")
    good, bad = sources.build_cells(spark, str(tmp_path / "c.csv")).orderBy("v").collect()
    assert [f"{good[f'r{r}_id']:x}" for r in (11, 9, 4)] == ["8b44e1a0b2c3fff", "8944e1a0b2fffff", "8444e1bffffffff"]
    assert bad["r11_id"] is None and bad["r4_id"] is None and bad["id"] == "broken"
    assert hl.count_cells(sources.build_cells(spark, str(tmp_path / "c.csv"))).first()[0] == 1


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 8b44e1a0b2c3fff \n\n8b44e1a0b2c3fff\n8b44e1a0b2c2fff\n")
    ids = sorted(r["id"] for r in sources.read_id_list(spark, str(tmp_path / "ids.txt")).collect())
    assert ids == ["8b44e1a0b2c2fff", "8b44e1a0b2c3fff"]


def test_last_line_of_a_coarse_file_wins(spark, tmp_path):
    lines = [f"8944e1a0b2fffff,{i}" for i in range(2000)]
    (tmp_path / "coarse.csv").write_text("id,v\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        coarse = sources.read_coarse_csv(spark, str(tmp_path / "coarse.csv"))
        assert coarse.rdd.getNumPartitions() > 3
        fine = spark.createDataFrame([("8b44e1a0b2c3fff",)], "id string")
        joined = hl.join_attributes(fine, coarse, order_by=["_file", "_block", "_line"])
        assert joined.columns == ["id", "v"] and joined.first()["v"] == "1999"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_features(spark, tmp_path):
    plain = [{"GRID_ID": "8b44e1a0b2c3fff", "x": 1}]
    geo = [{"type": "Feature", "properties": {"GRID_ID": "8b44e1a0b2c2fff"}, "geometry": None}]
    (tmp_path / "f.json").write_text("\n".join(json.dumps(r) for r in plain + geo))
    ids = hl.extract_cell_ids(sources.read_features(spark, str(tmp_path / "f.json")))
    assert sorted(r["id"] for r in ids.collect()) == ["8b44e1a0b2c2fff", "8b44e1a0b2c3fff"]
    (tmp_path / "f.csv").write_text("a,cell\n1,8b44e1a0b2c3fff\n")
    assert sources.read_features(spark, str(tmp_path / "f.csv"), "cell", "csv").first()["cell"] == "8b44e1a0b2c3fff"


def test_export_has_no_hierarchy(spark, cells, tmp_path):
    sources.export_csv(cells, str(tmp_path / "out"))
    header = next(Path(tmp_path / "out").glob("*.csv")).read_text().splitlines()[0]
    assert header.startswith("id,n,") and "r9_id" not in header


def test_clustered_cells_are_pruned_and_spread(spark, cells, tmp_path):
    """Rows of a file are in id order, families stay together, and one very frequent cell is spread over several files."""
    hot = cells.limit(1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(6000))))
    hot = hot.withColumn("l_extendedprice", F.sqrt("_n")).withColumn("n", F.xxhash64("_n")).drop("_n").repartition(8)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        sources.write_cells(cells.unionByName(hot), str(tmp_path / "c"), 6)
    finally:
        for k in small:
            spark.conf.unset(k)
    stored = spark.read.parquet(str(tmp_path / "c"))
    files = stored.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.collect_list("r11_id").alias("ids")).collect()
    assert all(f["ids"] == sorted(f["ids"]) for f in files)
    total = sum(f["n"] for f in files)
    assert total == cells.count() + 6000 and max(f["n"] for f in files) < total / 3
    holding = stored.where(F.col("r7_id") != hot.first()["r7_id"]).groupBy("r7_id").agg(F.count_distinct("_metadata.file_path").alias("files"))
    assert holding.agg(F.max("files")).first()[0] <= 2

def test_tile_index_pushdown(spark, tile_index):
    plan = hl.tile_members(tile_index, 10, 279, 439)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(geohash" in plan and "PartitionFilters: [isnotnull(resolution" in plan


def test_profile_roundtrip(spark, cells, tmp_path):
    versions = spark.createDataFrame([(4,)], "version long")
    document = hl.profile(cells, versions)
    sources.write_profile(document, hl.profile_values(cells), str(tmp_path / "p"))
    attributes, values = sources.read_profile(spark, str(tmp_path / "p"))
    again = {r["attribute"]: r for r in attributes.collect()}
    for row in document.collect():
        other = again[row["attribute"]]
        assert other["values"] == row["values"] and other["count"] == row["count"]
        if row["stats"]:
            assert other["stats"]["histogram"] == row["stats"]["histogram"]
            assert other["stats"]["stddev_samp"] == pytest.approx(row["stats"]["stddev_samp"])
    assert values.count() == hl.profile_values(cells).count()


def test_geojson(spark, cells, geometry, tmp_path):
    rings = geometry.select(cellid.cell_to_string(F.col("id")).alias("h3"), "ring")
    features = sources.geojson_features(hl.hex_counts(cells, 7, {"flag": {"choices": ["A"]}}), rings)
    for row in features.collect():
        feature = json.loads(row["feature"])
        ring = feature["geometry"]["coordinates"][0]
        assert feature["type"] == "Feature" and ring[0] == ring[-1] and len(ring) == 7
        assert feature["properties"]["highlighted"] is True and feature["properties"]["resolution"] == 7
    sources.write_geojson(features.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_selection_skips_row_groups(spark, cells, tmp_path):
    """On clustered cells a selection and a tile cut the scan to id ranges."""
    sources.write_cells(cells, str(tmp_path / "c"), 4)
    stored = spark.read.parquet(str(tmp_path / "c"))
    chosen = hl.select_cells_compact(stored, ["8944000006fffff"])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r11_id" in plan and "LessThanOrEqual(r11_id" in plan
    assert chosen.count() == cells.where(cellid.cell_to_string(F.col("r9_id")) == "8944000006fffff").count()


def test_csv_quotes(spark, tmp_path):
    """Commas, doubled quotes, backslashes and empty text, written and read by another engine as well."""
    import duckdb

    values = ['say "hi", ok', "back\\slash", "a,b", "plain", "\\"]
    rows = spark.createDataFrame([(f"{i}", v, float(i)) for i, v in enumerate(values)], "id string, t string, d double")
    sources.export_csv(rows.coalesce(1), f"{tmp_path}/ours")
    theirs = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/ours/*.csv', header = true, all_varchar = true, quote = '\"', escape = '\"')").fetchall()
    assert sorted(t for _, t, _ in theirs) == sorted(values)
    duckdb.sql(f"COPY (SELECT * FROM read_csv('{tmp_path}/ours/*.csv', header = true, all_varchar = true, quote = '\"', escape = '\"')) TO '{tmp_path}/theirs.csv' (HEADER)")
    back = sources.read_cells_csv(spark, f"{tmp_path}/theirs.csv", id_column="id", schema="id string, t string, d double")
    assert sorted((r.t, r.d) for r in back.collect()) == sorted((v, float(i)) for i, v in enumerate(values))


def test_missing_geometry_fails(spark, cells, geometry):
    import hexloom as hl

    with pytest.raises(Exception, match="no geometry"):
        hl.build_tile_index(cells, geometry.where("id % 5 <> 0")).collect()


def test_bad_feature_ids_fail_even_a_count(spark):
    import hexloom as hl

    with pytest.raises(Exception, match="invalid cell id"):
        hl.extract_cell_ids(spark.createDataFrame([("zz",)], "GRID_ID string")).count()


def _leaves(plan) -> list:
    """Leaf nodes of an executed plan, inside adaptive stages too."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _leaves(plan.plan())
    if name == "ReusedExchangeExec":
        return []
    children = plan.children()
    if children.size():
        return [leaf for i in range(children.size()) for leaf in _leaves(children.apply(i))]
    return [plan]


def _scanned_rows(df) -> int:
    df.collect()
    scans = [leaf for leaf in _leaves(df._jdf.queryExecution().executedPlan()) if "r11_id" in leaf.toString()]
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in scans)


def test_a_deep_tile_reads_few_rows(spark, tmp_path):
    from hexloom.plans import tables

    sf_dir = "/root/testdata/sf0.1"
    sources.write_cells(tables.cells(spark, sf_dir), str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    total = stored.count()
    in_tile = stored.where("n between 800000 and 802800 and n % 64 < 44").select("r11_id").distinct()
    key = F.lit("11301320233102")
    index = in_tile.select(F.col("r11_id").alias("id"), F.lit(11).alias("resolution"), key.alias("geohash"))
    x, y = (sum((int(d) >> bit & 1) << (13 - i) for i, d in enumerate("11301320233102")) for bit in (0, 1))
    counted = hl.tile_counts(stored, index, 14, x, y)
    read = _scanned_rows(counted)
    assert counted.agg(F.sum("all_count")).first()[0] == stored.join(in_tile, "r11_id").count()
    assert read < total / 10, (read, total)


def test_stores_compute_their_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    from hexloom.plans import tables

    cells = tables.cells(spark, "/root/testdata/sf0.001")
    watched = cells.mapInArrow(count, cells.schema)
    rows = cells.count()
    for turn in (1, 2):
        sources.write_cells(watched, str(tmp_path / f"cells{turn}"))
        assert seen.value == turn * rows
    first, second = (spark.read.parquet(str(tmp_path / f"cells{turn}")) for turn in (1, 2))
    assert first.exceptAll(second).count() == 0 and second.count() == rows
    index = hl.build_tile_index(first, tables.cell_geometry(hl.hexagons(first)))
    seen.value = 0
    sources.write_tile_index(index.mapInArrow(count, index.schema), str(tmp_path / "tiles"))
    assert seen.value == spark.read.parquet(str(tmp_path / "tiles")).count()


TYPES = "GRID_ID string, depth double, n bigint, reef boolean, name string"


def test_bad_csv_values_raise_with_their_line(spark, tmp_path):
    (tmp_path / "c.csv").write_text("GRID_ID,depth,n,reef,name\na,1.5,3,TRUE,x\nb,oops,3,TRUE,x\n")
    with pytest.raises(Exception, match="no double in column depth: oops.*b,oops,3,TRUE,x"):
        sources.read_cells_csv(spark, str(tmp_path / "c.csv"), schema=TYPES).collect()
    (tmp_path / "d.csv").write_text('GRID_ID,depth,n,reef,name\na,1.5,3,TRUE,"stray\nbreak"\n')
    with pytest.raises(Exception, match="an open quote"):
        sources.read_cells_csv(spark, str(tmp_path / "d.csv"), schema=TYPES).count()


def test_csv_verdicts(spark, tmp_path):
    lines = [
        'GRID_ID,depth,n,reef,"na,me"', 'a,1.5,3,TRUE,"x, ""y"""', "b", "c, 2 ,,false,", "d,1,2.5,true,", "e,1,2,yes,", "f,1,2,true,z,more", 'g,1,2,true,"open', "h,1e3,-4,False,\"\"", "i,nope,x,true,",
    ]
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n\n")
    schema = sources.narrow_schema(spark.createDataFrame([], TYPES.replace("name", "`na,me`")).schema, "GRID_ID")
    rows = {r.id: r for r in sources.csv_with_verdicts(spark, str(tmp_path / "c.csv"), schema).collect()}
    assert {k for k, r in rows.items() if r._problem is None} == {"a", "b", "c", "h"}
    assert tuple(rows["a"])[:5] == ("a", 1.5, 3, True, 'x, "y"') and tuple(rows["b"])[:5] == ("b", None, None, None, None)
    assert tuple(rows["c"])[:5] == ("c", 2.0, None, False, None) and rows["h"].depth == 1000.0 and rows["h"].n == -4
    assert rows["d"]._problem == "no bigint in column n: 2.5" and rows["e"]._problem == "no boolean in column reef: yes"
    assert rows["f"]._problem == "more fields than the header" and rows["g"]._problem == "an open quote"
    assert rows["i"]._problem.startswith("no double in column depth") and rows["i"]._row == "i,nope,x,true,"
