import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.functions import cellid
from hexloom.operators.attributes import fallback_number, last_per_id, ranked
from hexloom.plans import tables
from hexloom.plans.registry import _coarse

FINE = "8b44e1a0b2c3fff"
PARENT = "8944e1a0b2fffff"


def test_extract(spark):
    rows = spark.createDataFrame([(FINE,), (PARENT,)], "GRID_ID string")
    assert [r["id"] for r in hl.extract_cell_ids(rows).collect()] == [FINE, PARENT]


@pytest.mark.parametrize("bad", ["zz", None, "8b44e1"])
def test_extract_fails_on_invalid(spark, bad):
    rows = spark.createDataFrame([(FINE,), (bad,)], "cell string")
    with pytest.raises(Exception, match="invalid cell id"):
        hl.extract_cell_ids(rows, "cell").collect()


def test_last_of_repeated_ids(spark):
    coarse = spark.createDataFrame([(PARENT, "x", 1), (PARENT, "z", 3), (PARENT, "y", 2)], "id string, v string, at int")
    fine = spark.createDataFrame([(FINE,)], "id string")
    assert [tuple(r) for r in hl.join_attributes(fine, coarse, order_by=["at"]).collect()] == [(FINE, "z")]


def test_misses(spark):
    coarse = spark.createDataFrame([(PARENT, "x")], "id string, v string")
    fine = spark.createDataFrame([(FINE,), ("8b44000000c0fff",)], "id string")
    with_fallback = {r["id"]: r["v"] for r in hl.join_attributes(fine, coarse).collect()}
    without = {r["id"]: r["v"] for r in hl.join_attributes(fine, coarse, fallback=False).collect()}
    assert with_fallback == {FINE: "x", "8b44000000c0fff": "x"}
    assert without == {FINE: "x", "8b44000000c0fff": None}


def test_mixed_or_empty_coarse(spark):
    fine = spark.createDataFrame([(FINE,)], "id string")
    mixed = spark.createDataFrame([(PARENT, "x"), (FINE, "y")], "id string, v string")
    with pytest.raises(ValueError, match="mix"):
        hl.join_attributes(fine, mixed)
    with pytest.raises(ValueError):
        hl.join_attributes(fine, mixed.where("v = 'none'"))


def test_same_result_without_broadcast(cells, no_broadcast, monkeypatch):
    fine, coarse = cells.select("id"), _coarse(cells)
    joined = hl.join_attributes(fine, coarse, order_by=["n", "price"], seed="7")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    slow = sorted(map(tuple, joined.select("id", "p").collect()))
    monkeypatch.undo()
    fast = hl.join_attributes(fine, coarse, order_by=["n", "price"], seed="7")
    assert slow == sorted(map(tuple, fast.select("id", "p").collect()))


def test_ranks_are_dense_and_in_id_order(cells):
    lookup = last_per_id(_coarse(cells), ["n", "price"])
    with_id = lookup.withColumn("attrs", F.struct(F.col("cell").alias("cell")))
    rows = ranked(with_id, 9).select("rank", "attrs.cell").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert [r["cell"] for r in rows] == sorted(r["cell"] for r in rows)


def test_fallback_depends_on_seed(cells):
    ids = cells.select("id").distinct()
    numbers = ids.select(fallback_number(F.col("id"), "1", 50).alias("a"), fallback_number(F.col("id"), "2", 50).alias("b"))
    row = numbers.agg(F.min("a"), F.max("a"), F.count_distinct("a"), F.count_if(F.col("a") != F.col("b"))).first()
    assert (row[0], row[1], row[2]) == (0, 49, 50) and row[3] > 0


def test_pyramid_layers(cells):
    layers = hl.build_cell_pyramid(cells.select("id"))
    counts = {r["resolution"]: r["count"] for r in layers.groupBy("resolution").count().collect()}
    expected = cells.agg(*(F.count_distinct(f"r{r}_id").alias(str(r)) for r in range(6, 12))).first().asDict()
    assert counts == {int(k): v for k, v in expected.items()}
    one = layers.where("resolution = 8").first()
    assert one["r8_id"] == one["id"] and one["r9_id"] is None and one["r0_id"] is not None
    assert layers.where(~cellid.is_valid_cell_string(F.col("id"))).count() == 0


@pytest.mark.parametrize("bad", ["zz", PARENT, None])
def test_pyramid_needs_finest_ids(spark, bad):
    with pytest.raises(Exception, match="not a finest cell id"):
        hl.build_cell_pyramid(spark.createDataFrame([(bad,)], "id string")).collect()


def test_families_are_grouped_without_more_shuffles(cells):
    plan = hl.hexagons(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_shared_folder_follows_the_session(spark):
    assert tables.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_ranks_in_two_levels(spark):
    from hexloom.operators import attributes

    ids = [(base << 45) | (1 << 59) | (9 << 52) | (((k * 7919) % 8**9 & 0o666666666) << 18) | ((1 << 18) - 1) for base in (0, 3, 34, 121) for k in range(300)]
    lookup = spark.createDataFrame([(i, {"v": i}) for i in set(ids)], "cell long, attrs struct<v:long>")
    found = attributes.ranked(lookup, 9)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.cell for r in found.orderBy("rank").collect()] == sorted(set(ids))
    assert [r["rank"] for r in found.orderBy("rank").collect()] == list(range(len(set(ids))))


def test_rows_meet_attributes_once(spark, no_broadcast):
    import hexloom as hl

    fine = spark.createDataFrame([(f"8b44e1a0b{k:03x}fff",) for k in range(64)], "id string")
    coarse = spark.createDataFrame([("8944e1a0b03ffff", "a"), ("8944e1a0b0fffff", "b")], "id string, v string")
    joined = hl.join_attributes(fine, coarse)
    assert joined.count() == 64 and joined.where("v is null").count() == 0
