import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.functions import cellid
from hexloom.plans.registry import _selected


def texts(df):
    return {f"{r['id']:x}" for r in df.collect()}


def rows_of(df):
    return sorted(map(tuple, df.select("r11_id", "n", "l_extendedprice").collect()))


def test_compact_equals_expansion(spark, cells):
    """Selecting by compact ids keeps the rows that selecting by all their descendants keeps."""
    ids = _selected(cells)
    expanded = hl.uncompact_cells(ids).select(F.col("id").alias("r11_id"))
    assert rows_of(hl.select_cells_compact(cells, ids)) == rows_of(cells.join(expanded, "r11_id", "left_semi"))


def test_compact_without_broadcast(cells, no_broadcast):
    ids = _selected(cells)
    wanted = {r["id"] for r in ids.collect()}
    chosen = hl.select_cells_compact(cells, ids)
    assert "Broadcast" not in chosen._jdf.queryExecution().executedPlan().toString()
    levels = [cellid.cell_to_string(F.col(f"r{r}_id")).alias(f"t{r}") for r in (7, 9, 11)]
    every = cells.select("r11_id", "n", "l_extendedprice", *levels).collect()
    expected = sorted((r[0], r[1], r[2]) for r in every if {r["t7"], r["t9"], r["t11"]} & wanted)
    assert rows_of(chosen) == expected


def test_coarser_than_stored(cells):
    first = cells.select(cellid.cell_to_string(cellid.cell_to_parent(F.col("r11_id"), 1)).alias("id")).first()["id"]
    assert hl.select_cells_compact(cells, [first]).count() == cells.count()


def test_one_resolution_is_a_semi_join(cells):
    some = [r["id"] for r in cells.select(cellid.cell_to_string(F.col("r9_id")).alias("id")).distinct().limit(3).collect()]
    chosen = hl.select_cells_compact(cells, some + some)
    assert chosen.columns == cells.columns
    assert "LeftSemi" in chosen._jdf.queryExecution().executedPlan().toString()
    assert chosen.count() == cells.where(cellid.cell_to_string(F.col("r9_id")).isin(some)).count()


@pytest.mark.parametrize("ids", [["zz"], ["8b44e1a0b2c3ff0"], ["8c44e1a0b2c31ff"]])
def test_bad_ids(cells, ids):
    with pytest.raises(ValueError):
        hl.select_cells_compact(cells, ids)


def test_empty(spark, cells):
    with pytest.raises(ValueError):
        hl.select_cells_compact(cells, [])
    assert hl.select_cells_compact(cells, spark.createDataFrame([], "id string")).count() == 0
    with pytest.raises(ValueError):
        hl.select_cells(cells)
    with pytest.raises(ValueError):
        hl.select_cells(cells, feature={})


@pytest.mark.parametrize("depth, hexagon, pentagon", [(1, 7, 6), (2, 49, 41), (3, 343, 286)])
def test_uncompact_counts(spark, depth, hexagon, pentagon):
    for text, expected in (("8045fffffffffff", hexagon), ("8009fffffffffff", pentagon)):
        ids = spark.createDataFrame([(text,)], "id string")
        children = hl.uncompact_cells(ids, depth)
        found = texts(children)
        assert len(found) == children.count() == expected
        back = children.select(cellid.cell_to_parent(F.col("id"), 0)).distinct().collect()
        assert [f"{r[0]:x}" for r in back] == [text]
        assert children.where(~cellid.is_valid_cell(F.col("id"))).count() == 0


def test_uncompact_is_a_set(spark):
    """Repeated ids and ids under other ids give every descendant once."""
    child = f"{(0x8045fffffffffff & ~(15 << 52) & ~(7 << 42)) | (1 << 52) | (3 << 42):x}"
    ids = spark.createDataFrame([("8045fffffffffff",), (child,), (child,)], "id string")
    children = hl.uncompact_cells(ids, 3)
    assert children.count() == len(texts(children)) == 343


def test_uncompact_deep(spark):
    """Five levels in steps; the whole range of a resolution-6 cell."""
    ids = spark.createDataFrame([("8644e1a07ffffff",)], "id string")
    assert hl.uncompact_cells(ids).count() == 7**5


def test_uncompact_finer(spark):
    with pytest.raises(ValueError):
        hl.uncompact_cells(spark.createDataFrame([("8b44e1a0b2c3fff",)], "id string"), 9)


def test_polygon_without_broadcast(cells, geometry, no_broadcast):
    box = [[[-81.995, 24.5], [-81.972, 24.5], [-81.972, 25.2], [-81.995, 25.2]]]
    inside = geometry.where("resolution = 11 AND lon > -81.995 AND lon < -81.972 AND lat > 24.5 AND lat < 25.2")
    expected = cells.join(inside.select(F.col("id").alias("r11_id")), "r11_id", "left_semi").count()
    assert 0 < hl.select_cells_polygon(cells, geometry, box).count() == expected


def test_skewed_cell_is_split(spark, no_broadcast):
    """A third of all rows on one cell: the shuffle join of rows and hits splits that partition."""
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from hexloom.sources import with_hierarchy

        base = 0x8B4400000000FFF
        number = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 343)
        rows = spark.range(0, 60000, numPartitions=8).select(
            cellid.cell_to_string(
                F.lit(base).cast("long").bitwiseOR(
                    F.shiftleft(number % 7, 12)
                    .bitwiseOR(F.shiftleft(F.floor(number / 7) % 7, 15))
                    .bitwiseOR(F.shiftleft(F.floor(number / 49) % 7, 18))
                )
            ).alias("id"),
            F.col("id").alias("v"),
        )
        cells = with_hierarchy(rows)
        picked = [f"{base:x}", f"{base | (1 << 12):x}", "8944000000bffff"]
        chosen = hl.select_cells_compact(cells, picked)
        frame = chosen.select("v")
        got = frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
        expected = {
            r["v"] for r in cells.select("v", "id", cellid.cell_to_string(F.col("r9_id")).alias("r9")).collect()
            if r["id"] in picked or r["r9"] in picked
        }
        assert {r["v"] for r in got} == expected and len(got) == len(expected)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
