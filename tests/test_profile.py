import math
import statistics

import pytest
from pyspark.sql import functions as F

import hexloom as hl
from hexloom.operators import profile as prof


@pytest.fixture(scope="module")
def table(spark):
    data = [
        ("8b44e1a0b2c3fff", 1, 0.5, 10, "a", True, 1.0, None, 1),
        ("8b44e1a0b2c3fff", 2, 0.1, 10, "a", None, 1.0, None, 1),
        ("8b44e1a0b2c2fff", 3, 0.1, 20, "b", False, 1.0, None, 1),
        ("8b44e1a0b2c1fff", 4, None, None, None, True, 1.0, None, 1),
    ]
    schema = (
        "id string, r9_id long, d double, n long, s string, b boolean, one double, empty double, small int"
    )
    return spark.createDataFrame(data, schema)


def versions(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "version long")


@pytest.mark.parametrize(
    "name, kept",
    [("r9_id", False), ("rapid", False), ("reef_grid", False), ("Hex_x", False), ("Hexx", False), ("Hex", True),
     ("hex_x", True), ("Shape_Area", False), ("id_1", False), ("id", True), ("depth", True), ("R9_id", True)],
)
def test_eligible(spark, name, kept):
    df = spark.createDataFrame([(1,)], f"`{name}` long")
    assert bool(hl.eligible_columns(df)) == kept


def test_eligible_without_id(table):
    names = [n for n, _ in hl.eligible_columns(table, skip_id=True)]
    assert names == ["d", "n", "s", "b", "one", "empty", "small"]


def test_profile(spark, table):
    rows = {r["attribute"]: r for r in hl.profile(table, versions(spark, 1, 3, 2)).collect()}
    assert list(rows) == ["id", "d", "n", "s", "b", "one", "empty", "small"]
    assert all(r["version"] == 3 and r["key"] == r["attribute"] for r in rows.values())
    assert (rows["id"]["count"], rows["id"]["countDistinct"], rows["id"]["values"]) == (3, 3, None)
    d = rows["d"]
    assert (d["type"], d["count"], d["countDistinct"], d["min"], d["max"]) == ("number", 3, 2, 0.1, 0.5)
    assert math.isclose(d["stats"]["avg"], 0.7 / 3)
    assert math.isclose(d["stats"]["stddev_samp"], statistics.stdev([0.5, 0.1, 0.1]))
    assert math.isclose(d["stats"]["stddev_pop"], statistics.pstdev([0.5, 0.1, 0.1]))
    assert d["stats"]["naturalBreaks"] == [] and len(d["stats"]["histogram"]) == 50
    assert tuple(d["stats"]["histogram"][-1]) == (0.5, None)
    assert rows["s"]["values"] == {"a": 2, "b": 1} and rows["s"]["count"] == 3
    assert rows["b"]["values"] == {"true": 2, "false": 1, "null": 1} and rows["b"]["count"] == 4
    assert rows["one"]["stats"]["histogram"][48]["count"] == 4
    assert (rows["empty"]["count"], rows["empty"]["countDistinct"], rows["empty"]["min"]) == (0, 0, None)
    assert [b["count"] for b in rows["empty"]["stats"]["histogram"]] == [0] * 49 + [None]
    assert rows["small"]["type"] == "number" and rows["small"]["count"] > 0


def test_many_values_stay_out_of_the_map(spark, table):
    rows = {r["attribute"]: r for r in hl.profile(table, versions(spark, 1), max_values=1).collect()}
    assert rows["s"]["values"] is None and rows["s"]["countDistinct"] == 2
    values = {(r["attribute"], r["value"]): r["count"] for r in hl.profile_values(table).collect()}
    assert values[("s", "a")] == 2 and values[("b", "null")] == 1


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_value_chunks_are_bounded_and_whole(spark, size):
    """A column of all-distinct values beside one with a hot value, a null column and booleans with nulls."""
    table = spark.range(3000).selectExpr(
        "concat('v', id) as many", "if(id % 3 = 0, 'hot', concat('w', id % 50)) as few", "cast(null as string) as none", "if(id % 5 = 0, null, id % 2 = 0) as flag"
    )
    chunks = hl.profile_value_chunks(table, size).collect()
    assert all(1 <= len(r["values"]) <= size for r in chunks)
    listed = [(r["attribute"], v, n) for r in chunks for v, n in r["values"].items()]
    assert sorted(listed) == sorted(tuple(r) for r in hl.profile_values(table).select("attribute", "value", "count").collect())
    assert len(listed) == len({(a, v) for a, v, _ in listed}) and ("few", "hot", 1000) in listed and ("flag", "null", 600) in listed


def test_value_chunks_of_nothing(spark, table):
    assert hl.profile_value_chunks(table.where("false"), 5).where("attribute <> 'b'").count() == 0
    assert hl.profile_value_chunks(spark.range(3).toDF("n"), 5).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        hl.profile_value_chunks(table, 0)


@pytest.mark.parametrize("values", [[], [0]])
def test_no_version(spark, table, values):
    with pytest.raises(ValueError):
        hl.profile(table, versions(spark, *values))


def test_all_null_text_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "s string, v double")
    rows = {r["attribute"]: r for r in hl.profile(df, versions(spark, 1)).collect()}
    assert (rows["s"]["count"], rows["s"]["countDistinct"], rows["s"]["values"]) == (0, 0, {})


def test_distinct_beyond_double_precision(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v long")
    assert prof.numeric_summary(df, ["v"]).first()["countDistinct"] == 2


def test_profile_file(spark, table):
    rows = {r["attribute"]: r for r in hl.profile_file(table.drop("small")).collect()}
    assert list(rows)[0] == "id" and rows["id"]["count"] == 4 and rows["id"]["countDistinct"] == 3
    assert math.isclose(rows["d"]["stats"]["stdev"], statistics.pstdev([0.5, 0.1, 0.1]))
    assert rows["d"]["values"] == {"0.1": 2, "0.5": 1} and rows["n"]["values"] == {"10": 2, "20": 1}
    assert rows["b"]["values"] == {"true": 2, "false": 1} and rows["b"]["count"] == 3
    assert rows["empty"]["stats"]["histogram"] == [] and rows["empty"]["count"] == 0


def test_file_profile_lists_few_values(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), F.concat(F.lit("t"), F.col("id") % 200).alias("s"))
    rows = {r["attribute"]: r for r in hl.profile_file(df).collect()}
    assert len(rows["v"]["values"]) == 10 and len(rows["s"]["values"]) == 50
    assert rows["s"]["countDistinct"] == 200


def test_rank_limit_is_applied_before_the_shuffle(cells):
    frequencies = prof.all_frequencies(cells, {"number": ["n"], "string": ["id"], "boolean": []})
    top = prof.top_values(frequencies, {"n": 10, "id": 50})
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_histogram_sums_to_non_null_count(cells):
    rows = hl.histograms(cells, ["l_quantity", "tax", "l_partkey"]).groupBy("attribute").agg(F.sum("count"), F.count("*"))
    expected = cells.agg(F.count("l_quantity"), F.count("tax"), F.count("l_partkey")).first()
    assert {r[0]: (r[1], r[2]) for r in rows.collect()} == dict(
        zip(["l_quantity", "tax", "l_partkey"], ((n, 49) for n in expected))
    )


def test_histogram_order_and_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 10)], "v double")
    rows = hl.histogram(df, "v", 5).collect()
    assert [tuple(r) for r in rows] == [
        (1, 0.0, 2.0, 2), (2, 2.0, 4.0, 2), (3, 4.0, 6.0, 1), (4, 6.0, 8.0, 0), (5, 8.0, 10.0, 1)
    ]


def test_values_just_below_the_maximum_stay_inside(spark):
    values = [0.0, 0.1, 0.3, math.nextafter(0.3, 0)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert hl.histogram(df, "v", 3).agg(F.sum("count")).first()[0] == len(values)


def test_buckets(spark):
    values = [i * 0.1 for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = hl.equal_interval_buckets(df, ["v"], 7).orderBy("bin").collect()
    low, high = min(values), max(values)
    breaks = [low + i * ((high - low) / 7.0) for i in range(7)]
    for i, row in enumerate(rows[:-1]):
        inside = [v for v in values if v >= breaks[i] and (i == 6 or v < breaks[i + 1])]
        assert (row["break"], row["count"]) == (breaks[i], len(inside))
    assert (rows[-1]["break"], rows[-1]["count"]) == (high, None)


def test_buckets_of_two_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    rows = hl.equal_interval_buckets(df, ["v"], 4).orderBy("bin").collect()
    assert [row["count"] for row in rows] == [1, 0, 0, 1, None]


NUMBER_TEXTS = [(5.0, "5"), (0.25, "0.25"), (-3.0, "-3"), (1e15, "1.0E15"), (0.0001, "0.0001"), (-1.2345e-6, "-0.0000012345"), (1e-6, "0.000001")]
NUMBER_TEXTS += [(12345678.5, "12345678.5"), (-123456789012345.12, "-123456789012345.12"), (0.00012345678901234567, "0.00012345678901234567"), (1e-7, "1.0E-7"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (None, None)]


@pytest.mark.parametrize("value, text", NUMBER_TEXTS)
def test_number_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(prof.number_text(F.col("v"))).first()[0] == text


def test_odd_names_and_narrow_numbers(spark):
    df = spark.createDataFrame([(1.0, "x", 7, 2.5), (2.0, None, 8, 2.5)], "`a.b c` double, `t.x` string, `n o` int, f float")
    rows = {r["attribute"]: r for r in hl.profile(df, versions(spark, 1)).collect()}
    assert rows["a.b c"]["countDistinct"] == 2 and rows["t.x"]["values"] == {"x": 1}
    counted = hl.stats(df, [{"type": "string", "column": "t.x"}]).select("value", "count").collect()
    assert {tuple(r) for r in counted} == {("x", 1), (None, 0)}
    summary = {r["attribute"]: r for r in prof.numeric_summary(df, ["a.b c", "n o", "f"]).collect()}
    assert [summary[c]["countDistinct"] for c in ("a.b c", "n o", "f")] == [2, 2, 1]
    assert hl.histogram(df, "n o", 2).count() == 2


def test_number_text_of_the_least_long(spark):
    values = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (2**53 + 1,), (None,)], "v long")
    assert [r[0] for r in values.select(prof.number_text(F.col("v"))).collect()] == [str(-(2**63)), str(2**63 - 1), str(2**53 + 1), None]


def test_not_finite_values_spoil_no_bins(spark):
    """NaN and infinities are in no bin, have no part in the moments and are counted."""
    nan, inf = float("nan"), float("inf")
    values = [1.0, 2.0, 2.5, 4.0, None]
    plain = spark.createDataFrame([(v, 1.0, i) for i, v in enumerate(values)], "v double, w double, n long")
    odd = plain.unionByName(spark.createDataFrame([(nan, nan, 9), (nan, inf, 9), (-inf, -inf, 9)], plain.schema))
    for bins in (1, 3, 10):
        want, got = (sorted(map(tuple, hl.histogram(d, "v", bins).where("bin IS NOT NULL").collect())) for d in (plain, odd))
        assert got == want and sum(r[-1] for r in got) == 4
        assert [tuple(r) for r in hl.histogram(odd, "v", bins).where("bin IS NULL").collect()] == [(None, None, None, 3)]
        assert hl.histogram(plain, "v", bins).where("bin IS NULL").isEmpty()
        want, got = (sorted(map(tuple, hl.equal_interval_buckets(d, ["v", "w"], bins).where("bin IS NOT NULL").collect()), key=str) for d in (plain, odd))
        assert got == want
        assert sorted(r["count"] for r in hl.equal_interval_buckets(odd, ["v", "w"], bins).where("bin IS NULL").collect()) == [3, 3]
    shares = hl.equal_interval_buckets(odd, ["v"], 3, fraction=True).where("count IS NOT NULL").collect()
    assert sum(r["count"] for r in shares) == pytest.approx(1) and {r["bin"]: r["count"] for r in shares}[None] == pytest.approx(3 / 7)
    want, got = ({r["attribute"]: r for r in prof.numeric_summary(d, ["v", "w"]).collect()} for d in (plain, odd))
    for name in "vw":
        assert got[name]["histogram"] == want[name]["histogram"] and got[name]["count"] == want[name]["count"] + 3
        assert [got[name][c] for c in ("min", "max", "avg", "stddev_samp")] == [want[name][c] for c in ("min", "max", "avg", "stddev_samp")]
    assert [got[c]["countDistinct"] - want[c]["countDistinct"] for c in "vw"] == [2, 3]
    only = spark.createDataFrame([(nan,), (inf,)], "v double")
    assert [tuple(r) for r in hl.histogram(only, "v", 2).where("count > 0").collect()] == [(None, None, None, 2)]
    assert prof.numeric_summary(only, ["v"]).first()["min"] is None
