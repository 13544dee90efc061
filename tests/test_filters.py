import pytest
from pyspark.sql import functions as F

from hexloom.operators.filters import apply_filters, count_matching, parse_filters


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1.0, "a", True), (2.0, "b", False), (3.0, None, None), (None, "a", True)]
    return spark.createDataFrame(data, "v double, s string, b boolean")


@pytest.mark.parametrize(
    "filters, expected",
    [
        (None, 4),
        ({}, 4),
        ({"v": {"min": 2}}, 2),
        ({"v": {"max": 2}}, 2),
        ({"v": {"min": 2, "max": 2}}, 1),
        ({"v": {"min": None}}, 0),
        ({"v": {"min": None, "max": 9}}, 0),
        ({"b": {"bool": True}}, 2),
        ({"b": {"bool": False}}, 1),
        ({"s": {"choices": ["a", "x"]}}, 2),
        ({"s": {"choices": []}}, 4),
        ({"s": {"like": "a"}}, 4),
        ({"s": 5}, 4),
        ({"V": {"min": 1}, "s": {"choices": ["a"]}}, 1),
        ({"v": {"min": 1, "bool": True, "choices": ["a"]}}, 3),
    ],
)
def test_filters(rows, filters, expected):
    assert apply_filters(rows, filters).count() == expected
    assert rows.agg(count_matching(rows, filters)).first()[0] == expected


@pytest.mark.parametrize("name", ["nope", "1=1 or v", "v; drop table cells"])
def test_unknown_column(rows, name):
    with pytest.raises(ValueError, match="unknown column"):
        apply_filters(rows, {name: {"min": 1}})


def test_odd_column_name(spark):
    odd = spark.createDataFrame([(1,), (5,)], "`a.b c` int")
    assert apply_filters(odd, {"a.b c": {"min": 2}}).count() == 1


@pytest.mark.parametrize(
    "text, expected",
    [(None, {}), ("", {}), ("null", {}), ('{"a":{"min":1}}', {"a": {"min": 1}}), ("%7B%22a%22%3A%7B%22bool%22%3Atrue%7D%7D", {"a": {"bool": True}})],
)
def test_parse(text, expected):
    assert parse_filters(text) == expected


@pytest.mark.parametrize("text", ["{", "[1]", "5", '"x"'])
def test_parse_malformed(text):
    with pytest.raises(ValueError):
        parse_filters(text)
    assert parse_filters(text, lenient=True) == {}


def test_filter_reaches_the_scan(cells):
    plan = apply_filters(cells, {"l_quantity": {"min": 5, "max": 20}, "l_returnflag": {"choices": ["A"]}}).select(
        F.col("r11_id")
    )
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,5.0)" in text and "l_extendedprice" not in text
