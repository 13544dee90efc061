import pytest

import hexloom as hl


def test_shape(cells):
    rows = hl.stats(
        cells,
        [
            {"type": "number", "column": "tax"},
            {"type": "string", "column": "flag"},
            {"type": "boolean", "column": "discounted"},
            {"type": "number", "column": "tax"},
        ],
    ).collect()
    assert sorted({(r["property"], r["type"]) for r in rows}) == [
        ("discounted", "boolean"), ("flag", "string"), ("tax", "number")
    ]
    assert sum(r["type"] == "number" for r in rows) == 1
    nulls = [r for r in rows if r["type"] != "number" and r["value"] is None]
    assert len(nulls) == 2 and all(r["count"] == 0 for r in nulls)


@pytest.mark.parametrize(
    "properties", [[], [{"type": "number", "column": "nope"}], [{"type": "date", "column": "flag"}]]
)
def test_bad_requests(cells, properties):
    with pytest.raises(ValueError):
        hl.stats(cells, properties)


def test_one_scan_for_all_numbers(cells):
    plan = hl.stats(cells, [{"type": "number", "column": c} for c in ("tax", "l_quantity", "l_partkey")])
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_one_scan_for_all_values(cells):
    wanted = [{"type": "string", "column": "flag"}, {"type": "boolean", "column": "discounted"}]
    result = hl.stats(cells, [*wanted, {"type": "string", "column": "discounted"}])
    assert result._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert result.where("property = 'discounted'").count() == 6


def test_one_scan_for_a_mixed_request_on_a_selection(spark, tmp_path, cells):
    cells.write.parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    chosen = hl.select_cells(stored, ids=[r.id for r in cells.select("id").limit(50).collect()])
    wanted = [{"type": "number", "column": c} for c in ("tax", "l_quantity", "l_partkey")]
    wanted += [{"type": "string", "column": "flag"}, {"type": "boolean", "column": "discounted"}, {"type": "string", "column": "discounted"}]
    result = hl.stats(chosen, wanted)
    assert result._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r.property, r.type): r for r in result.where("type = 'number'").collect()}
    want = chosen.selectExpr("min(tax)", "max(tax)", "avg(tax)", "avg(l_partkey)").first()
    tax = found["tax", "number"]
    assert (tax.min, tax.max) == (want[0], want[1]) and tax.avg == pytest.approx(want[2]) and tax["count"] is None
    assert found["l_partkey", "number"].avg == pytest.approx(want[3])
    assert {r.property for r in result.where("type = 'boolean'").collect()} == {"discounted"}


def test_merged_numbers_of_an_empty_selection(cells):
    rows = hl.stats(cells.where("false"), [{"type": "number", "column": "tax"}, {"type": "string", "column": "flag"}]).collect()
    assert [tuple(r) for r in rows] == [("tax", "number", None, None, None, None, None)]
