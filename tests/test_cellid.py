import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexloom.functions import cellid


def make_cell(base, digits):
    """A cell index from its parts, as the layout is published."""
    cell = (1 << 59) | (len(digits) << 52) | (base << 45)
    for level in range(1, 16):
        digit = digits[level - 1] if level <= len(digits) else 7
        cell |= digit << (3 * (15 - level))
    return cell


def ids(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "id string")


def test_known_ids(spark):
    rows = ids(spark, ["8b44e1a0b2c3fff", "8928308280fffff", "08009fffffffffff", "8009FFFFFFFFFFF"])
    cell = cellid.string_to_cell(F.col("id"))
    out = rows.select(
        cellid.resolution(cell), cellid.base_cell(cell), cellid.cell_to_string(cell), cellid.is_valid_cell(cell)
    ).collect()
    assert [tuple(r) for r in out] == [
        (11, 34, "8b44e1a0b2c3fff", True),
        (9, 20, "8928308280fffff", True),
        (0, 4, "8009fffffffffff", True),
        (0, 4, "8009fffffffffff", True),
    ]


@pytest.mark.parametrize(
    "text",
    [
        "zz", "", None, "8b44e1", "8b44e1a0b2c3ff0", "7b44e1a0b2c3fff", "9b44e1a0b2c3fff", "8b44e1a0b2c3ffff",
        "ffffffffffffffff", "8b44e1a0b2c3ffg",
        f"{make_cell(122, [0] * 11):x}", f"{make_cell(3, [0, 7, 1]):x}", f"{make_cell(4, [0, 1, 2]):x}",
    ],
)
def test_invalid(spark, text):
    assert not ids(spark, [text]).select(cellid.is_valid_cell_string(F.col("id"))).first()[0]


def test_pentagon_neighbours_are_valid(spark):
    texts = [f"{make_cell(4, d):x}" for d in ([0, 0], [0, 2, 1], [3, 1], [2, 0, 1])] + [f"{make_cell(5, [0, 1]):x}"]
    assert all(r[0] for r in ids(spark, texts).select(cellid.is_valid_cell_string(F.col("id"))).collect())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 121), st.lists(st.integers(0, 6), min_size=0, max_size=15)), min_size=1, max_size=20))
def test_parents(spark, parts):
    rows = spark.createDataFrame([(make_cell(b, d),) for b, d in parts], "cell long")
    out = rows.select("cell", *(cellid.cell_to_parent(F.col("cell"), r).alias(f"r{r}") for r in range(16))).collect()
    by_cell = {row["cell"]: row for row in out}
    for base, digits in parts:
        row = by_cell[make_cell(base, digits)]
        for res in range(16):
            expected = make_cell(base, digits[:res]) if res <= len(digits) else None
            assert row[f"r{res}"] == expected


def test_parent_of_parent_is_parent(cells):
    cell = F.col("r11_id")
    twice = cellid.cell_to_parent(cellid.cell_to_parent(cell, 8), 5)
    assert cells.where(twice != cellid.cell_to_parent(cell, 5)).count() == 0


def test_bad_resolution():
    with pytest.raises(ValueError):
        cellid.cell_to_parent(F.lit(1), 16)


def test_scan_ranges_hold_all_descendants(spark):
    import hexloom as hl
    from hexloom.operators.joins import scan_ranges

    texts = ["8944e1a0b2fffff", "8a44e1a0b0c7fff", "8b44e1a0b2c3fff", "8b44e1a0b2c3fff", "8b45000000c3fff"]
    ids = spark.createDataFrame([(t,) for t in texts], "id string")
    cells = [r.id for r in hl.uncompact_cells(ids).collect()]
    lengths = []
    for most in (1, 2, 10):
        rows, ranges = scan_ranges(ids.select(cellid.string_to_cell(F.col("id")).alias("id")), most)
        assert rows == 5 and len(ranges) <= most and ranges == sorted(ranges)
        assert all(any(low <= c <= high for low, high in ranges) for c in cells)
        lengths.append(sum(high - low for low, high in ranges))
    assert lengths[0] > lengths[1] > lengths[2] and min(r[0] for r in ranges) == min(cells) and max(r[1] for r in ranges) == max(cells)
    assert scan_ranges(ids.select(F.lit(1).cast("long").alias("id")).where("false")) == (0, [])


def test_a_gap_under_a_selected_ancestor_is_none(spark):
    from hexloom.operators.joins import scan_ranges

    texts = ["8344e1fffffffff", "8b44e1a0b2c3fff", "8b44e1a0ffc3fff", "8b45000000c3fff"]
    ids = spark.createDataFrame([(int(t, 16),) for t in texts], "id long")
    low, high = cellid.finest_range(int(texts[0], 16))
    assert low <= int(texts[1], 16) <= high
    _, ranges = scan_ranges(ids)
    assert any(a <= low and high <= b for a, b in ranges) and len(ranges) == 2
