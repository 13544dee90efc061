"""Cell-id extraction and the join of coarse attributes onto fine cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.functions import cellid
from hexloom.operators.joins import Size, key_bytes, lookup_side, row_bytes

RANK_LEVELS = 6


def extract_cell_ids(features: DataFrame, attribute: str = "GRID_ID") -> DataFrame:
    """The id attribute of every feature; the first invalid id fails the job."""
    value = F.col(f"`{attribute}`")
    problem = F.raise_error(
        F.concat(F.lit("invalid cell id: "), F.coalesce(value, F.lit("NULL")), F.lit(f" in attribute {attribute}"))
    )
    # in a filter, so that no plan leaves the check out
    checked = features.where(F.when(cellid.is_valid_cell_string(value), F.lit(True)).otherwise(problem.cast("boolean")))
    return checked.select(value.alias("id"))


def _with_cell(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_cell``, the LONG of the text ``id``.

    It is output of a generator: conditions on the cell, as joins add them, would otherwise be pushed down to the scan and
    work out the id again for each use of it in them, which cost more than the whole rest of a pass.
    """
    return rows.select("*", F.inline(F.array(F.struct(cellid.string_to_cell(F.col("id")).alias("_cell")))))


def last_per_id(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row per ``id``: the last in ``order_by``.  An aggregate, so repeated ids combine map-side."""
    values = [c for c in rows.columns if c != "id" and c not in order_by]
    order = F.struct(*order_by) if order_by else F.struct(*values)
    latest = F.max_by(F.struct(*values), order).alias("attrs")
    return _with_cell(rows).groupBy(F.col("_cell").alias("cell")).agg(latest)


def ranked(lookup: DataFrame, res: int, bases: dict[int, int] | None = None) -> DataFrame:
    """``lookup`` (distinct ``cell``) with ``rank`` 0..n-1 in id order, by prefix sums in two levels.

    Ids of one resolution sort like their ancestors, so a rank is the number of cells under earlier base cells, plus
    those of earlier families under the same base cell, plus the place within the family, at most 7^6 cells.  The driver
    gets the counts of the base cells, 122 numbers at most, unless they are given as ``bases``.
    """
    family = cellid.cell_to_parent(F.col("cell"), max(res - RANK_LEVELS, 0), checked=False)
    members = lookup.withColumn("family", family)
    earlier = Window.partitionBy("base").orderBy("family").rowsBetween(Window.unboundedPreceding, -1)
    base = cellid.base_cell(F.col("family"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size")).withColumn("base", base)
    starts, total = [0] * cellid.BASE_CELLS, 0
    if bases is None:
        bases = dict(map(tuple, sizes.groupBy("base").agg(F.sum("size")).collect()))
    for number in sorted(bases):
        starts[number], total = total, total + bases[number]
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.array(*(F.lit(n).cast("long") for n in starts))[F.col("base")]
    offsets = sizes.select("family", before.alias("offset"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("cell"))
    return members.withColumn("place", place).join(offsets, "family").select(
        "cell", "attrs", (F.col("offset") + F.col("place") - 1).alias("rank")
    )


def fallback_number(text: Column, seed: str, rows: int) -> Column:
    """A number in 0..rows-1 that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat(text, F.lit(seed))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(rows).cast("long"))


def join_attributes(
    fine_ids: DataFrame,
    coarse: DataFrame,
    *,
    order_by: Sequence[str] = (),
    fallback: bool = True,
    seed: str = "0",
) -> DataFrame:
    """Attributes of the coarse ancestor for every fine id, one output row per input row.

    ``coarse`` has a text ``id`` (all of one resolution) and attributes; of repeated ids the last in
    ``order_by`` counts.  An id without a coarse row takes the attributes of a seeded, repeatable
    random coarse row, or NULLs with ``fallback=False``.
    """
    attributes = [c for c in coarse.columns if c != "id" and c not in order_by]
    lookup = last_per_id(coarse, order_by)
    # one pass for all that is asked of the table: a row per resolution and base cell, 1,952 at most and one without id
    keys = [cellid.resolution(F.col("cell")).alias("res"), cellid.base_cell(F.col("cell")).alias("base")]
    counts = lookup.groupBy(*keys).agg(F.count("cell").alias("rows"), F.sum(row_bytes(lookup.schema)).alias("bytes")).collect()
    rows, size = (sum(row[c] for row in counts) for c in ("rows", "bytes"))
    found = [row["res"] for row in counts if row["res"] is not None]
    lowest, highest = min(found, default=None), max(found, default=None)
    if lowest != highest:
        raise ValueError(f"coarse ids mix resolutions {lowest} to {highest}")
    if not rows:
        raise ValueError("the coarse table has no valid id")
    size = Size(rows, size)
    lookup = lookup.where(F.col("cell").isNotNull())

    fine = _with_cell(fine_ids.select("id")).select("id", cellid.cell_to_parent(F.col("_cell"), lowest).alias("cell"))
    if not fallback:
        hits = fine.join(lookup_side(lookup, size), "cell", "left")
        return hits.select("id", *(F.col(f"attrs.`{c}`").alias(c) for c in attributes))
    # A row's key is its ancestor or, where that has no coarse row, the negative rank of a substitute.  Which ancestors
    # have none is found among the distinct ones; the rows then meet the attributes once.
    missing = fine.select("cell").distinct().join(lookup.select("cell"), "cell", "left_anti")
    missing = missing.where(F.col("cell").isNotNull()).select(F.col("cell").alias("absent"))
    missing = lookup_side(missing, key_bytes(missing.count()))
    flagged = fine.join(missing, fine["cell"] == missing["absent"], "left")
    substitute = -1 - fallback_number(F.col("id"), seed, rows)
    keyed = flagged.select("id", F.when(F.col("absent").isNotNull() | F.col("cell").isNull(), substitute).otherwise(F.col("cell")).alias("key"))
    bases = {row["base"]: row["rows"] for row in counts if row["base"] is not None}
    both = ranked(lookup, lowest, bases).select("attrs", F.explode(F.array("cell", -1 - F.col("rank"))).alias("key"))
    joined = keyed.join(lookup_side(both, Size(2 * size.rows, 2 * size.bytes)), "key", "left")
    return joined.select("id", *(F.col("attrs")[c].alias(c) for c in attributes))
