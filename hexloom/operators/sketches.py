"""Approximate distinct counts from mergeable HyperLogLog sketches, on request beside the exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import cellid, tiles
from hexloom.operators.filters import Filters, apply_filters, resolve_column
from hexloom.operators.joins import dealt
from hexloom.operators.layers import COARSEST_STOP

#: 2^12 registers: a standard error of 1.04 / sqrt(4096), about 1.6 %, in 4 kB at most.
REGISTERS_LOG2 = 12


def approximate_count(cells: DataFrame, filters: Filters | None = None, registers: int = REGISTERS_LOG2) -> DataFrame:
    """About how many distinct finest cells match: ``(count)``. Nothing but one sketch per task is shuffled."""
    sketch = F.hll_sketch_agg("r11_id", F.lit(registers))
    matching = apply_filters(cells, filters).where(F.col("r11_id").isNotNull())
    return matching.agg(F.hll_sketch_estimate(sketch).alias("count"))


def distinct_sketch_pyramid(cells: DataFrame, column: str, registers: int = REGISTERS_LOG2) -> DataFrame:
    """``(id, resolution, sketch)`` for every hexagon of every stop: a sketch of the column's distinct values.

    Values are sketched per finest cell while they are read. Cells are shuffled by their coarsest drawn ancestor and the
    sketches of a family united there for all resolutions. ``F.hll_sketch_estimate`` gives the count of a sketch, and
    ``F.hll_union_agg`` that of several hexagons together. NULLs are no values; a hexagon without values has an empty
    sketch. Sketches of equal values are equal in what they estimate, whatever the order of the rows.
    """
    value = resolve_column(cells, column).cast("string").alias("value")
    located = cells.where(F.col("r11_id").isNotNull()).select("r11_id", value)
    per_cell = located.groupBy("r11_id").agg(F.hll_sketch_agg("value", F.lit(registers)).alias("sketch"))
    cell = F.col("r11_id")
    levels = F.array(*(F.struct(F.lit(res).alias("resolution"), cellid.cell_to_parent(cell, res, checked=False).alias("id")) for res in tiles.STOPS))
    families = per_cell.withColumn("family", cellid.cell_to_parent(cell, COARSEST_STOP, checked=False))
    grouped = dealt(families, "family").select("family", "sketch", F.inline(levels)).groupBy("family", "id", "resolution")
    return grouped.agg(F.hll_union_agg("sketch").alias("sketch")).select("id", "resolution", "sketch")
