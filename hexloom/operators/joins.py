"""Joins against a lookup side whose size is measured before it is broadcast.

Beyond the bound the join stays a shuffle join: AQE splits skewed partitions of the row side there (inner, left and
left-semi joins all allow it).  It is hinted as one, as Spark's own estimate doesn't see what generators multiply.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.functions import cellid

MAX_BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD_BYTES = 24


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, limit: int | None = None) -> bool:
        return self.bytes <= (MAX_BROADCAST_BYTES if limit is None else limit)


def row_bytes(schema: T.StructType) -> Column:
    """Estimated bytes of one row: text by length, nested values by their JSON, the rest 8 bytes."""
    parts = [F.lit(ROW_OVERHEAD_BYTES).cast("long")]
    for field in schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(8))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + F.lit(8))
        else:
            parts.append(F.lit(8))
    return reduce(Column.__add__, parts)


def measure(df: DataFrame) -> Size:
    """Rows and estimated bytes of ``df`` in one aggregate job."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()
    return Size(rows, size)


def key_bytes(rows: int) -> Size:
    """Size of ``rows`` LONG keys."""
    return Size(rows, rows * (8 + ROW_OVERHEAD_BYTES))


def lookup_side(df: DataFrame, size: Size | None = None) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within the bound, else with one that rules a broadcast out."""
    size = measure(df) if size is None else size
    return F.broadcast(df) if size.fits() else df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by the hash of ``keys`` in ``spark.sql.shuffle.partitions`` parts, which AQE doesn't merge.

    For steps whose rows shrink much in a shuffle, as ids do, or grow after it: AQE sizes tasks by their compressed bytes,
    and some megabytes of ids would become a task that spills many times as much.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Gaps are searched within ancestors of this resolution (288,122 in all) and between them.
FAMILY_RESOLUTION = 4
MOST_RANGES = 16


def scan_ranges(ids: DataFrame, most: int = MOST_RANGES) -> tuple[int, list[tuple[int, int]]]:
    """How many rows ``ids`` (LONG ``id``) has, and at most ``most`` ranges of finest ids that hold all descendants.

    The ranges leave out the widest gaps. Gaps within a family come from a window per family, of which only the widest
    ``most`` reach the driver; beside them it gets the bounds of each family.
    """
    cell = F.col("id")
    family = F.when(cellid.resolution(cell) > FAMILY_RESOLUTION, cellid.cell_to_parent(cell, FAMILY_RESOLUTION)).otherwise(cell)
    low, high = cellid.finest_bounds(cell)
    rows = ids.select(family.alias("family"), low.alias("low"), high.alias("high"))
    in_order = Window.partitionBy("family").orderBy("low")
    reach = F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    gaps = rows.select(reach.alias("low"), F.lead("low").over(in_order).alias("high")).where("high > low")
    gaps = gaps.select(F.lit(0).cast("long").alias("rows"), "low", "high").orderBy(F.desc(F.col("high") - F.col("low")), "low").limit(most)
    families = rows.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = families.select("rows", "low", "high").unionAll(gaps).collect()
    spans = sorted((row["low"], row["high"]) for row in found if row["rows"])
    return sum(row["rows"] for row in found), cellid.ranges_without_gaps(spans, [(row["low"], row["high"]) for row in found if not row["rows"]], most)


def prune(cells: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """``cells`` cut to a few ranges of ``r11_id``.

    They are plain comparisons: on clustered cells Parquet skips the row groups and pages outside.  They keep more than
    is wanted, never less; a join decides afterwards.
    """
    tests = [F.col("r11_id").between(low, high) for low, high in ranges]
    return cells.where(reduce(Column.__or__, tests)) if tests else cells.where(F.lit(False))
