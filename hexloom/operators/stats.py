"""Statistics of attributes over a selection of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.operators.filters import resolve_column

KINDS = ("number", "string", "boolean")


def _checked(cells: DataFrame, properties: Sequence[Mapping[str, str]]) -> dict[str, list[str]]:
    if not properties:
        raise ValueError("ask for at least one property")
    by_kind: dict[str, list[str]] = {kind: [] for kind in KINDS}
    for prop in properties:
        if prop["type"] not in by_kind:
            raise ValueError(f"unknown property type {prop['type']!r}")
        resolve_column(cells, prop["column"])
        if prop["column"] not in by_kind[prop["type"]]:
            by_kind[prop["type"]].append(prop["column"])
    return by_kind


def numeric_stats(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max and avg of each column: one aggregate over one scan, one result row per column."""
    summaries = [
        F.struct(
            F.lit(name).alias("property"),
            F.min(column).cast("double").alias("min"),
            F.max(column).cast("double").alias("max"),
            F.avg(column).alias("avg"),
        )
        for name in columns
        for column in (resolve_column(cells, name),)
    ]
    return cells.agg(F.array(*summaries).alias("rows")).select(F.inline("rows"))


def stats(cells: DataFrame, properties: Sequence[Mapping[str, str]]) -> DataFrame:
    """Long table of all requested statistics; ``properties`` are ``{"type", "column"}`` mappings.

    Number properties give one row with min, max and avg (NULL on an empty selection); string and
    boolean ones give one row per value.  All come from one scan: rows are unpivoted by text property and grouped by
    value, the numbers go along with the first of them, and the groups are merged to the rows asked for.
    """
    by_kind = _checked(cells, properties)
    kinds: dict[str, list[str]] = {}
    for kind in ("string", "boolean"):
        for column in by_kind[kind]:
            kinds.setdefault(column, []).append(kind)
    numbers, texts = by_kind["number"], list(kinds)
    if not texts:
        return numeric_stats(cells, numbers).select(_result_row("number"))
    values = [resolve_column(cells, c).cast("double").alias(f"n{k}") for k, c in enumerate(numbers)]
    unpivoted = F.array(*(F.struct(F.lit(k).alias("text"), resolve_column(cells, c).cast("string").alias("value")) for k, c in enumerate(texts)))
    first = [F.when(F.col("text") == 0, F.col(f"n{k}")).alias(f"n{k}") for k in range(len(numbers))]
    rows = cells.select(F.inline(unpivoted), *values).select("text", "value", *first)
    merged = [f(f"n{k}").alias(f"{name}{k}") for k in range(len(numbers)) for name, f in MERGED.items()]
    groups = rows.groupBy("text", "value").agg(F.count("value").alias("count"), *merged)
    if not numbers:
        return _value_rows(groups, texts, kinds)
    # a group gives a row for its value and, under the first text, one for the part that it has of each number
    none = {name: F.lit(None).cast("double").alias(name) for name in ("min", "max", "sum")}
    whole = F.struct("text", "value", "count", *none.values())
    parts = [F.struct(F.lit(-1 - k).alias("text"), F.lit(None).cast("string").alias("value"), *(F.col(f"{name}{k}").alias(name) for name in MERGED)) for k in range(len(numbers))]
    spread = groups.select(F.inline(F.when(F.col("text") == 0, F.array(whole, *parts)).otherwise(F.array(whole))))
    asked = cells.sparkSession.createDataFrame([(-1 - k, None, None, None, None, None) for k in range(len(numbers))], PARTIAL)
    final = spread.unionAll(asked).groupBy("text", "value").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum")
    )
    names = F.array(*(F.lit(c) for c in reversed(numbers)))
    averaged = final.withColumn("avg", F.try_divide("sum", "count"))
    number = F.struct(
        names[F.col("text") + len(numbers)].alias("property"), F.lit("number").alias("type"), "value",
        F.lit(None).cast("long").alias("count"), "min", "max", "avg",
    )
    of_text = F.array(*(F.array(*(F.struct(F.lit(c).alias("property"), F.lit(kind).alias("type"), "value", "count", "min", "max", "avg") for kind in kinds[c])) for c in texts))
    return averaged.select(F.inline(F.when(F.col("text") < 0, F.array(number)).otherwise(of_text[F.greatest("text", F.lit(0))])))


PARTIAL = "text int, value string, count long, min double, max double, sum double"

#: What is kept of a number in a group; all can be merged.
MERGED = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum}


def _result_row(kind: str) -> Column:
    nothing = [F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("count")]
    return F.inline(F.array(F.struct("property", F.lit(kind).alias("type"), *nothing, "min", "max", "avg")))


def _value_rows(groups: DataFrame, texts: Sequence[str], kinds: Mapping[str, list[str]]) -> DataFrame:
    none = [F.lit(None).cast("double").alias(name) for name in ("min", "max", "avg")]
    rows = F.array(*(F.array(*(F.struct(F.lit(c).alias("property"), F.lit(kind).alias("type"), "value", "count", *none) for kind in kinds[c])) for c in texts))
    return groups.select(F.inline(rows[F.col("text")]))
