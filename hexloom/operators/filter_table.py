"""Counts for a whole table of filters in one scan of the cells."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.operators.filters import parse_filters, resolve_column

CONDITION = "struct<kind:string,place:int,low:double,high:double,flag:boolean,choices:array<string>>"


def _condition(name: str, spec, places: dict[str, int]) -> dict | None:
    """One condition as a row; the kinds go in the order number, boolean, text, and other shapes are none."""
    row = {"place": places.setdefault(name.lower(), len(places))}
    if isinstance(spec, Mapping):
        if "min" in spec or "max" in spec:
            absent = [bound for bound in ("min", "max") if bound in spec and spec[bound] is None]
            return row | {"kind": "never" if absent else "number", "low": spec.get("min"), "high": spec.get("max")}
        if "bool" in spec:
            return row | {"kind": "boolean", "flag": spec["bool"]}
        if spec.get("choices"):
            return row | {"kind": "text", "choices": [str(c) for c in spec["choices"]]}
    return None


def count_filters(cells: DataFrame, filters: DataFrame, lenient: bool = False) -> DataFrame:
    """``(filter_id, count)``: distinct finest cells that match each filter of a table ``(filter_id, filter)``.

    ``filter`` is the text of a filter, URL-encoded or plain JSON, as :func:`parse_filters` reads it; ``filter_id`` is
    not NULL and not repeated. A cell matches a filter when none of the filter's conditions fails. Cells are read once and
    only as wide as the filters. Up to some hundred filters a cell moves once, with a bit for each filter; beyond that,
    conditions are rows kept with their filter, and a cell moves once for each filter that it matches. The filters, not the
    cells, come to the driver, as the filters of a request do.
    """
    rows = filters.select("filter_id", "filter").collect()
    places: dict[str, int] = {}
    table = []
    for row in rows:
        conditions = [_condition(name, spec, places) for name, spec in parse_filters(row["filter"], lenient).items()]
        table.append({"id": len(table), "conditions": [c for c in conditions if c]})
    columns = [resolve_column(cells, name) for name in places]
    kinds = {f.name.lower(): f.dataType for f in cells.schema}
    kind = T.StructType([T.StructField("place", T.IntegerType()), filters.schema["filter_id"]])
    named = cells.sparkSession.createDataFrame([(k, row["filter_id"]) for k, row in enumerate(rows)], kind)
    given = F.from_json(F.lit(json.dumps(table)), f"array<struct<id:int,conditions:array<{CONDITION}>>>")
    few = len(table) <= MOST_MASKS * MASK_BITS
    counts = (_by_masks if few else _by_rows)(cells, given, columns, [kinds[name] for name in places])
    return named.join(counts, "place", "left").select("filter_id", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


#: Filters of one mask, and how many masks a cell may have.
MASK_BITS = 62
MOST_MASKS = 4


def _by_masks(cells: DataFrame, given: Column, columns: list[Column], kinds: list[T.DataType]) -> DataFrame:
    """``(place, count)`` for some hundred filters: a row has a bit for each filter that it matches, a cell those of its rows."""
    every = cells.sparkSession.range(1).select(given.alias("given")).first()["given"]

    def holds(c) -> Column:
        column, kind = columns[c["place"]], kinds[c["place"]]
        if c["kind"] == "number":
            number = _as(column, kind, "double")
            tests = [number.isNotNull()] + ([number >= c["low"]] if c["low"] is not None else []) + ([number <= c["high"]] if c["high"] is not None else [])
            return reduce(Column.__and__, tests)
        if c["kind"] == "boolean":
            return _as(column, kind, "boolean") == F.lit(c["flag"]).cast("boolean")
        return column.cast("string").isin(c["choices"]) if c["kind"] == "text" else F.lit(False)

    # each different condition is tested once; a filter then needs some of their bits
    different = list({c: None for f in every for c in (tuple(_hashable(v) for v in c) for c in f["conditions"])})
    own = {c: k for k, c in enumerate(different)}
    by_key = {tuple(_hashable(v) for v in c): c for f in every for c in f["conditions"]}
    held = [f"h{k // MASK_BITS}" for k in range(0, len(different), MASK_BITS)]
    tested = [_mask([holds(by_key[c]) for c in different[k : k + MASK_BITS]]).alias(f"h{k // MASK_BITS}") for k in range(0, len(different), MASK_BITS)]

    def matches(f) -> Column:
        need: dict[str, int] = {}
        for k in {own[tuple(_hashable(v) for v in c)] for c in f["conditions"]}:
            need[held[k // MASK_BITS]] = need.get(held[k // MASK_BITS], 0) | 1 << k % MASK_BITS
        return reduce(Column.__and__, [F.col(name).bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long") for name, bits in need.items()], F.lit(True))

    masks = [_mask([matches(f) for f in every[k : k + MASK_BITS]]).alias(f"m{k // MASK_BITS}") for k in range(0, len(every), MASK_BITS)]
    if not masks:
        return cells.sparkSession.createDataFrame([], "place int, count long")
    # output of generators, so that the test of the masks doesn't work them out again
    rows = cells.where(F.col("r11_id").isNotNull()).select("r11_id", *([F.inline(F.array(F.struct(*tested)))] if tested else []))
    marked = rows.select("r11_id", F.inline(F.array(F.struct(*masks))))
    some = marked.where(reduce(Column.__or__, [F.col(f"m{k}") != 0 for k in range(len(masks))]))
    per_cell = some.groupBy("r11_id").agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(len(masks))))
    sums = [F.count_if(F.col(f"m{k // MASK_BITS}").bitwiseAND(F.lit(1 << k % MASK_BITS).cast("long")) != 0) for k in range(len(every))]
    return per_cell.agg(F.array(*sums).alias("counts")).select(F.posexplode("counts").alias("place", "count"))


def _mask(tests: list[Column]) -> Column:
    bits = [F.when(test, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, test in enumerate(tests)]
    return reduce(Column.bitwiseOR, bits)


def _hashable(value):
    return tuple(value) if isinstance(value, list) else value


def _by_rows(cells: DataFrame, given: Column, columns: list[Column], kinds: list[T.DataType]) -> DataFrame:
    """``(place, count)`` for any number of filters: a row per filter that a cell matches."""
    texts = F.array(*(c.cast("string") for c in columns)).cast("array<string>")
    numbers = F.array(*(_as(c, kind, "double") for c, kind in zip(columns, kinds))).cast("array<double>")
    flags = F.array(*(_as(c, kind, "boolean") for c, kind in zip(columns, kinds))).cast("array<boolean>")
    held = cells.select("r11_id", texts.alias("texts"), numbers.alias("numbers"), flags.alias("flags"))

    def holds(c: Column) -> Column:
        number, text, flag = (F.get(F.col(name), c["place"]) for name in ("numbers", "texts", "flags"))
        inside = (c["low"].isNull() | (number >= c["low"])) & (c["high"].isNull() | (number <= c["high"]))
        kind = F.when(c["kind"] == "number", inside & number.isNotNull()).when(c["kind"] == "boolean", flag == c["flag"])
        return F.coalesce(kind.when(c["kind"] == "text", F.array_contains(c["choices"], text)).otherwise(F.lit(False)), F.lit(False))

    matching = F.transform(F.filter(given, lambda f: F.forall(f["conditions"], holds)), lambda f: f["id"])
    found = held.select(F.explode(matching).alias("place"), "r11_id")
    return found.groupBy("place").agg(F.count_distinct("r11_id").alias("count"))


def _as(column: Column, kind: T.DataType, wanted: str) -> Column:
    """The column as a number or a boolean; a type that isn't one has none."""
    if wanted == "boolean":
        return column if isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return column.cast("string").try_cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")
