"""Attribute filters: a mapping of column -> condition, compiled to one boolean Column.

Conditions are ``{"min": a, "max": b}`` (either or both, inclusive), ``{"bool": b}`` and
``{"choices": [...]}``.  Columns are combined with AND.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

Filters = Mapping[str, Any]


def parse_filters(text: str | None, lenient: bool = False) -> dict[str, Any]:
    """URL-encoded JSON to a filter mapping; empty text and ``null`` mean no filter.

    Malformed text raises; with ``lenient=True`` it means no filter instead.
    """
    if not text:
        return {}
    try:
        parsed = json.loads(unquote(text))
        if parsed is None:
            return {}
        if not isinstance(parsed, dict):
            raise ValueError(f"a filter must be a JSON object, not {type(parsed).__name__}")
        return parsed
    except ValueError:
        if lenient:
            log.warning("ignoring malformed filter %r", text)
            return {}
        raise


def resolve_column(df: DataFrame, name: str) -> Column:
    """The column of ``df`` called ``name`` (Spark's case rule); an unknown name is an error."""
    known = {c.lower(): c for c in df.columns}
    if name.lower() not in known:
        raise ValueError(f"unknown column {name!r}")
    return F.col(f"`{known[name.lower()]}`")


def _condition(column: Column, spec: Any, name: str) -> Column | None:
    if isinstance(spec, Mapping):
        # a bound that is present but null compares with NULL and keeps no row
        bounds = [column >= F.lit(spec["min"])] if "min" in spec else []
        if "max" in spec:
            bounds.append(column <= F.lit(spec["max"]))
        if bounds:
            return reduce(Column.__and__, bounds)
        if "bool" in spec:
            return column == F.lit(spec["bool"])
        if spec.get("choices"):
            return column.isin(list(spec["choices"]))
    log.warning("ignoring filter on %s: %r", name, spec)
    return None


def predicate(df: DataFrame, filters: Filters | None) -> Column | None:
    """Conjunction of all conditions, or None when nothing is filtered."""
    conditions = []
    for name, spec in (filters or {}).items():
        condition = _condition(resolve_column(df, name), spec, name)
        if condition is not None:
            conditions.append(condition)
    return reduce(Column.__and__, conditions) if conditions else None


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    condition = predicate(df, filters)
    return df if condition is None else df.where(condition)


def count_matching(df: DataFrame, filters: Filters | None) -> Column:
    """Aggregate counting the rows that pass, so one scan yields both counts."""
    condition = predicate(df, filters)
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)
