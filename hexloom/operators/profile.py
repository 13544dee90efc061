"""Attribute profiles: counts, distincts, spread, histograms and value frequencies of all columns.

Numeric columns take two scans.  The first is one aggregate without a data shuffle (count, min, max,
avg, deviations of every column); its single row fixes the bin edges.  The second unpivots the
columns and groups by ``(attribute, value)``, which is what an exact distinct count needs anyway, and
the histogram falls out of the same groups.  Text and boolean columns are grouped by
``(attribute, value)`` once; only columns with few values are read again to list them in one map.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.operators.filters import resolve_column
from hexloom.operators.joins import dealt

BINS = 49

# Column names a profile leaves out.  In the LIKE patterns they stand for, "_" is any
# one character, so "rapid" goes the way of "r9_id".
SKIPPED_NAME_PATTERNS = [r"^r.*.id$", r"^Hex.", r"^Shape.", r"^id_1$"]

# How many values of an attribute a file profile lists.
LISTED_VALUES = {"number": 10, "string": 50, "boolean": 50}

VALUE_CHUNKS = "attribute string, bucket long, chunk long, values map<string,long>"
BUCKET_TYPE = "array<struct<break:double,count:long>>"
DOCUMENT_COLUMNS = (
    "position", "key", "attribute", "type", "count", "countDistinct", "min", "max", "values", "stats"
)
EMPTY_BREAKS = ("equalInterval", "naturalBreaks", "quantiles", "geometricInterval", "standardDeviations")


def attribute_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "mixed"


def eligible_columns(df: DataFrame, skip_id: bool = False) -> list[tuple[str, str]]:
    """``(name, type)`` of the attribute columns in table order.  Reads the schema only."""
    names = [
        field
        for field in df.schema
        if not any(re.search(p, field.name) for p in SKIPPED_NAME_PATTERNS)
        and not (skip_id and field.name == "id")
    ]
    return [(field.name, attribute_type(field.dataType)) for field in names]


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max("version").alias("version"))


def max_version(versions: DataFrame) -> int:
    """The newest version; a table without one (or only 0) is an error."""
    version = latest_version(versions).first()[0]
    if not version:
        raise ValueError("no version found")
    return version


# --- binning -----------------------------------------------------------------------------------


def finite(value: Column) -> Column:
    """The value, NULL if it is NaN or infinite."""
    size = F.abs(value.cast("double"))
    return F.when(~F.isnan(size) & (size < float("inf")), value)


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based equal-width bin; the maximum and constant columns go to the last bin."""
    width = (high - low) / F.lit(float(bins))
    position = F.try_divide(value - low, width)
    inner = F.least(F.lit(bins), 1 + F.floor(position).try_cast("int"))
    return (
        F.when(low.isNull() | high.isNull() | value.isNull(), None)
        .when((high == low) | (value == high), F.lit(bins))
        .otherwise(inner)
    )


def bin_edges(low: Column, high: Column, number: Column, bins: int) -> tuple[Column, Column]:
    width = (high - low) / F.lit(float(bins))
    start = low + (number - 1) * width
    return start, F.when(number == bins, high).otherwise(low + number * width)


def bucket_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin by comparison with the breaks: ``break <= value < next break``, the last one closed.

    Starts from :func:`bin_number` and moves by one where rounding of the quotient and of the break
    disagree.
    """
    first = bin_number(value, low, high, bins)
    start, end = bin_edges(low, high, first, bins)
    return (
        F.when((first > 1) & (high != low) & (value < start), first - 1)
        .when((first < bins) & (value >= end), first + 1)
        .otherwise(first)
    )


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(attribute, value)`` of columns of one type, without nulls."""
    named = [F.col(f"`{c}`") for c in columns]
    return df.unpivot([], named, "attribute", "value").where("value IS NOT NULL")


def _as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(resolve_column(df, c).cast("double").alias(c) for c in columns))


def _bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest finite value per column: one row per column."""
    values = _as_double(df, columns)
    rows = [
        F.struct(F.lit(c).alias("attribute"), F.min(finite(F.col(f"`{c}`"))).alias("low"), F.max(finite(F.col(f"`{c}`"))).alias("high"))
        for c in columns
    ]
    return values.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _fill_bins(bounds: DataFrame, counts: DataFrame, bins: int) -> DataFrame:
    """All bins of every column, empty ones with 0, and the bin NULL where values are in none.

    Both sides have at most columns x bins rows.
    """
    numbers = F.array_append(F.sequence(F.lit(1), F.lit(bins)), F.lit(None).cast("int"))
    every = bounds.select("*", F.explode(numbers).alias("bin"))
    found = counts.select(F.col("attribute").alias("of"), F.col("bin").alias("number"), "count")
    same = (F.col("attribute") == F.col("of")) & F.col("bin").eqNullSafe(F.col("number"))
    filled = every.join(F.broadcast(found), same, "left").where("bin IS NOT NULL OR count IS NOT NULL")
    start, end = bin_edges(F.col("low"), F.col("high"), F.col("bin"), bins)
    return filled.select(
        "attribute",
        "bin",
        start.alias("bin_start"),
        end.alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Equal-width histograms of several columns in long form, every bin present.

    NaN and infinite values are in no bin: they are counted in a row of the bin NULL, there if a column has any.
    """
    bounds = _bounds(df, columns)
    values = unpivot(_as_double(df, columns), columns)
    number = bin_number(finite(F.col("value")), F.col("low"), F.col("high"), bins)
    counts = (
        values.join(F.broadcast(bounds), "attribute")  # one row per column of the schema
        .groupBy("attribute", number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _fill_bins(bounds, counts, bins)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bin, bin_start, bin_end, count`` of one column, in bin order."""
    return histograms(df, [column], bins).drop("attribute").orderBy("bin")


def equal_interval_buckets(df: DataFrame, columns: Sequence[str], bins: int = BINS, fraction: bool = False) -> DataFrame:
    """Lower-closed buckets ``(attribute, break, count)`` and a closing ``(max, NULL)`` row.

    ``fraction=True`` gives shares of the non-null rows.  NaN and infinite values are counted in a row whose bin and
    break are NULL.
    """
    bounds = _bounds(df, columns)
    values = unpivot(_as_double(df, columns), columns)
    number = bucket_number(finite(F.col("value")), F.col("low"), F.col("high"), bins)
    counts = (
        values.join(F.broadcast(bounds), "attribute")
        .groupBy("attribute", number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    filled = _fill_bins(bounds, counts, bins)
    per_attribute = Window.partitionBy("attribute")  # ``bins`` rows each
    total = F.sum("count").over(per_attribute)
    share = F.try_divide(F.col("count").cast("double"), F.col("total")) if fraction else F.col("count")
    sized = filled.withColumn("total", total)
    breaks = sized.select("attribute", "bin", F.col("bin_start").alias("break"), share.alias("count"))
    closing = sized.where(F.col("bin") == bins).select(
        "attribute", F.lit(bins + 1).alias("bin"), F.col("bin_end").alias("break"), F.lit(None).alias("count")
    )
    return breaks.unionByName(closing)


# --- summaries ---------------------------------------------------------------------------------


MOMENTS = (
    "attribute string, count long, min double, max double, avg double, stddev_samp double, stddev_pop double"
)


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, max, avg and both standard deviations: one row per column, no data shuffle.

    NaN and infinite values count, but have no part in the other figures.
    """
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    rows = []
    for name in columns:
        every = resolve_column(df, name)
        column = finite(every) if name in floating else every
        rows.append(
            F.struct(
                F.lit(name).alias("attribute"),
                F.count(every).alias("count"),
                F.min(column).cast("double").alias("min"),
                F.max(column).cast("double").alias("max"),
                F.avg(column).alias("avg"),
                F.stddev_samp(column).alias("stddev_samp"),
                F.stddev_pop(column).alias("stddev_pop"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per ``(attribute, value)`` of columns of one type, in one shuffle of groups."""
    return unpivot(df, columns).groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("count"))


def _counted_apart(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`_counted` for columns of very many values: both groupings are in a given number of tasks.

    The groups of a scan task grow with its file split and those of a merged task with what AQE calls small, as ids compress
    well. Here rows are dealt out first and counted where they are, so a frequent value is one row per task all the same,
    and the counts are dealt out by value. The generator keeps the parts of the first shuffle for the first grouping.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(f"`{c}`") for c in columns]
    part = F.pmod(F.xxhash64(*own), F.lit(parts)).cast("int").alias("part")
    rows = df.select(*(c.alias(f"v{k}") for k, c in enumerate(own)), part).repartitionById(parts, "part")
    pairs = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"v{k}").alias("value")) for k, c in enumerate(columns)))
    groups = rows.select("part", F.inline(pairs)).where("value IS NOT NULL").groupBy("part", "attribute", "value")
    counts = dealt(groups.agg(F.count(F.lit(1)).alias("count")), "attribute", "value")
    return counts.groupBy("attribute", "value").agg(F.sum("count").alias("count"))


def _value_groups(df: DataFrame, columns: Sequence[str], counted: Callable = _counted) -> list[DataFrame]:
    """Rows per ``(attribute, value)`` of numeric columns, one frame per data type.

    BIGINT values are not cast: beyond 2^53 a cast to double would merge them.
    """
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    frames = []
    for kind, chosen in (
        ("double", [c for c in columns if c not in whole]),
        ("long", [c for c in columns if c in whole]),
    ):
        if chosen:
            typed = df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c in chosen))
            frames.append(counted(typed, chosen))
    return frames


def _binned_groups(groups: list[DataFrame], moments: DataFrame, bins: int) -> DataFrame:
    """Rows and distinct values per bin, from the value groups: ``columns x bins`` rows."""
    bounds = F.broadcast(moments.select("attribute", F.col("min").alias("low"), F.col("max").alias("high")))
    number = bin_number(finite(F.col("value").cast("double")), F.col("low"), F.col("high"), bins)
    parts = [
        group.join(bounds, "attribute")
        .groupBy("attribute", number.alias("bin"))
        .agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("distinct"))
        for group in groups
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _fixed_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The moments as a local table: one row per numeric column of the schema."""
    return df.sparkSession.createDataFrame(numeric_moments(df, columns).collect(), MOMENTS)


def numeric_summary(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Moments, exact distinct count and histogram of numeric columns, one row per column."""
    moments = _fixed_moments(df, columns)
    return _summarised(moments, _value_groups(df, columns), bins)


def _summarised(moments: DataFrame, groups: list[DataFrame], bins: int) -> DataFrame:
    binned = _binned_groups(groups, moments, bins)
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "count"))
    per_column = binned.groupBy("attribute").agg(
        F.sum("distinct").alias("countDistinct"), F.map_from_entries(F.collect_list(entry)).alias("by_bin")
    )
    return moments.join(F.broadcast(per_column), "attribute", "left").select(
        *moments.columns,
        F.coalesce("countDistinct", F.lit(0).cast("long")).alias("countDistinct"),
        _encode_histogram(F.col("min"), F.col("max"), F.col("by_bin"), bins).alias("histogram"),
    )


def _encode_histogram(low: Column, high: Column, by_bin: Column, bins: int) -> Column:
    """``[bin start, count]`` in bin order, empty bins with 0, and a last ``[high, NULL]``."""

    def bucket(number: Column) -> Column:
        start, _ = bin_edges(low, high, number, bins)
        count = F.coalesce(F.try_element_at(by_bin, number), F.lit(0)).cast("long")
        return F.struct(start.alias("break"), count.alias("count"))

    last = F.struct(high.alias("break"), F.lit(None).cast("long").alias("count"))
    return F.array_append(F.transform(F.sequence(F.lit(1), F.lit(bins)), bucket), last)


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of text and boolean columns in long form.

    A null boolean is the value ``"null"``; a null text is no value.
    """
    texts = []
    for field in df.schema:
        if field.name in columns:
            text = F.col(f"`{field.name}`").cast("string")
            if isinstance(field.dataType, T.BooleanType):
                text = F.coalesce(text, F.lit("null"))
            texts.append(text.alias(field.name))
    return (
        unpivot(df.select(*texts), [c for c in df.columns if c in columns])
        .groupBy("attribute", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def value_summary(frequencies: DataFrame) -> DataFrame:
    """count and countDistinct per attribute of :func:`value_frequencies`."""
    return frequencies.groupBy("attribute").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("countDistinct")
    )


def number_text(value: Column) -> Column:
    """Number as a map key: whole numbers without a fraction part, others from 1e-6 up to 1e15 as plain decimals."""
    text, size = value.cast("string"), F.abs(value.cast("double"))
    whole = (value == F.floor(value)) & (size < F.lit(1e15))
    # the shortest digits of the number have at most 17 places, the first of them the sixth after the point
    plain = F.rtrim(text.try_cast("decimal(38, 23)").cast("string"), F.lit("0"))
    return (
        F.when(whole, value.cast("double").try_cast("long").cast("string"))
        .when(text.contains("E") & (size >= 1e-6) & (size < 1e15), plain)
        .otherwise(text)
    )


def _text_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Rows per non-null value of text and boolean columns."""
    if not columns:
        return None
    return value_frequencies(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)), columns)


def _as_frequencies(groups: list[DataFrame], words: DataFrame | None) -> DataFrame:
    frames = [g.select("attribute", number_text(F.col("value")).alias("value"), "count") for g in groups]
    return reduce(DataFrame.unionByName, frames + ([words] if words is not None else []))


def all_frequencies(df: DataFrame, by_type: dict[str, list[str]]) -> DataFrame:
    """Rows per non-null value of columns of all types: ``(attribute, value, count)``."""
    texts = by_type["string"] + by_type["boolean"]
    words = _counted_apart(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in texts)), texts) if texts else None
    return _as_frequencies(_value_groups(df, by_type["number"], _counted_apart), words)


def top_values(frequencies: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The most frequent values per attribute, ties by value; ``limits`` says how many.

    The rank filter has a literal limit, which Spark applies inside every task before the shuffle, so
    a column of all-distinct values never meets in one task.
    """
    order = Window.partitionBy("attribute").orderBy(F.col("count").desc(), F.col("value"))
    own_limit = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))[F.col("attribute")]
    ranked = frequencies.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= max(limits.values())) & (F.col("rank") <= own_limit))


# --- documents ---------------------------------------------------------------------------------


def _stats_struct(*deviations: str) -> Column:
    fields = [F.col("avg"), *(F.col(c) for c in deviations)]
    fields += [F.array().cast(BUCKET_TYPE).alias(name) for name in EMPTY_BREAKS]
    return F.struct(*fields, F.col("histogram"))


def _values_map(values: DataFrame) -> DataFrame:
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count"))))
    return values.groupBy("attribute").agg(entries.alias("values"))


def _numbered(names: Sequence[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(v) for i, (name, _) in enumerate(names) for v in (name, i)))


def _document(parts: list[DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    result = result.withColumn("key", F.col("attribute"))
    missing = {"min": "double", "max": "double", "values": "map<string,long>"}
    for name, kind in missing.items():
        if name not in result.columns:
            result = result.withColumn(name, F.lit(None).cast(kind))
    if "stats" not in result.columns:
        result = result.withColumn("stats", F.lit(None).cast("string"))
    position = _numbered(columns)[F.col("attribute")].alias("position")
    return result.select(position, *DOCUMENT_COLUMNS[1:])


def _by_type(columns: Sequence[tuple[str, str]]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {"number": [], "string": [], "boolean": [], "mixed": []}
    for name, kind in columns:
        found[kind].append(name)
    return found


def _constant_rows(df: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    rows = [(name, kind, 0, 0) for name in names]
    return df.sparkSession.createDataFrame(rows, "attribute string, type string, count long, countDistinct long")


def id_summary(df: DataFrame, count: Column) -> DataFrame:
    """Row of the ``id`` attribute: its distinct ids and the wanted count, no values."""
    return df.agg(count.alias("count"), F.count_distinct("id").alias("countDistinct")).select(
        F.lit("id").alias("attribute"), F.lit("string").alias("type"), "count", "countDistinct"
    )


def _text_profile(cells: DataFrame, columns: Sequence[tuple[str, str]], max_values: int | None) -> DataFrame:
    """Counts of text and boolean columns, and the values of those with few.

    The counts, one row per column of the schema, are computed first: they tell which columns are
    worth a second, cheap grouping.
    """
    spark = cells.sparkSession
    names = [name for name, _ in columns]
    counted = {r["attribute"]: r for r in value_summary(value_frequencies(cells, names)).collect()}
    rows = [
        (name, kind, counted[name]["count"], counted[name]["countDistinct"]) if name in counted else (name, kind, 0, 0)
        for name, kind in columns
    ]
    summary = spark.createDataFrame(rows, "attribute string, type string, count long, countDistinct long")
    short = [name for name, _, _, distinct in rows if 0 < distinct and (max_values is None or distinct <= max_values)]
    if not short:
        return summary.withColumn("values", _no_values())
    maps = _values_map(value_frequencies(cells, short))
    return summary.join(maps, "attribute", "left").withColumn("values", F.coalesce("values", _no_values()))


def _no_values() -> Column:
    return F.when(F.col("countDistinct") == 0, F.create_map().cast("map<string,long>"))


def profile(cells: DataFrame, versions: DataFrame, max_values: int | None = None) -> DataFrame:
    """Profile of every eligible column, one row each, with the table version.

    ``values`` holds the frequencies of all values of a text or boolean column, at every size.  For
    columns of very many values give ``max_values``: a column with more then has NULL there, and all
    its frequencies are in :func:`profile_values`.
    """
    version = max_version(versions)
    columns = eligible_columns(cells)
    kinds = _by_type(columns)
    parts = []
    if kinds["number"]:
        stats = _stats_struct("stddev_samp", "stddev_pop").alias("stats")
        numbers = numeric_summary(cells, kinds["number"])
        parts.append(
            numbers.select("attribute", F.lit("number").alias("type"), "count", "countDistinct", "min", "max", stats)
        )
    texts = [name for name in kinds["string"] if name != "id"]
    if "id" in kinds["string"]:
        parts.append(id_summary(cells, F.count_distinct("id")))
    named = [(c, "string") for c in texts] + [(c, "boolean") for c in kinds["boolean"]]
    if named:
        parts.append(_text_profile(cells, named, max_values))
    if kinds["mixed"]:
        parts.append(_constant_rows(cells, kinds["mixed"], "mixed"))
    return _document(parts, columns).withColumn("version", F.lit(version)).orderBy("position")


def profile_values(cells: DataFrame) -> DataFrame:
    """All value frequencies of the text and boolean attributes, whatever their number."""
    names = [name for name, kind in eligible_columns(cells, skip_id=True) if kind in ("string", "boolean")]
    return value_frequencies(cells, names)


def profile_value_chunks(cells: DataFrame, size: int = 10_000) -> DataFrame:
    """All value frequencies of the text and boolean attributes in rows of at most ``size`` values.

    Rows are ``(attribute, bucket, chunk, values)`` with a map as in :func:`profile`.  A value's bucket
    depends on its hash, with one bucket per ``size`` distinct values of its column; a bucket that got more is cut in
    value order into chunks.  So neither a row nor a task holds the values of a whole column, and
    the map form of :func:`profile` can be left to columns of few values.  A column without values has no row.  The driver gets
    one count per column.  ``size`` below 1 is an error.
    """
    if size < 1:
        raise ValueError(f"chunks need a size of at least 1, not {size}")
    names = [name for name, kind in eligible_columns(cells, skip_id=True) if kind in ("string", "boolean")]
    if not names:
        return cells.sparkSession.createDataFrame([], VALUE_CHUNKS)
    frequencies = value_frequencies(cells, names)
    distinct = {r["attribute"]: r["countDistinct"] for r in value_summary(frequencies).collect()}
    buckets = F.create_map(*(F.lit(v) for name in names for v in (name, -(-distinct.get(name, 1) // size))))
    bucket = F.pmod(F.xxhash64("value"), buckets[F.col("attribute")].cast("long"))
    place = F.row_number().over(Window.partitionBy("attribute", "bucket").orderBy("value"))
    rows = frequencies.withColumn("bucket", bucket).withColumn("chunk", F.floor((place - 1) / size).cast("long"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count"))))
    return rows.groupBy("attribute", "bucket", "chunk").agg(entries.alias("values"))


def profile_file(rows: DataFrame, listed: dict[str, int] = LISTED_VALUES) -> DataFrame:
    """Profile of a cell file (see ``sources.read_cells_csv``), with population deviation.

    Every attribute lists its most frequent values, as many as ``listed`` says for its type; ``all_frequencies`` has
    all of them.  A number of at most two rows gets no histogram.
    """
    columns = [(f.name, attribute_type(f.dataType)) for f in rows.schema]
    columns.sort(key=lambda c: c[0] != "id")
    attributes = [(name, kind) for name, kind in columns if name != "id" and kind != "mixed"]
    kinds = _by_type(attributes)
    parts = []
    if any(name == "id" for name, _ in columns):
        parts.append(id_summary(rows, F.count(F.lit(1))))
    if attributes:
        groups = _value_groups(rows, kinds["number"])
        texts = [(name, kind) for name, kind in attributes if kind != "number"]
        words = _text_groups(rows, [name for name, _ in texts])
        limits = {name: listed[kind] for name, kind in attributes}
        maps = _values_map(top_values(_as_frequencies(groups, words), limits))
        if kinds["number"]:
            some = F.when(F.col("count") > 2, F.col("histogram")).otherwise(F.array().cast(BUCKET_TYPE))
            numbers = (
                _summarised(_fixed_moments(rows, kinds["number"]), groups, BINS)
                .withColumn("histogram", some)
                .withColumn("stdev", F.col("stddev_pop"))
                .withColumn("stats", _stats_struct("stdev"))
            )
            parts.append(
                numbers.select(
                    "attribute", F.lit("number").alias("type"), "count", "countDistinct", "min", "max", "stats"
                )
            )
        if texts:
            named = rows.sparkSession.createDataFrame(texts, "attribute string, type string")
            zero = F.lit(0).cast("long")
            summary = named.join(F.broadcast(value_summary(words)), "attribute", "left")
            parts.append(
                summary.withColumn("count", F.coalesce("count", zero)).withColumn(
                    "countDistinct", F.coalesce("countDistinct", zero)
                )
            )
        listed = _document(parts, columns).drop("values").join(maps, "attribute", "left")
        return listed.select(*DOCUMENT_COLUMNS).orderBy("position")
    return _document(parts, columns).orderBy("position")
