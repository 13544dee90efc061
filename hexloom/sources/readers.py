"""Readers of cell files, id lists, coarse attribute tables, features and stored profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.functions import cellid
from hexloom.sources.writers import ATTRIBUTES_SCHEMA, VALUES_SCHEMA

ID_COLUMN = "GRID_ID"
COARSEST_STORED = 4


def narrow_schema(schema: T.StructType, id_column: str) -> T.StructType:
    """The four attribute types DOUBLE, BIGINT, BOOLEAN and VARCHAR; the id is always text.

    Left to inference, ids such as ``8e10`` would be read as numbers.
    """

    def narrowed(field: T.StructField) -> T.DataType:
        if field.name == id_column:
            return T.StringType()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return T.DoubleType()
        if isinstance(field.dataType, T.IntegralType):
            return T.LongType()
        if isinstance(field.dataType, T.BooleanType):
            return T.BooleanType()
        return T.StringType()

    return T.StructType([T.StructField(f.name, narrowed(f), True) for f in schema])


#: CSV as RFC 4180 has it: a quote inside quotes is doubled.
QUOTES = {"quote": '"', "escape": '"'}


#: What a CSV field of each type may look like besides empty; others are bad values.
_BOOLEANS = r"(?i)^\s*(true|false)\s*$"


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Lines of the files but for their headers (column ``_row``), and the header."""
    text = spark.read.text(path).where("length(trim(value)) > 0")
    header = text.select("value").first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    return text.where(F.col("value") != header["value"]).withColumnRenamed("value", "_row"), header["value"]


def _unless_empty(field):
    return F.when(field != "", field)


def csv_with_verdicts(spark: SparkSession, path: str, schema: T.StructType, id_column: str = ID_COLUMN) -> DataFrame:
    """Rows of a cell CSV with ``_problem`` (NULL: none) and ``_row``, the line as it stands in the file.

    Short rows are padded with NULL, which is no problem. A problem is a quote that is still open at the end of its line
    (a stray line break), a line of more fields than the header has, or a field that isn't of its column's type.
    The header names the columns, whatever their order in ``schema``; columns without a type are text.
    """
    lines, header = _lines(spark, path)
    names = spark.createDataFrame([(header,)], "h string").select(F.from_csv("h", F.schema_of_csv(F.lit(header)), {"sep": ","})).first()[0]
    names = [str(name) for name in names]
    types = {f.name: f.dataType for f in schema}
    if id_column not in names:
        raise ValueError(f"no column {id_column!r} in the header of {path}")
    fields = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("_more", T.StringType())])
    split = F.from_csv("_row", fields.simpleString()[7:-1].replace(":", " ").replace(",", ", "), QUOTES)
    # a line without quotes is cut at its commas, which is much cheaper; both are output of generators, so that a condition on
    # the verdict doesn't parse the line again for each field that it reads
    quoted = F.col("_row").contains('"')
    cut = F.struct(*(_unless_empty(F.get("plain", k)).alias(f.name) for k, f in enumerate(fields)))
    either = F.struct(F.when(quoted, split).alias("quoted"), F.when(~quoted, F.split("_row", ",")).alias("plain"))
    parsed = lines.select("_row", F.inline(F.array(either))).select("_row", F.inline(F.array(F.struct(F.coalesce("quoted", cut).alias("f")))))
    marks = F.length("_row") - F.length(F.replace("_row", F.lit('"'), F.lit("")))
    problems = [
        F.when(marks % 2 == 1, F.lit("an open quote")),
        F.when(F.col("f._more").isNotNull(), F.lit("more fields than the header")),
    ]
    columns = []
    for k, name in enumerate(names):
        field, kind = F.col(f"f.c{k}"), T.StringType() if name == id_column else types.get(name, T.StringType())
        value = field
        if not isinstance(kind, T.StringType):
            blank = F.when(F.trim(field) == "", None).otherwise(F.trim(field))
            value = blank.try_cast(kind)
            if isinstance(kind, T.BooleanType):
                value = F.when(field.rlike(_BOOLEANS), value)
            bad = blank.isNotNull() & value.isNull()
            problems.append(F.when(bad, F.concat(F.lit(f"no {kind.simpleString()} in column {name}: "), field)))
        columns.append(value.alias(f"v{k}"))
    judged = parsed.select("_row", F.inline(F.array(F.struct(*columns, F.coalesce(*problems).alias("_problem")))))
    return judged.select(*(F.col(f"v{k}").alias("id" if name == id_column else name) for k, name in enumerate(names)), "_problem", "_row")


def read_cells_csv(
    spark: SparkSession,
    path: str,
    id_column: str = ID_COLUMN,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Cell CSV with a header; ``id_column`` becomes ``id``, short rows are padded with NULL.

    Without a ``schema`` the types are inferred from the whole file, a pass of its own: give one for
    large inputs.  Quotes inside quoted fields are doubled, as RFC 4180 has it.  A value that isn't of its column's
    type, an open quote or a surplus field raises an error that shows the line; ``csv_with_verdicts`` keeps such rows
    and says what is wrong with them.  ``multi_line`` allows line breaks inside quotes; a file is then read by one task,
    without these checks.
    """
    if schema is None:
        inferred = spark.read.csv(path, header=True, inferSchema=True, multiLine=multi_line, **QUOTES).schema
        schema = narrow_schema(inferred, id_column)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line:
        rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", multiLine=True, **QUOTES)
        return rows.withColumnRenamed(id_column, "id")
    judged = csv_with_verdicts(spark, path, schema, id_column)
    problem = F.raise_error(F.concat(F.lit("bad CSV line ("), F.col("_problem"), F.lit("): "), F.col("_row")))
    return judged.where(F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(problem.cast("boolean"))).drop("_problem", "_row")


def with_hierarchy(rows: DataFrame) -> DataFrame:
    """``r11_id`` .. ``r4_id`` from the text ``id``, then all columns."""
    cell = cellid.string_to_cell(F.col("id"))
    finest = rows.withColumn("r11_id", cell)
    parents = [
        cellid.cell_to_parent(F.col("r11_id"), res).alias(f"r{res}_id")
        for res in range(cellid.FINEST - 1, COARSEST_STORED - 1, -1)
    ]
    return finest.select("r11_id", *parents, *(F.col(f"`{c}`") for c in rows.columns))


def build_cells(
    spark: SparkSession, path: str, id_column: str = ID_COLUMN, schema: T.StructType | str | None = None
) -> DataFrame:
    """The ``cells`` table of a cell CSV; store it with ``write_cells``."""
    return with_hierarchy(read_cells_csv(spark, path, id_column, schema))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed ids of a text file with one id per line."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("id")).where("id <> ''").distinct()


def read_id_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column of a headerless CSV, as text, one row per line."""
    return spark.read.csv(path, header=False, schema="id string", **QUOTES).where("id IS NOT NULL")


def coarse_position() -> list:
    """File, block and row order of the lines of a file scan, to tell the last of repeated ids."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ]


def read_coarse_csv(spark: SparkSession, path: str) -> DataFrame:
    """Coarse attributes: header CSV with ``id``, all text, plus ``_file, _block, _line`` to order by."""
    rows = spark.read.csv(path, header=True, **QUOTES)
    return rows.select("*", *coarse_position())


def read_features(spark: SparkSession, path: str, attribute: str = ID_COLUMN, format: str = "json") -> DataFrame:
    """The id attribute of a feature table.

    ``json`` takes plain JSON lines or GeoJSON features, one per line; ``parquet`` and ``csv`` take
    the column of that name.
    """
    if format == "json":
        columns = "`{0}` string, properties struct<`{0}`:string>".format(attribute)
        rows = spark.read.json(path, schema=columns)
        return rows.select(F.coalesce(f"properties.`{attribute}`", f"`{attribute}`").alias(attribute))
    options = {"header": True, **QUOTES} if format == "csv" else {}
    rows = spark.read.format(format).options(**options).load(path)
    return rows.select(F.col(f"`{attribute}`").cast("string").alias(attribute))


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attributes and value frequencies as ``write_profile`` stored them."""
    attributes = spark.read.json(f"{path}/attributes", schema=ATTRIBUTES_SCHEMA)
    return attributes.orderBy("position"), spark.read.json(f"{path}/values", schema=VALUES_SCHEMA)


def row_count(rows: DataFrame) -> DataFrame:
    """Number of data rows (a header line is not a row)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"))
