"""Removal of lines that are boilerplate of their site, with DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, small_side

RATIO = 0.1
#: Pages that must have a line, and standard errors by which its share must exceed the ratio.
LEAST_PAGES = 3
ERRORS = 2
_LINES = "split(coalesce(text, ''), '\n', -1)"


def exceeds(pages: F.Column, total: F.Column, ratio: float) -> F.Column:
    """Whether pages of total are more than ratio by ERRORS standard errors; whole numbers until the squares."""
    part, whole = Fraction(str(ratio)).as_integer_ratio()
    excess = (whole * pages - part * total).cast("double")
    return (pages >= LEAST_PAGES) & (excess > 0) & (excess * excess > float(ERRORS**2 * part * (whole - part)) * total)


def boilerplate(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """__host, __lines: for each host (source) the hashes of lines that stand on more than ratio of its pages.

    Copies of a text in one source are one page, for the lines and for the host's total. Each page counts once for a
    line and lines without a word count nowhere. The share must exceed the ratio by two standard errors, at every size
    of a host: of 3 pages all 3, of 9 pages 3, of 50 pages 10, of 500 pages 64 must have the line. Two pages are never
    enough, as an edited copy shares lines with its original. A host of P pages with L different lines per page on
    average has at most L / ratio such lines, so a row stays small however large the host is.

    Only hashes are grouped. A page without copies has a null page below, so that a frequent line is one row per task,
    and a group of copies adds one row per line and task.
    """
    keyed = docs.select("source", F.expr("coalesce(text, '')").alias("text")).select("source", "text", F.xxhash64("text").alias("page"), F.hash("text").alias("page_check"))
    texts = checkpointed(keyed.groupBy("source", "page", "page_check").agg(F.count("*").alias("copies")))
    totals = texts.groupBy(F.col("source").alias("__host")).agg(F.count("*").alias("total"))
    copied = small_side(checkpointed(texts.where("copies > 1").select(F.col("source").alias("of"), F.col("page").alias("p"), F.col("page_check").alias("c"))), "32 + coalesce(length(of), 0)")
    same = keyed["source"].eqNullSafe(copied["of"]) & (keyed["page"] == copied["p"]) & (keyed["page_check"] == copied["c"])
    pages = keyed.join(copied, same, "left").select("source", F.when(F.col("p").isNotNull(), F.struct("p", "c")).alias("copy"), F.expr(_LINES).alias("all_lines"))
    lines = pages.select("source", "copy", F.explode(F.array_distinct("all_lines")).alias("line")).where(r"line rlike '[^\\x20\\x09-\\x0D]'")
    line = (F.xxhash64("line").alias("line"), F.hash("line").alias("check"), F.length("line").alias("chars"))
    counts = lines.groupBy("source", *line).agg((F.count(F.when(F.col("copy").isNull(), 1)) + F.count_distinct("copy")).alias("pages"))
    counts = counts.where(F.col("pages") >= LEAST_PAGES)
    frequent = counts.join(totals, F.col("source").eqNullSafe(F.col("__host"))).where(exceeds(F.col("pages"), F.col("total"), ratio))
    return frequent.groupBy("__host").agg(F.collect_set("line").alias("__lines"))


def _cut(docs: DataFrame, ratio: float) -> DataFrame:
    """docs with __kept, __n_lines and __n_dropped; no column of docs is touched."""
    found = small_side(checkpointed(boilerplate(docs, ratio)), "16 + 8 * size(__lines)")
    joined = docs.join(found, docs["source"].eqNullSafe(found["__host"]), "left")
    lines = F.expr(_LINES)
    kept = F.filter(lines, lambda line: ~F.array_contains("__lines", F.xxhash64(line)))
    kept = F.when(F.col("__lines").isNull(), lines).otherwise(kept)
    joined = joined.select(*[docs[c] for c in docs.columns], F.size(lines).cast("long").alias("__n_lines"), kept.alias("__left"))
    return joined.select(
        *docs.columns, "__n_lines",
        (F.col("__n_lines") - F.size("__left")).alias("__n_dropped"),
        F.when(F.col("text").isNotNull(), F.array_join("__left", "\n")).alias("__kept"),
    )


def drop_site_lines(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """docs with kept (the text without its site's boilerplate lines), n_lines and n_dropped.

    A line is dropped if it has a word and boilerplate() finds it for the host. Null hosts are one host. A null text has
    one empty line and stays null. Repeated rows are copies: one page, each cut alike. An empty table gives an empty
    result. Other columns are carried along; columns of docs named kept, n_lines or n_dropped give way to the result's.
    """
    cut = _cut(docs, ratio)
    others = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    return cut.select(*others, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept"))


def without_site_lines(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """docs with boilerplate lines cut out of text; a document that had nothing else goes. n_chars follows the text.

    All other columns stay as they are, whatever their names.
    """
    cut = _cut(docs, ratio).where(r"__n_dropped = 0 or __kept rlike '[^\\x20\\x09-\\x0D]'")
    changed = F.col("__n_dropped") > 0
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return cut.select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH pages AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
texts AS (SELECT DISTINCT source, l FROM pages),
counts AS (SELECT source, line, count(*) AS pages
  FROM (SELECT source, unnest(list_distinct(l)) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM texts GROUP BY source),
bad AS (SELECT c.source, list(c.line) AS b FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages >= 3 AND 10 * c.pages > t.total AND (10 * c.pages - t.total) * (10 * c.pages - t.total) > 36 * t.total GROUP BY c.source),
kept AS (SELECT doc_id, l, list_filter(l, lambda x: b IS NULL OR NOT list_contains(b, x)) AS k
  FROM pages p LEFT JOIN bad ON p.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped,
  sha256(array_to_string(k, chr(10))) AS kept_sha256 FROM kept
"""
