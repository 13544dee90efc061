"""Exact copies of texts by two passes of Bloom filtering, with DataFrame functions only.

A pass counts, for every place of a Bloom filter, how many rows set it, and keeps the places that two rows or more set,
as bitmaps. A row whose place was set once has no copy. The second pass asks the rows that the first one left, with
another hash, so that hardly any row is left by chance; what both leave is shuffled by its whole hash and decided
exactly there. All other rows go straight through: they meet the bitmaps and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, small_side

#: Places of a filter for each row that it is built on: one row in BITS_PER_ROW is left by chance in a pass.
BITS_PER_ROW = 16
PASSES = 2
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def with_place(rows: DataFrame, number: int, bits: int) -> DataFrame:
    """rows with the place of __sha in the filter of this pass: the bitmap's __bucket and the __bit in it."""
    place = F.pmod(F.xxhash64("__sha", F.lit(number)), F.lit(bits).cast("long"))
    return rows.withColumn("__bucket", F.call_function("div", place, F.lit(BITMAP_BITS).cast("long"))).withColumn("__bit", F.pmod(place, F.lit(BITMAP_BITS).cast("long")).cast("int"))


def repeated_places(rows: DataFrame, number: int, bits: int) -> DataFrame:
    """bucket, bitmap: the places of the filter that at least two rows set.

    Places are counted map-side first, so a text with a third of all rows is one row per task; what moves is one counter
    per place and task, no hash and no row.
    """
    counted = with_place(rows, number, bits).groupBy("__bucket", "__bit").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return counted.groupBy(F.col("__bucket").alias("__of")).agg(F.call_function("bitmap_construct_agg", F.col("__bit").cast("long")).alias("__bitmap"))


def passed(rows: DataFrame, number: int, bits: int, filters: DataFrame) -> DataFrame:
    """rows with __again: whether the filter of this pass has their place. Beyond the broadcast bound the filter is met by a shuffle of rows."""
    placed = with_place(rows, number, bits)
    byte = F.expr("cast(conv(hex(substring(__bitmap, 1 + (__bit div 8), 1)), 16, 10) as long)")
    hit = F.when(F.col("__bitmap").isNull(), F.lit(False)).otherwise(F.call_function("getbit", byte, F.col("__bit") % 8) == 1)
    met = placed.join(small_side(filters, "4200"), placed["__bucket"] == filters["__of"], "left")
    return met.select(*rows.columns, hit.alias("__hit")).withColumn("__again", F.col("__again") & F.col("__hit")).drop("__hit")


def filtered(rows: DataFrame, bits_per_row: int = BITS_PER_ROW, passes: int = PASSES) -> DataFrame:
    """rows (checkpointed, with __sha) with __again: whether a row may have a copy. It is true for every row that has one."""
    flagged = rows.withColumn("__again", F.lit(True))
    for number in range(passes):
        asked = flagged.where("__again")
        bits = BITMAP_BITS * max(1, -(-asked.count() * bits_per_row // BITMAP_BITS))
        flagged = passed(flagged, number, bits, checkpointed(repeated_places(asked, number, bits)))
    return flagged


def hashed(docs: DataFrame, text: F.Column) -> DataFrame:
    """doc_id, __sha (the text's SHA-256) and __row, a number of the row that stays as it is from here on."""
    sha = F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    return checkpointed(docs.select("doc_id", sha.alias("__sha"), F.monotonically_increasing_id().alias("__row")))


def exact_groups(docs: DataFrame, text: F.Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, dropped ones too.

    Texts are equal when text (any expression over docs, default the column text; null: empty) is identical. Of equal
    texts the row with the largest doc_id stays; a null doc_id is less than any; of rows that repeat a doc_id with its
    text one stays. keep_id is null where only null ids have the text. Empty texts are equal like any others. Other
    columns are ignored. An empty table gives an empty result. Neither texts nor rows that are alone in their text are
    shuffled.
    """
    flagged = filtered(hashed(docs, F.col("text") if text is None else text))
    copies = flagged.where("__again")
    groups = copies.groupBy(F.col("__sha").alias("__of")).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "__row")).alias("__last")).where("group_size > 1")
    groups = small_side(checkpointed(groups), "80")
    joined = copies.join(groups, copies["__sha"] == groups["__of"], "left")
    again = joined.select(
        "doc_id",
        F.when(F.col("__last").isNull(), F.col("doc_id")).otherwise(F.col("__last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("__last.__row") == F.col("__row"), F.lit(True)).alias("kept"),
        "__sha",
    )
    alone = flagged.where("not __again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__sha")
    return alone.unionAll(again).withColumn("text_sha256", F.lower(F.hex("__sha"))).drop("__sha")


def without_copies(docs: DataFrame, text: F.Column | None = None) -> DataFrame:
    """The rows of docs whose text no row with a larger doc_id has, all columns as they are.

    Rows that may have a copy are grouped by the whole hash, with an aggregate that combines map-side; all others are
    read and passed on. Ties and nulls as in exact_groups; of rows equal in doc_id and text any one stays.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"), 256))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), sha.alias("__sha"))
    again = filtered(checkpointed(whole.select("__sha"))).where("__again").groupBy("__sha").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = small_side(checkpointed(again.select(F.col("__sha").alias("__of"))), "56")
    met = whole.join(again, whole["__sha"] == again["__of"], "left")
    last = met.where("__of is not null").groupBy("__of").agg(F.max_by("__doc", F.struct("__doc.doc_id")).alias("__doc"))
    return met.where("__of is null").select("__doc.*").unionAll(last.select("__doc.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
