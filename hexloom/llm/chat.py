r"""Conversations as one text each, with the assistant's text under the loss mask; DataFrame functions only.

The template is <s> and, for each run of turns of one role, <|role|>, the texts of the run with <|turn|> between them,
and </s>. Control strings (<s>, </s>, [INST], [/INST], <| and, in a role, |>) inside texts and roles get a backslash after their
first character, and one more where there are some already, so that taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template's strings.
START, END, TURN = "<s>", "</s>", "<|turn|>"
_PLAIN = r"([<\[])(\\*)(?=/?s>|/?INST\]|\|)"
_ESCAPED = r"([<\[])\\(\\*)(?=/?s>|/?INST\]|\|)"


def escaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def escaped_role(role: F.Column) -> F.Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def unescaped_role(role: F.Column) -> F.Column:
    return unescaped(F.regexp_replace(role, r"\|\\(\\*)>", "|$1>"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in characters; byte_start, byte_length in UTF-8; all from 0) of turns (conv_id, turn, role, text).

    Rows are sorted by turn, then role and text; null turns come first; null texts and roles are empty. Adjacent turns
    of one role are one block. Repeated rows are turns of their own. A null conv_id is a conversation. An empty table
    gives an empty result; other columns are not read. A conversation is one row, so its turns meet in one task, where
    windows over its sorted turns (they spill) find the blocks and places; time grows with the turns. Turns are shuffled once.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("n"), F.lag("role").over(order).alias("before"))
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    # what stands before each text: the end of the block before and the head of the next, or the mark of a turn
    head = F.concat(F.when(F.col("n") == 1, F.lit(START)).otherwise(F.lit(END)), F.lit("<|"), escaped_role(F.col("role")), F.lit("|>"))
    rows = rows.select(
        "conv_id", "n", opens.cast("int").alias("opens"), F.when(opens, head).otherwise(F.lit(TURN)).alias("head"),
        escaped(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"),
    )
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.sum("opens").over(so_far).alias("block"),
        F.sum(F.length("head") + F.length("text")).over(so_far).alias("end"),
        F.sum(F.octet_length("head") + F.octet_length("text")).over(so_far).alias("byte_end"),
    )
    span = F.struct(
        (F.col("end") - F.length("text")).cast("int").alias("start"), F.length("text").alias("length"),
        (F.col("byte_end") - F.octet_length("text")).cast("int").alias("byte_start"), F.octet_length("text").alias("byte_length"),
    )
    turn = F.struct("n", F.concat("head", "text").alias("part"), F.when(F.col("loss"), span).alias("span"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join("turns.part", "").alias("part"), F.array_compact("turns.span").alias("spans")).alias("block"))
    chats = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    return chats.select("conv_id", F.concat(F.array_join("blocks.part", ""), F.lit(END)).alias("formatted"), F.flatten("blocks.spans").alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars, read from formatted and loss_spans alone.

    Spans are read by their bytes, as finding a character means reading all text before it.
    """
    blocks = F.split(F.expr(f"substring(formatted, {len(START) + 1})"), END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    split = F.transform(
        blocks,
        lambda b: F.struct(
            unescaped_role(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
            F.split(F.regexp_extract(b, r"(?s)^<\|.*?\|>(.*)$", 1), r"<\|turn\|>", -1).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(split, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    # the text as bytes is an element of an array, so that it is converted once for all spans
    whole = F.array(F.col("formatted").cast("binary"))
    masked = F.transform(whole, lambda w: F.transform("loss_spans", lambda s: unescaped(F.substring(w, s["byte_start"] + 1, s["byte_length"]).cast("string"))))
    loss = F.array_join(F.flatten(masked), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_case(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose two texts are full of control strings."""
    extra = spark.sql("SELECT -1L AS conv_id, n AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(n, role)")
    return turns.select("conv_id", "turn", "role", "text").union(extra)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|\|)')) AS e,
  row_number() OVER o AS n, lag(role) OVER o AS before FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN before = role THEN 8 ELSE CASE WHEN n = 1 THEN 3 ELSE 4 END + 4 + length(role) END + e AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 4 AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
