"""Quality rules by host: failures of documents, shrunk by an empirical beta prior; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, small_side

MIN_WORDS = 50
#: A host whose shrunk rate of failing documents is over this is rejected.
MAX_RATE = 0.6
#: The hash of the window that begins at word i, which is w.
WINDOW_HASH = "xxhash64(w, words[i + 1], words[i + 2])"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each whole text.

    Repeated three-word windows are found without expanding the text into rows: the hash of each window, its low bits
    replaced by its place, makes one long, and in the sorted array of them repeats are neighbours. A text of n words
    leaves 64 - log2(n) bits to the hash, so neighbours may differ; the words of all that have an equal neighbour are
    then sorted and compared themselves, which makes the count exact for texts of any length.
    """
    words = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    words = words.withColumn("words", F.expr(rf"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    words = words.withColumn("n_words", F.size("words").cast("long"))
    words = words.withColumn("bits", F.expr("cast(ceil(log2(n_words + 1)) as int)"))
    lines = words.withColumn("lines", F.expr(rf"filter(split(text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    hashed = lines.withColumn("windows", F.expr("CASE WHEN n_words < 3 THEN array() ELSE array_sort(transform(slice(words, 1, size(words) - 2), (w, i) -> shiftleft({WINDOW_HASH}, bits) + i)) END".replace("array_sort(", "sort_array(").replace("{WINDOW_HASH}", WINDOW_HASH)).cast("array<long>"))
    return _counted(hashed)


def _counted(hashed: DataFrame) -> DataFrame:
    place = "(x - shiftleft(shiftright(x, bits), bits))"
    places = f"filter(windows, (x, j) -> (j > 0 AND shiftright(x, bits) = shiftright(windows[j - 1], bits)) OR (j < size(windows) - 1 AND shiftright(x, bits) = shiftright(windows[j + 1], bits)))"
    found = hashed.withColumn("likely", F.expr(f"transform({places}, x -> cast({place} as int))"))
    found = found.withColumn("same", F.expr("sort_array(transform(likely, x -> struct(concat_ws(' ', words[x], words[x + 1], words[x + 2]) AS window, x AS at)))"))
    equal = "(j > 0 AND x.window = same[j - 1].window) OR (j < size(same) - 1 AND x.window = same[j + 1].window)"
    found = found.withColumn("at", F.expr(f"sort_array(transform(filter(same, (x, j) -> {equal}), x -> x.at))"))
    covered = "CASE WHEN size(at) = 0 THEN 0L ELSE 3L + aggregate(sequence(1, size(at)), 0L, (sum, j) -> sum + CASE WHEN j < size(at) THEN least(3L, at[j] - at[j - 1]) ELSE 0L END) END"
    out = found.select(
        "doc_id",
        "source",
        "n_words",
        F.expr(r"cast(char_length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '')) as long)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, rejected: hosts whose rate of failures, shrunk by the prior that the rates of all hosts give, is over max_rate.

    The beta prior has the mean and variance of the hosts' rates (method of moments); without spread it weighs like one
    host of mean size. One row per host, partially aggregated: a host with a third of all rows is one row per task.
    """
    hosts = measured.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("total"), F.expr("count_if(base_failed)").alias("failed"))
    prior = hosts.agg(F.expr("avg(failed / total)").alias("mean"), F.expr("var_pop(failed / total)").alias("spread"), F.avg("total").alias("size"))
    weight = "CASE WHEN spread > 0 AND mean * (1 - mean) > spread THEN mean * (1 - mean) / spread - 1 ELSE size END"
    prior = prior.select(F.struct("mean", F.expr(weight).alias("weight")))
    shrunk = hosts.withColumn("prior", prior.scalar()).select("*", "prior.*")
    return shrunk.select("host", F.expr(f"(failed + mean * weight) / (total + weight) > {max_rate}").alias("rejected"))


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of each document and kept: false if it fails itself or its host (source) is rejected.

    Null texts have no words and fail; null hosts are one host. Repeated rows count each; an empty table gives an
    empty result. Other columns are not read.
    """
    measured = checkpointed(measures(docs))
    hosts = small_side(checkpointed(host_verdicts(measured, max_rate)), "32 + coalesce(octet_length(host), 0)")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr("NOT base_failed AND NOT coalesce(rejected, false)").alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT row, count(DISTINCT i + k) AS r FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY row),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE base_failed) AS failed FROM b GROUP BY source),
p AS (SELECT avg(failed / total) AS mean, var_pop(failed / total) AS spread, avg(total) AS size FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 AND mean * (1 - mean) > spread THEN mean * (1 - mean) / spread - 1 ELSE size END AS weight FROM p),
v AS (SELECT source, (failed + mean * weight) / (total + weight) > 0.6 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
