"""How the word use of sources differs: an exact divergence of each pair of sources, by a frequent-pattern tree.

A kept term is a row of counts, one for each source of its language that has it. These rows, in one order of sources,
go into a tree whose nodes carry the number of terms below them, as in FP-growth. A pair's value is that of all terms
being absent from both, corrected for the terms that one of them has and for those that both have. The latter come
from the tree: a node and an ancestor stand for all terms that share the path, so their correction is worked out once
and taken as often as the node counts. Rows are sorted by path and cut into slices; a slice builds the tree of its
rows, and what slices find is added up, as is a path that two slices share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, small_side

#: ASCII letters and all characters beyond ASCII. In UTF-8 these are the letters' bytes and all bytes from 80 on.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counters that a task holds before it hands them on.
HELD_COUNTS = 400_000
#: Node and ancestor combinations worked out at a time.
COMBINATIONS = 1 << 18
#: Numbers in the paths of a tree, three for each step: a slice of more of them builds several trees.
TREE_NUMBERS = 2_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs: of parts of the table, still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in found.items():
                size = len(n)
                columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(n, pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(n_docs.__getitem__, n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
            found.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                n, n_docs = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                terms = text.translate(_TERM_BYTES).split()
                n.update(terms)
                n_docs.update(set(terms))
                held += len(n)
                if held > HELD_COUNTS:
                    yield from out()
                    held = 0
        yield from out()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def share(count: F.Column | str, total: F.Column | str) -> F.Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any long."""
    count, total = (F.col(c) if isinstance(c, str) else c for c in (count, total))
    return F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * (count + 1).cast("decimal(19,0)"), total.cast("decimal(20,0)")) + 1


def excess(p: F.Column | str, q: F.Column | str) -> F.Column:
    """floor((p - q)^2 / q)."""
    p, q = (F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)") for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def joint(pa_: np.ndarray, pb: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """What a term that both sources have adds to the value of (a, b) beyond what it adds for each of them alone.

    A square is below 2^62 for shares up to 2^31.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    return f(pa_, pb) - f(pa_, b0) - f(a0, pb) + f(a0, b0)


def tree_corrections(paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, value: corrections of ordered pairs of sources from sorted paths (sources, shares, shares of none).

    times: how many terms have each path. A node is the run of paths that are equal down to its depth.
    """
    lengths = np.array([len(p[0]) for p in paths])
    start = np.concatenate([[0], np.cumsum(lengths)])
    source, p, none = (np.concatenate([path[i] for path in paths]) for i in range(3))
    common = np.zeros(len(paths), np.int64)  # how much of its path a row shares with the row before
    for i in range(1, len(paths)):
        n = min(lengths[i - 1], lengths[i])
        differ = np.flatnonzero((paths[i - 1][0][:n] != paths[i][0][:n]) | (paths[i - 1][1][:n] != paths[i][1][:n]))
        common[i] = differ[0] if len(differ) else n
    names, source = np.unique(source, return_inverse=True)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(1, lengths.max()):
        reach = lengths > depth
        new = np.flatnonzero(reach & (common <= depth))  # the first rows of the nodes at this depth
        # a run ends where a row differs above or at the depth, which shorter rows between do as well
        weight = np.add.reduceat(np.where(reach, times, 0), new)
        for at in range(0, len(new), step := max(1, COMBINATIONS // depth)):
            first = new[at : at + step]
            up = (start[first][:, None] + np.arange(depth)).ravel()
            here = np.repeat(start[first] + depth, depth)
            m = np.repeat(weight[at : at + step], depth)
            pairs = [source[here] * len(names) + source[up], source[up] * len(names) + source[here]]
            values = [m * joint(p[here], p[up], none[here], none[up]), m * joint(p[up], p[here], none[up], none[here])]
            keys, place = np.unique(np.concatenate([keys, *pairs]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, np.concatenate([sums, *values]))
            sums = total
    return names[keys // len(names)], names[keys % len(names)], sums


def shared_terms(paths: DataFrame) -> DataFrame:
    """lang, a, b, value: joint corrections of source numbers, from paths (lang, path, times) in slices sorted by path."""

    def trees(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for lang, part in rows.groupby("lang", sort=False):
            steps = [np.asarray(x, np.int64).reshape(-1, 3).T for x in part["path"]]
            a, b, value = tree_corrections(steps, part["times"].to_numpy(np.int64))
            yield pd.DataFrame({"lang": lang, "a": a, "b": b, "value": value})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(b["path"].str.len().sum() for b in held) > TREE_NUMBERS:
                yield from trees(pd.concat(held))
                held = []
        if sum(map(len, held)):
            yield from trees(pd.concat(held))

    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return ordered.mapInPandas(run, "lang string, a long, b long, value long")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others, and by which terms.

    Part pair has each other source of the language with the value summed over all kept terms; part term has the terms
    that the source uses more than the language, the first top of them. Kept are terms of at least `least` documents of
    the language. Null text, lang and source are ''. Repeated rows are documents of their own; doc_id is not read and
    other columns are ignored. Ties go by item in UTF-8 order. A language with one source has no pairs, one without
    kept terms has pairs of value 0. An empty table gives an empty result.
    """
    lang_source = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    own = checkpointed(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
    kept = own.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least)
    kept = checkpointed(kept.select("lang", "term", "n_lang"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("in_lang"))
    counts = checkpointed(own.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    # one row per source, numbered so that sources of many terms come first in a path
    groups = docs.select(*lang_source).distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = checkpointed(groups.fillna(0, ["terms", "in_lang", "total", "used"])).repartitionByRange("lang", F.desc("used"), "source")
    groups = groups.sortWithinPartitions("lang", F.desc("used"), "source").withColumn("number", F.monotonically_increasing_id())
    sizes = F.col("total") + F.col("terms"), F.col("in_lang") + F.col("terms")
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), sizes[0]))
    groups = checkpointed(groups.select("lang", "source", "number", "terms", sizes[0].alias("size"), sizes[1].alias("lang_size"), none.alias("none")))
    bounded = small_side(groups, "64 + length(lang) + length(source)")

    placed = counts.join(bounded, ["lang", "source"]).select("lang", "source", "term", "number", share("n", "size").alias("p"), share("n_lang", "lang_size").alias("q"), "none")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    others = groups.select("lang", F.col("number").alias("to"), F.col("source").alias("item"), F.col("none").alias("to_none"))
    others = small_side(checkpointed(others), "48 + length(lang) + length(item)")
    pairs = bounded.join(others, "lang").where("number <> to")
    base = pairs.select("lang", F.col("number").alias("a"), F.col("to").alias("b"), F.when(F.col("terms") > 0, excess("none", "to_none") * F.col("terms")).otherwise(0).cast("decimal(38,0)").alias("value"))
    # the terms that one of the two has, by source and share
    levels = checkpointed(placed.groupBy("lang", "number", "p", "none").agg(F.count(F.lit(1)).alias("times")))
    one = levels.join(others, "lang").where("number <> to").select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.col("number").alias("a"), F.col("to").alias("b"), ((excess("p", "to_none") - excess("none", "to_none")) * F.col("times")).cast("decimal(38,0)").alias("value")),
                F.struct(F.col("to").alias("a"), F.col("number").alias("b"), ((excess("to_none", "p") - excess("to_none", "none")) * F.col("times")).cast("decimal(38,0)").alias("value")),
            )
        ).alias("x"),
    ).select("lang", "x.*")
    path = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "p", "none"))), lambda s: F.array(s["number"], s["p"], s["none"])))
    rows = placed.groupBy("lang", "term").agg(path.alias("path")).where("size(path) > 3").groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    both = shared_terms(checkpointed(rows)).withColumn("value", F.col("value").cast("decimal(38,0)"))
    summed = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    named = summed.join(bounded.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"]).join(others.select("lang", F.col("to").alias("b"), "item"), ["lang", "b"])
    named = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return named.unionByName(terms)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n_lang FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, k.n_lang, CAST(coalesce(o.n, 0) AS HUGEINT) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sizes AS (SELECT lang, source, sum(n) + count(*) AS size, sum(n_lang) + count(*) AS lang_size FROM cells GROUP BY lang, source),
shares AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000 * (n + 1) // size AS p, 1 + 1000000000 * (n_lang + 1) // lang_size AS q
  FROM cells c JOIN sizes s ON c.lang = s.lang AND c.source = s.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
