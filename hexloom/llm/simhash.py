"""Near-duplicates by SimHash fingerprints, linked by a binary trie self-join.

Fingerprints are cut into six blocks. With at most four differing bits, two blocks at least are equal, so the fifteen
choices of two blocks give keys under which every linked pair meets. Under one key the fingerprints form a binary
trie; pairs of its nodes are traversed together, bit by bit, with their differing bits added up, and a pair of nodes is
left as soon as its sum exceeds the budget. Copies are one fingerprint, and of a key's links only a spanning forest
leaves the task, so no group is ever expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, components, sorted_groups, with_key, worker_memory

BUDGET = 4
BLOCKS = 6
SHINGLE = 4
#: Node pairs that are expanded at once; more wait on a stack.
PAIRS_AT_ONCE = 500_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[part : part + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, sig: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row; a null text has fingerprint zero.

    sig: with the hash of the text in common.with_key as well.
    """
    own = ["doc_id", "sig"] if sig else ["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory("simhash")
        for batch in batches:
            codes = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield batch[own].assign(fp=codes.view(np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_key(docs, F.col("text").cast("binary").alias("text")).select(*own, "text")
    return rows.mapInPandas(run, f"doc_id {kind}, {'sig long, ' if sig else ''}fp long")


def block_keys(fp: str, blocks: int = BLOCKS, budget: int = BUDGET) -> F.Column:
    """Array of (combo, key): the bits of each choice of blocks - budget blocks of the fingerprint."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - budget):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[F.struct(F.lit(i).alias("combo"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])


def trie_forest(group: np.ndarray, codes: np.ndarray, ids: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the codes of each group which differ in at most budget bits, b the smallest id joined.

    group, codes and ids are sorted by (group, code). A trie node is a range of this order at a depth. A stack of
    blocks of node pairs bounds the memory; pairs of nodes that are wholly in one component already are skipped.
    """
    n = len(codes)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return high - (ones[depth][high] - ones[depth][low])

    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    low, high = edge[:-1], edge[1:]
    keep = high - low > 1
    low, high = low[keep], high[keep]
    stack = [(0, low, high, low, high, np.zeros(len(low), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, errors))), (depth, *(x[half:] for x in (a0, a1, b0, b1, errors)))]
            continue
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        joined = (label[a0] == label[b0]) & (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0])
        a0, a1, b0, b1, errors = (x[~joined] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        if depth == 64:
            label = merged(label, a0, b0)
            continue
        same, am, bm = a0 == b0, split(depth, a0, a1), split(depth, b0, b1)
        nexts = [
            (a0, am, b0, bm, errors),
            (am, a1, bm, b1, errors),
            (a0, am, bm, b1, errors + 1),
            *[tuple(x[~same] for x in (am, a1, b0, bm, errors + 1))],
        ]
        nexts = [np.concatenate(x) for x in zip(*nexts)]
        alive = (nexts[0] < nexts[1]) & (nexts[2] < nexts[3]) & (nexts[4] <= budget)
        stack.append((depth + 1, *(x[alive] for x in nexts)))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    linked = root != ids
    return ids[linked], root[linked]


def merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """label after the components of left and right were joined pairwise; the label of a component is its least one."""
    label = label.copy()
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def link(prints: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """fp, component_id: for each fingerprint the smallest doc_id reachable over fingerprints of at most budget bits."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    keyed = classes.where("first is not null").select("fp", "first", F.explode(block_keys("fp", blocks, budget)).alias("k"))
    keyed = keyed.select("k.combo", "k.key", "fp", "first").repartition("combo", "key").sortWithinPartitions("combo", "key", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sorted_groups(batches, ["combo", "key"]):
            group = frame.groupby(["combo", "key"], sort=False).ngroup().to_numpy()
            codes = frame["fp"].to_numpy(np.int64).view(np.uint64)
            order = np.lexsort((codes, group))
            a, b = trie_forest(group[order], codes[order], frame["first"].to_numpy(np.int64)[order], budget)
            yield pd.DataFrame({"a": a, "b": b})

    found = components(keyed.mapInPandas(run, "a long, b long"))
    return classes.join(found, classes["first"] == found["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))


def simhash_groups(docs: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text; other columns are not read).

    Words are lower-cased in A-Z; texts of fewer words than a shingle are one shingle; null and empty texts have
    fingerprint zero and link like any other. Repeated rows come out repeated. A row with a null doc_id belongs to
    the component of its fingerprint. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    return prints.join(link(prints, budget, blocks), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_firsts(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id, null last, then of the least hash of its text.

    Rows are told apart by (doc_id, sig), as in with_key; of rows equal in both one stays. Fingerprints are linked by
    themselves, so rows with a null doc_id are in groups like any other.
    """
    prints = checkpointed(fingerprints(docs, sig=True))
    groups = link(prints.select(F.col("fp").alias("doc_id"), "fp")).withColumnRenamed("component_id", "component")
    rows = prints.groupBy("doc_id", "sig", "fp").agg(F.count("*").alias("times")).join(groups, "fp")
    rows = checkpointed(rows.select("component", F.struct(F.isnull("doc_id").alias("last"), "doc_id", "sig").alias("row"), "times"))
    first = rows.groupBy(F.col("component").alias("of")).agg(F.min("row").alias("first"))
    marks = rows.join(first, F.col("component") == F.col("of")).where("row <> first or times > 1")
    marks = checkpointed(marks.select(F.col("row.doc_id").alias("__id"), F.col("row.sig").alias("__of"), F.expr("row = first").alias("__first")))
    keyed = docs.withColumn("__sig", F.coalesce(F.xxhash64("text"), F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sig") == F.col("__of"))
    kept = keyed.join(marks, same, "left_anti").select(*docs.columns)
    repeated = marks.where("__first")
    if repeated.isEmpty():
        return kept
    return kept.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__sig"]).select(*docs.columns))
