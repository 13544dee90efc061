"""Hard negatives by angular triangle filtering.

Every vector is stored with its angles to a few reference directions. Angles obey the triangle inequality, so the
angles of an anchor and of a vector to a reference bound the angle between the two from both sides, and with their
norms that bounds their score. Vectors are sorted by their nearest reference and the angle to it and kept in blocks;
a window is a short run of a block with the least and the largest angle to each reference. Only the windows whose score
bounds overlap what an anchor still looks for are scored, in integers. All anchors meet all blocks, anchors in blocks
too; what a task finds is cut to the first few of each anchor before it leaves the task, and once more after a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import BROADCAST_BYTES, checkpointed

SCALE = 256
ANCHORS_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Directions are chosen among so many vectors, the first by a hash of their id. They decide on speed, not on results.
SAMPLE = 2_000
REFERENCES = 16
BLOCK_BYTES = 512 << 10
WINDOW = 64
#: Angles from a rounded arc cosine are off by less than this.
ANGLE_SLACK = 1e-7
#: Up to here products of integers are exact in double precision, whatever the order of the sum.
EXACT = 2.0**53
#: Vectors of smaller norm have products that fit a long.
LARGEST_NORM = 2.0**31
#: Rows that a task keeps for its anchors before it cuts them to the first of each.
KEPT_ROWS = 500_000


def integers(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """floor(SCALE * x) of each component, as whole numbers in double precision."""
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim))


def members(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part, once each: nothing null, all components finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))


def references(rows: DataFrame, sample: int = SAMPLE, number: int = REFERENCES) -> dict[int, np.ndarray]:
    """For each number of components, unit directions far from each other among those of a bounded sample."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "embedding").toPandas()
    found = {}
    for dim, part in some.groupby("dim"):
        units = directions(np.floor(SCALE * np.stack(part["embedding"]).reshape(len(part), dim)))[0]
        chosen, nearest = [0], np.full(len(units), -2.0)
        while len(chosen) < min(number, len(units)):
            nearest = np.maximum(nearest, units @ units[chosen[-1]])
            chosen.append(int(nearest.argmin()))
        found[int(dim)] = units[chosen]
    return found


def directions(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero: zero) and norms."""
    most = np.abs(whole).max(axis=1, initial=1, keepdims=True)  # against overflow of the squares
    part = whole / most
    norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
    return part / np.where(norm == 0, 1, norm), (norm * most)[:, 0]


def with_angles(rows: DataFrame, towards: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, dim, whole (components), norm, angles, and to sort by: cell (the nearest reference) and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                whole = integers(part.column("embedding"), dim)
                units, norms = directions(whole)
                to = towards.get(int(dim), np.eye(1, dim))
                angles = np.arccos(np.clip(units @ to.T, -1, 1))
                cell = angles.argmin(axis=1)
                lists = [pa.array(list(x.astype("<f8", copy=False)), pa.list_(pa.float64())) for x in (whole, angles)]
                least = pa.array(angles[np.arange(len(cell)), cell])
                columns = [part.column("vec_id"), part.column("label"), part.column("dim"), lists[0], pa.array(norms), lists[1], pa.array(cell, pa.int32()), least]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "whole", "norm", "angles", "cell", "angle"])

    return rows.mapInArrow(run, "vec_id long, label long, dim int, whole array<double>, norm double, angles array<double>, cell int, angle double")


def blocks(rows: DataFrame) -> DataFrame:
    """block, dim, ids, labels, wholes, norms, angles: rows sorted by cell and angle, packed as bytes, and bytes in all."""

    def pack(part: pa.RecordBatch, block: int) -> dict:
        flat = lambda c, t: np.ascontiguousarray(c.to_numpy(zero_copy_only=False), t).tobytes()
        return {
            "block": block, "dim": part.column("dim")[0].as_py(), "ids": flat(part.column("vec_id"), "<i8"), "labels": flat(part.column("label"), "<i8"),
            "wholes": flat(part.column("whole").flatten(), "<f8"), "norms": flat(part.column("norm"), "<f8"), "angles": flat(part.column("angles").flatten(), "<f8"),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in whole_batches(batches):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                size = max(1, BLOCK_BYTES // (8 * (int(dim) + 4)))
                packed = [pack(part.slice(at, size), number + k) for k, at in enumerate(range(0, part.num_rows, size))]
                number += len(packed)
                yield pa.RecordBatch.from_pylist(packed, BLOCK_ARROW)

    order = ["dim", "cell", "angle", "vec_id"]
    size = rows.agg(F.expr("coalesce(sum(8L * dim + 32), 0L)")).first()[0]
    ranged = rows.repartitionByRange(*order)
    if (least := -(-size // BLOCK_BYTES)) < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranged = ranged.coalesce(max(1, least))  # no blocks that are smaller than they need be
    return ranged.sortWithinPartitions(*order).mapInArrow(run, BLOCK)


BLOCK = "block long, dim int, ids binary, labels binary, wholes binary, norms binary, angles binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "wholes", "norms", "angles")]])


def whole_batches(batches: Iterator[pa.RecordBatch], size: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about the given bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Block:
    """A block's rows and the bounds of its windows."""

    def __init__(self, row: dict) -> None:
        numbers = {c: np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("labels", "<i8"), ("wholes", "<f8"), ("norms", "<f8"), ("angles", "<f8"))}
        self.ids, self.labels, self.norms = numbers["ids"], numbers["labels"], numbers["norms"]
        n = len(self.ids)
        self.whole, self.angles = numbers["wholes"].reshape(n, row["dim"]), numbers["angles"].reshape(n, -1)
        self.starts = np.arange(0, n, WINDOW)
        edge = lambda f, x: f.reduceat(x, self.starts, axis=0)
        self.low, self.high = edge(np.minimum, self.angles) - ANGLE_SLACK, edge(np.maximum, self.angles) + ANGLE_SLACK
        self.least, self.most = edge(np.minimum, self.norms), edge(np.maximum, self.norms)

    def bounds(self, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each anchor can have with a vector of each window."""
        near, far = np.zeros((len(angles), len(self.starts))), np.full((len(angles), len(self.starts)), np.pi)
        for r in range(angles.shape[1]):
            own, low, high = angles[:, r, None], self.low[:, r], self.high[:, r]
            near = np.maximum(near, np.maximum(low - own, own - high) - ANGLE_SLACK)
            far = np.minimum(far, np.minimum(own + high, 2 * np.pi - own - low) + ANGLE_SLACK)
        top, bottom = np.cos(np.maximum(near, 0)), np.cos(np.minimum(far, np.pi))
        most, least = norms[:, None] * self.most, norms[:, None] * self.least
        slack = 1 + most * 1e-9  # of the cosine, the products and the norms
        return np.minimum(bottom * most, bottom * least) - slack, np.maximum(top * most, top * least) + slack

    def scores(self, window: int, whole: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Exact integer products of anchors with the vectors of a window."""
        rows = slice(self.starts[window], self.starts[window] + WINDOW)
        if norms.max() * self.most[window] < EXACT:
            return (whole @ self.whole[rows].T).astype(np.int64)
        exact = np.vectorize(int, otypes=[object])
        return (exact(whole) @ exact(self.whole[rows]).T).astype(np.int64)


class First:
    """The first few (score descending, id ascending) of each key, among all that were added."""

    def __init__(self, few: int) -> None:
        self.few, self.rows, self.count = few, [], 0
        self.floors: dict[int, np.ndarray] = {}  # by group of keys: the score that a key's next row must reach

    def add(self, group: int, keys: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(keys):
            self.rows.append((np.full(len(keys), group), keys, score, ids))
            self.count += len(keys)

    def floor(self, group: int, size: int) -> np.ndarray:
        return self.floors.setdefault(group, np.full(size, np.iinfo(np.int64).min))

    def cut(self) -> tuple[np.ndarray, ...]:
        """What is left of each key; floors rise to the last of those that have their few."""
        if not self.rows:
            return (np.zeros(0, np.int64),) * 4
        group, key, score, ids = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((ids, -score, key, group))
        group, key, score, ids = group[order], key[order], score[order], ids[order]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        last = place == self.few - 1
        for g in np.unique(group[last]):
            here = last & (group == g)
            self.floors[g][key[here]] = score[here]
        keep = place < self.few
        self.rows, self.count = [(group[keep], key[keep], score[keep], ids[keep])], int(keep.sum())
        return self.rows[0]


Search = Callable[[First, "Block", dict], None]


def searched(vectors: DataFrame, anchors: DataFrame, few: int, search: Search) -> DataFrame:
    """anchor_block, key, score, id: the first few of each key that search adds, for all pairs of blocks."""
    anchors = checkpointed(anchors.select(F.col("block").alias("anchor_block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"]))
    size = anchors.agg(F.expr("coalesce(sum(octet_length(a_ids) * 4 + octet_length(a_wholes) + octet_length(a_angles)), 0L)")).first()[0]
    if size <= BROADCAST_BYTES:
        met = vectors.join(F.broadcast(anchors), vectors["dim"] == anchors["a_dim"])
    else:  # a grid of anchor groups and slices of the vectors, each a task's work
        groups = -(-size // BROADCAST_BYTES)
        slices = -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
        left = vectors.select("*", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        right = anchors.select("*", F.pmod(F.xxhash64("anchor_block"), F.lit(groups)).alias("a_group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("a_slice"))
        met = left.join(right, (left["dim"] == right["a_dim"]) & (left["slice"] == right["a_slice"]) & (left["group"] == right["a_group"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        first, seen = First(few), (None, None)

        def out() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("anchor_block", "key", "score", "id"), first.cut())))

        for batch in batches:
            for row in batch.to_pylist():
                if seen[0] != row["block"]:
                    seen = row["block"], Block(row)
                held = first.count
                search(first, seen[1], row)
                if first.count > max(KEPT_ROWS, 2 * held):
                    first.cut()
                    if first.count > KEPT_ROWS:  # a task of very many anchors hands on what it has
                        yield out()
                        first = First(few)
        yield out()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame.astype("int64"), preserve_index=False)

    found = met.mapInArrow(arrow, "anchor_block long, key long, score long, id long")
    order = Window.partitionBy("anchor_block", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= few)


def anchor_arrays(row: dict) -> tuple[np.ndarray, ...]:
    n = len(row["a_ids"]) // 8
    arrays = (np.frombuffer(row[f"a_{c}"], t).reshape(n, -1) for c, t in (("ids", "<i8"), ("labels", "<i8"), ("wholes", "<f8"), ("norms", "<f8"), ("angles", "<f8")))
    ids, labels, whole, norms, angles = arrays
    return ids[:, 0], labels[:, 0], whole, norms[:, 0], angles


def find_positives(first: First, block: Block, row: dict) -> None:
    """Adds vectors of the anchors' own labels, by anchor."""
    ids, labels, whole, norms, angles = anchor_arrays(row)
    floor = first.floor(row["anchor_block"], len(ids))
    upper = block.bounds(angles, norms)[1]
    for w in np.argsort(-upper.max(axis=0), kind="stable"):
        rows = slice(block.starts[w], block.starts[w] + WINDOW)
        own = np.flatnonzero((upper[:, w] >= floor) & np.isin(labels, block.labels[rows]))
        if not len(own):
            continue
        score = block.scores(w, whole[own], norms[own])
        wanted = (block.labels[rows] == labels[own, None]) & (block.ids[rows] != ids[own, None]) & (score >= floor[own, None])
        i, j = np.nonzero(wanted)
        first.add(row["anchor_block"], own[i], score[i, j], block.ids[rows][j])
        if first.count > 20 * len(ids) * first.few:
            first.cut()


def find_negatives(first: First, block: Block, row: dict) -> None:
    """Adds vectors of other labels between the bounds of each positive, by anchor and positive."""
    ids, labels, whole, norms, angles = anchor_arrays(row)
    slots = np.frombuffer(row["a_slots"], "<i8")  # anchors of the positives, in the order of keys
    goal = np.frombuffer(row["a_goals"], "<i8").astype(object)
    low, high = (np.array(x, np.int64) for x in (-(-goal * LOW // 100), goal * HIGH // 100))  # empty for negative scores
    floor = first.floor(row["anchor_block"], len(slots))
    lower, upper = block.bounds(angles, norms)
    for w in range(len(block.starts)):
        key = np.flatnonzero((low <= high) & (upper[slots, w] >= np.maximum(low, floor)) & (lower[slots, w] <= high))
        if not len(key):
            continue
        rows = slice(block.starts[w], block.starts[w] + WINDOW)
        own, place = np.unique(slots[key], return_inverse=True)
        score = block.scores(w, whole[own], norms[own])[place]
        wanted = (block.labels[rows] != labels[slots[key], None]) & (block.ids[rows] != ids[slots[key], None])
        wanted &= (score >= np.maximum(low, floor)[key, None]) & (score <= high[key, None])
        i, j = np.nonzero(wanted)
        first.add(row["anchor_block"], key[i], score[i, j], block.ids[rows][j])
        if first.count > 20 * len(slots) * first.few:
            first.cut()


def with_goals(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """Anchor blocks with slots and goals: the anchor and the score of each of their positives, by key."""
    grouped = positives.groupBy("anchor_block").agg(F.array_sort(F.collect_list(F.struct("goal_key", "key", "score"))).alias("goals"))
    wide = anchors.join(grouped, anchors["block"] == grouped["anchor_block"]).drop("anchor_block")
    columns = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goals = batch.column("goals").to_pylist()
            packed = [pa.array([np.array([g[c] for g in x], "<i8").tobytes() for x in goals], pa.binary()) for c in ("key", "score")]
            rest = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, *packed], [*columns, "slots", "goals"])

    return wide.mapInArrow(run, BLOCK + ", slots binary, goals binary")


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Scores are integer inner products of floor(256 x). Anchors are rows with a vec_id divisible by 50, their positives
    the first 5 other vectors of their label, the negatives of a pair the first 3 vectors of another label that score
    from 50 to 95 hundredths of the positive; first are higher scores, then smaller vec_ids. Rows with a null vec_id,
    label, vector or component, a component that is not finite or a norm of 2^31 (scaled) or more take no part. Where vec_id is divisible by 7 the label
    is (label + 1) % 10. Vectors meet those of as many components only; empty and zero vectors score 0. Rows that repeat
    vec_id, label and vector are one; a vec_id that is repeated with another vector is a row of its own, but no partner
    of its like. A pair without negatives has no row. Other columns are ignored. An empty table gives an empty result.
    """
    taking_part = checkpointed(members(rows).dropDuplicates(["vec_id", "label", "embedding"]))
    angled = checkpointed(with_angles(taking_part, references(taking_part)).where(F.col("norm") < LARGEST_NORM))
    vectors = checkpointed(blocks(angled))
    anchors = checkpointed(blocks(angled.where(F.col("vec_id") % ANCHORS_EVERY == 0)))
    positives = searched(vectors, anchors, POSITIVES, find_positives)
    in_block = F.row_number().over(Window.partitionBy("anchor_block").orderBy("key", "place")).cast("long") - 1
    positives = checkpointed(positives.withColumn("goal_key", in_block))
    negatives = searched(vectors, with_goals(anchors, positives), NEGATIVES, find_negatives)
    anchor_ids = anchors.select(F.col("block").alias("anchor_block"), "ids")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), len(ids)), pa.array(np.arange(len(ids))), pa.array(ids)], ["anchor_block", "key", "anchor_id"])

    names = anchor_ids.mapInArrow(named, "anchor_block long, key long, anchor_id long")
    pairs = positives.join(names, ["anchor_block", "key"]).select("anchor_block", F.col("goal_key").alias("key"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.join(pairs, ["anchor_block", "key"])
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM ranked WHERE rank <= 3
"""
