"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key of concatenated random hashes (signs of random projections) and sorts the vectors
of a label by it; vectors that are close stand close in some pass. Each vector is compared with the WINDOW that follow
it, in double precision, and further on for as long as the last window still held a link, so that a dense cluster is
not cut off, over the ends of slices as well: rows whose windows are not over at the end of a slice go on in the next
one, in rounds of a join by slice number. Equal vectors are one, with a weight. The links of all passes are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, components, small_side

SIMILARITY = 0.98
PASSES = 14
BITS = 48
WINDOW = 64
#: Bytes of vectors that one sorted slice holds about.
SLICE_BYTES = 32 << 20
#: Kinds of rows that come out of a slice: a link, a vector's place in the order, a vector whose windows are not over.
LINK, PLACE, OPEN = range(3)


def valid(column: str) -> F.Column:
    """Whether a vector has a direction: not null, not zero, no null and no non-finite component."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def planes(dim: int, number: int, bits: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).standard_normal((dim, bits))


def unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def keyed(classes: DataFrame, passes: int, bits: int) -> DataFrame:
    """A row of every vector for each pass, with its key."""
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].str.len()):
                rows = unit(part["vec"])
                for number in range(passes):
                    keys = ((rows @ planes(dim, number, bits)) > 0) @ weights
                    yield pd.DataFrame({"pass": number, "label": part["label"], "dim": dim, "key": keys, "id": part["id"], "vec": part["vec"]})

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("id", "label", "vec").mapInPandas(run, f"pass int, label {kind}, dim int, key long, id long, vec array<double>")


def follow(
    left: np.ndarray, left_ids: np.ndarray, start: np.ndarray, end: np.ndarray, done: np.ndarray, hit: np.ndarray, rows: np.ndarray, ids: np.ndarray, similarity: float, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids that link: each left row against rows[start:end], in windows, until a whole window has no link.

    done and hit tell how much of its window a row has seen and whether there was a link; they come back as they stand
    at the end, after the pairs and the flags of the rows that came to their end with their windows not over.
    """
    done, hit, still = done.copy(), hit.copy(), np.zeros(len(left), bool)
    active, step = np.arange(len(left)), 0
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(active):
        inside = start[active] + step < end[active]
        still[active[~inside]] = True
        active = active[inside]
        at = start[active] + step
        linked = np.einsum("ij,ij->i", left[active], rows[at]) >= similarity
        found.append((left_ids[active[linked]], ids[at[linked]]))
        done[active] += 1
        hit[active] |= linked
        full, on = done[active] == window, hit[active]
        done[active[full & on]], hit[active[full & on]] = 0, False
        active = active[~full | on]
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b), still, done, hit


def runs(frame: pd.DataFrame) -> np.ndarray:
    """For each row of a sorted frame the end of its pass, label and dimension."""
    group = frame[["pass", "label", "dim"]]
    new = np.flatnonzero((group != group.shift()).any(axis=1).to_numpy())
    ends = np.append(new[1:], len(frame))
    return np.repeat(ends, ends - new)


def links(classes: DataFrame, similarity: float = SIMILARITY, passes: int = PASSES, bits: int = BITS, window: int = WINDOW) -> DataFrame:
    """a < b: the linked pairs of classes (id, label, vec), found in any pass."""
    size = classes.agg(F.expr("coalesce(sum(8L * size(vec)), 0L)")).first()[0]
    spark = classes.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * passes // SLICE_BYTES))
    order = ["pass", "label", "dim", "key", "id"]
    ordered = keyed(classes, passes, bits).repartitionByRange(slices, *order).sortWithinPartitions(*order)
    kind = classes.schema["label"].dataType.simpleString()
    columns = ["kind", "slice", "pos", "pass", "label", "dim", "a", "b", "done", "hit", "vec"]
    types = f"kind int, slice long, pos long, pass int, label {kind}, dim int, a long, b long, done int, hit boolean, vec array<double>"

    def shaped(frame: pd.DataFrame, kind: int) -> pd.DataFrame:
        return frame.assign(kind=kind, **{c: None for c in columns if c not in frame and c != "kind"})[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]  # a slice of about SLICE_BYTES
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        frame = frame.assign(slice=TaskContext.get().partitionId(), pos=np.arange(len(frame))).rename(columns={"id": "a"})
        pairs = []
        end = runs(frame)
        for dim in frame["dim"].unique():
            at = np.flatnonzero((frame["dim"] == dim).to_numpy())
            # sorted by dim inside (pass, label), so the rows of one dim form runs; ends become places among them
            place = np.searchsorted(at, end[at])
            rows, ids = unit(frame["vec"].iloc[at]), frame["a"].to_numpy(np.int64)[at]
            none = np.zeros(len(at), np.int64)
            a, b, still, done, hit = follow(rows, ids, np.arange(len(at)) + 1, place, none, none > 0, rows, ids, similarity, window)
            pairs.append(pd.DataFrame({"a": a, "b": b}))
            still &= end[at] == len(frame)  # the run may go on in the next slice
            yield shaped(frame.iloc[at[still]][["slice", "pass", "label", "dim", "a", "vec"]].assign(done=done[still], hit=hit[still]), OPEN)
        yield shaped(pd.concat(pairs).drop_duplicates(), LINK)
        yield shaped(frame[["slice", "pos", "pass", "label", "dim", "a"]], PLACE)

    found = checkpointed(ordered.mapInPandas(run, types))
    places = found.where(F.col("kind") == PLACE).select(F.col("slice").alias("target"), "pos", "pass", "label", "dim", F.col("a").alias("id"))
    sizes = sorted(tuple(r) for r in found.where(F.col("kind") == PLACE).groupBy("slice").count().collect())
    nexts = F.broadcast(spark.createDataFrame([(s, *after) for (s, _), after in zip(sizes, sizes[1:])], "slice long, target long, size long"))
    work = ["origin", "target", "size", "lo", "take"]
    state = ["pass", "label", "dim", "a", "done", "hit", "vec"]

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["pos"].isna()], frame[frame["pos"].notna()].sort_values("pos")
        # all left rows are of one pass, label and dim: the last of their slice
        same = (right[["pass", "label", "dim"]] == left[["pass", "label", "dim"]].iloc[0]).all(axis=1).to_numpy()
        end = len(same) if same.all() else int(same.argmin())
        if not end:
            return left.iloc[:0].assign(kind=LINK, b=None)[["kind", *work, *state, "b"]]
        n = len(left)
        a, b, still, done, hit = follow(
            unit(left["vec"]), left["a"].to_numpy(np.int64), np.zeros(n, np.int64), np.full(n, end), left["done"].to_numpy(np.int64), left["hit"].to_numpy(bool),
            unit(right["vec"].iloc[:end]), right["a"].to_numpy(np.int64), similarity, window,
        )
        still &= end == len(right)
        pairs = pd.DataFrame({"a": a, "b": b}).assign(kind=LINK, **{c: None for c in [*work, *state] if c != "a"})
        rest = left[still].assign(kind=OPEN, b=None, done=done[still], hit=hit[still])
        return pd.concat([x[["kind", *work, *state, "b"]].astype(object) for x in (pairs, rest)])

    out = [found.where(F.col("kind") == LINK).select("a", "b")]
    waiting = found.where(F.col("kind") == OPEN).join(nexts, "slice")
    waiting = waiting.select(F.col("slice").alias("origin"), "target", "size", F.lit(0).cast("long").alias("lo"), F.lit(window).cast("long").alias("take"), *state)
    while True:
        waiting = checkpointed(waiting)
        parts = checkpointed(waiting.select(*work).distinct())
        if parts.isEmpty():
            return out[0].distinct() if len(out) == 1 else reduce(DataFrame.union, out).distinct()
        chunk = places.join(small_side(parts, "40"), "target").where("pos >= lo and pos < lo + take").select(*work, "pos", "pass", "label", "dim", "id")
        chunk = classes.select("id", "vec").join(small_side(checkpointed(chunk), "80"), "id")
        chunk = chunk.select(*work, "pos", "pass", "label", "dim", F.col("id").alias("a"), F.lit(None).cast("int").alias("done"), F.lit(None).cast("boolean").alias("hit"), "vec")
        both = waiting.select(*work, F.lit(None).cast("long").alias("pos"), *state).union(chunk)
        step = both.groupBy(*work).applyInPandas(across, f"kind int, {' long, '.join(work)} long, pass int, label {kind}, dim int, a long, done int, hit boolean, vec array<double>, b long")
        step = checkpointed(step)
        out.append(step.where(F.col("kind") == LINK).select("a", "b"))
        rest = step.where(F.col("kind") == OPEN).drop("kind", "b")
        # twice as many rows of the same slice, or the first ones of the next
        inside = rest.where("lo + take < size").withColumn("lo", F.expr("lo + take")).withColumn("take", F.expr("2 * take"))
        beyond = rest.where("lo + take >= size").withColumn("slice", F.col("target")).drop("target", "size").join(nexts, "slice").withColumn("lo", F.lit(0).cast("long"))
        waiting = inside.select(*work, *state).union(beyond.select(*work, *state))


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, passes: int = PASSES, bits: int = BITS, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label; other columns are not read).

    Rows of one label, not null, and one dimension link at a cosine of similarity or more. Vectors that are null, zero
    or hold null or non-finite components, and rows with a null vec_id, link with nothing. Repeated rows count each as
    a vector of its own. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    usable = rows.where(valid("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = checkpointed(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    pairs = checkpointed(links(classes, similarity, passes, bits, window))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = classes.select(F.col("id").alias("b"), "weight")
    counts = both.join(weights, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("others"))
    groups = components(pairs).select(F.col("node").alias("id"), "component")
    known = classes.join(counts, "id", "left").join(groups, "id", "left")
    known = known.select("label", "vec", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = usable.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(valid("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
