"""What several operators share: checkpoints, size-checked broadcasts and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20
#: Setting, Spark's default and the value used here.
SMALL_BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608"),
)
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_memory: dict[Hashable, Any] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters install it or use --py-files).

    Documents are long rows, so batches between Spark and Python get fewer of them and fewer bytes, unless the session
    says otherwise.
    """
    for name, default, here in SMALL_BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, here)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, *paths]))


def worker_memory(owner: Hashable, make: Callable[[], Any] = dict) -> Any:
    """What a Python worker remembers for an operator from one task to the next, made at its first task.

    Workers outlive stages, so the memory of any other operator is given back first: a worker never holds that of two.
    What many small objects leave free in between goes back to the system as well, where the C library can do that.
    """
    if owner not in _memory:
        _memory.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _memory[owner] = make()
    return _memory[owner]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master without that setting gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared checkpoint folder from now on."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table under the shared checkpoint folder and read from there from now on.

    Like checkpointed, but compressed, and what the write shuffled is removed when it is done, so that a chain of
    stored tables needs the local disk of its largest step instead of that of all steps.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, size: str) -> DataFrame:
    """df, a checkpointed one, with a broadcast hint if the sum of the SQL expression size is within BROADCAST_BYTES.

    Beyond that the join is left to Spark, which shuffles both sides and splits skewed partitions.
    """
    total = df.agg(F.expr(f"coalesce(sum({size}), 0)")).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def with_key(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the given columns and sig, the hash of the text.

    (doc_id, sig) tells rows apart where a doc_id is repeated with another text; rows equal in both are treated alike.
    """
    return docs.select("doc_id", *columns, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("sig"))


def words_joined(text) -> F.Column:
    """The words of a text joined by one space (null: empty)."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over edges (a, b: long), for each node with an edge.

    Rounds of large and small stars: every round joins the edges with the smallest neighbour of each node, so the
    work of a round is linear in the edges, a hot node is one aggregated row, and the number of rounds grows with the
    logarithm of the longest chain. Each round is checkpointed; the driver gets a count and a checksum.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = checkpointed(now), None
    while True:
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = checkpointed(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, of about the given number of rows, from batches that are sorted by keys."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
        if not last.all():
            yield frame[~last]
            frame = frame[last]
        held, count = [frame], len(frame)
    if held:
        yield pd.concat(held, ignore_index=True)
