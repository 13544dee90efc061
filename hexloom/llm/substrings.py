"""Removal of passages that an earlier document holds too: seeds, extension both ways, maximal repeats.

Seeds are winnowed anchors: of the SEED-word grams of each window of `window` words the one of the least hash, so that
two documents that share a window share its anchor, at the same place in it. The neighbouring windows with one anchor
occurrence are its segment: the anchor, extended to the left and to the right as far as it stays the seed.

Documents are joined on their anchors without forming pairs. Segments of one anchor that are equal over their whole
extension are one class, led by the smallest doc_id; all others of the class are repeats of it. Only leaders whose
anchor has several classes are extended window by window and compared, again by the smallest doc_id of each window.
Repeats that touch or overlap are joined into maximal spans. A passage that a third of all documents share is thus one
class with a partially aggregated minimum, never a list of its occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import stored, with_key, worker_memory

WINDOW = 50
SEED = 17
#: Words whose hashes a task keeps at most, and words that are hashed at once.
KNOWN_WORDS = 200_000
WORDS_AT_ONCE = 250_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = (1 << 24) - 1


class WordHashes(dict):
    """Hash of each word, found once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Memory:
    """What a worker keeps between tasks."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def memory() -> Memory:
    return worker_memory("substrings", Memory)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    known = memory().powers
    if base not in known or len(known[base][0]) < n:
        size = max(n, WORDS_AT_ONCE + 50_000)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        known[base] = tuple(pair)
    return known[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of the word ranges of a row of words."""

    def __init__(self, hashes: np.ndarray, base: int):
        power, self.inverse = powers(base, len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memory().hashes.__getitem__, words), np.uint64, len(words))


def document_chunks(batches: Iterator[pd.DataFrame], least: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with at least so many words and their words' hashes, about WORDS_AT_ONCE words at a time."""
    for batch in batches:
        rows, held, count = [], [], 0
        for i, text in enumerate(batch["text"]):
            words = text.split() if text else []
            if len(words) < least:
                continue
            rows.append(i)
            held.append(hashed(words))
            count += len(words)
            if count >= WORDS_AT_ONCE:
                yield batch.iloc[rows], held
                rows, held, count = [], [], 0
        if rows:
            yield batch.iloc[rows], held


def segments_of(lengths: np.ndarray, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """document number, first window (word offset in the document), windows, anchor, hash of each segment."""
    grams = Grams(hashes, _BASES[0])
    n = len(hashes)
    if n > _LOW:  # one very long text: its own range, positions beyond 24 bits
        shift = np.uint64(n.bit_length())
    else:
        shift = np.uint64(24)
    at = np.arange(n - seed + 1)
    seeds = grams.of(at, seed)
    best = (seeds >> shift << shift) | at.astype(np.uint64)
    span, reach = window - seed + 1, 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if span > reach:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(lengths - window + 1)[:-1]]), lengths - window + 1) + first[doc]
    anchor = (best[start] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([new, [len(doc)]]))
    begin = start[new]
    whole = mixed(grams.of(begin, count + window - 1) ^ mixed(count.astype(np.uint64)))
    return doc[new], begin - first[doc[new]], count, seeds[anchor[new]], whole


def segments(keyed: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, sig, start, n, anchor, seg of every segment of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, hashes in document_chunks(batches, window):
            lengths = np.array([len(h) for h in hashes])
            doc, start, count, anchor, whole = segments_of(lengths, np.concatenate(hashes), window, seed)
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[doc], "sig": rows["sig"].to_numpy()[doc], "start": start.astype(np.int32), "n": count.astype(np.int32), "anchor": anchor.view(np.int64), "seg": whole.view(np.int64)})

    return keyed.mapInPandas(run, "doc_id long, sig long, start int, n int, anchor long, seg long")


def open_windows(opened: DataFrame, window: int) -> DataFrame:
    """doc_id, sig, start and two hashes of every window of the given segments (column segs: start, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, sig, text, segs in zip(batch["doc_id"], batch["sig"], batch["text"], batch["segs"]):
                hashes = hashed(text.split())
                start = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in segs])
                one, two = (Grams(hashes, b).of(start, window).view(np.int64) for b in _BASES)
                yield pd.DataFrame({"doc_id": doc_id, "sig": sig, "start": start.astype(np.int32), "w1": one, "w2": two})

    return opened.mapInPandas(run, "doc_id long, sig long, start int, w1 long, w2 long")


def covered(n_words: int, spans, window: int) -> np.ndarray:
    """Which of the words lie in one of the spans (first window, windows)."""
    steps = np.zeros(n_words + 1, np.int64)
    for s in spans:
        steps[s["start"]] += 1
        steps[s["start"] + s["n"] - 1 + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def cut_out(text: bytes, removed: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the removed words and the space inside each removed span; the spans as word ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    parts, at = [], 0
    for a, b in edges:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*parts, text[at:]]), [tuple(x) for x in edges]


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, sig, text, n_words, n_removed, spans for every row of docs (doc_id, text; other columns are not read).

    A word is removed if it lies in a window of `window` words that also starts in a document of a smaller doc_id;
    windows are judged on the whole input. text keeps the space around removed spans; spans are the removed maximal
    repeats as word ranges (first, end). A null text counts as empty and comes out empty. A null doc_id is neither
    smaller nor larger than any other: its row is left whole and removes nothing. Rows that repeat a doc_id count as
    one document. An empty table gives an empty result.
    """
    whole = with_key(docs, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    usable = whole.where(f"doc_id is not null and octet_length(text) >= {2 * window - 1}")
    found = stored(segments(usable, window, seed))
    # anchors of one document alone go first: they are most
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    # joins read stored tables on both sides, so that Spark can split the partition of a frequent anchor
    found = stored(found.join(stored(anchors), "anchor"))
    classes = stored(found.groupBy("anchor", "seg").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor", F.lit(True).alias("open"))
    shared = stored(classes.join(several, "anchor", "left").where("open or first < last"))
    hits = found.join(shared, ["anchor", "seg"]).where("first < doc_id or open").select("doc_id", "sig", "start", "n", (F.col("first") < F.col("doc_id")).alias("closed"))
    hits = stored(hits)
    opened = hits.where("not closed").groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "n")).alias("segs"))
    windows = stored(open_windows(whole.join(opened, ["doc_id", "sig"]), window))
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = stored(firsts)
    late = windows.join(firsts, ["w1", "w2"]).where("first < doc_id").select("doc_id", "sig", "start", F.lit(1).alias("n"))
    spans = hits.where("closed").select("doc_id", "sig", "start", "n").union(late).groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"]):
                n = len(text.split())
                if spans is None:
                    out.append((text, n, 0, []))
                    continue
                removed = covered(n, spans, window)
                out.append((cut := cut_out(text, removed))[:1] + (n, int(removed.sum()), [{"first": a, "end": b} for a, b in cut[1]]))
            text, n, gone, cuts = map(list, zip(*out)) if out else ([], [], [], [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sig": batch["sig"], "text": text, "n_words": n, "n_removed": gone, "spans": cuts})

    kept = whole.join(spans, ["doc_id", "sig"], "left").mapInPandas(run, "doc_id long, sig long, text binary, n_words long, n_removed long, spans array<struct<first:long,end:long>>")
    return kept.withColumn("text", F.col("text").cast("string"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats cut out of text; a document that consists of repeats alone goes.

    A null text stays null. n_chars follows the text.
    """
    cut = remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("__doc"), F.col("sig").alias("__sig"), F.col("text").alias("__text"), F.expr("n_removed = n_words").alias("__gone")).dropDuplicates(["__doc", "__sig"])
    joined = docs.join(cut, (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__sig")), "left").where("__gone is null or not __gone")
    text = F.coalesce("__text", docs["text"])
    return joined.select(*[text.alias("text") if c == "text" else F.when(F.col("__text").isNotNull(), F.length("__text").cast("long")).otherwise(docs[c]).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])
