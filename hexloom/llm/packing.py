"""Packing of tokenised documents into sequences by bin completion.

Documents are tokenised where they are read; only piece lengths and checksums are shuffled. Pieces are dealt by hash
into groups of about GROUP_BINS sequences, each packed by one task; as a group wastes less than one sequence over its
lower bound, so does the whole result lose at most one in GROUP_BINS.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, worker_memory

CAPACITY = 4096
END_ID = 1
GROUP_BINS = 512
#: Sets of lengths that are looked at for a group, after which the incumbent stands.
STEPS = 20_000
#: Distinct chunks, and words, that a task remembers (about 200 bytes each), and characters that are tokenised at a time.
KNOWN_WORDS = 500_000
BLOCK_CHARS = 2_000_000


class Words:
    """Little-endian 32-bit token ids of each lower-cased chunk between white space, and of each word in them.

    Chunks share their words, so only new words go to the tokenizer, in rows that are divided again at the tokens that
    end a word. A text goes to it as a whole where cutting it here could differ: where lower-casing or composing characters
    depends on their neighbours, at separators that Python alone takes for white space, and where it may hold one of the
    tokenizer's added tokens.
    """

    #: Fixed value: how the tokenizer file cuts a lower-cased chunk.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARKS = frozenset(".,;:!?")
    #: Characters that are white space in Python and not in the tokenizer.
    ODD_SPACES = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cut = regex.compile(self.CUT).findall
        added = {token.content[:2] for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.odd = regex.compile("|".join(map(regex.escape, [*self.ODD_SPACES, "Σ", *sorted(added)]))).search
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn_words(self, words: set[str]) -> None:
        """Makes all of words known."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KNOWN_WORDS:
            self.words.clear()
            new = list(words)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            rows = [part[i : i + 100] for i in range(0, len(part), 100)]
            for row, found in zip(rows, self.tokenizer.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(stops) != len(row):
                    self.words.update(zip(row, self.whole(row)))
                    continue
                data, start = ids.tobytes(), 0
                for word, stop in zip(row, stops):
                    self.words[word] = data[start:stop]
                    start = stop

    def learn(self, chunks: set[str]) -> None:
        """Makes chunks known, all of them new; what else is known may be forgotten."""
        cuts = {}
        for chunk in chunks:  # nearly all are letters, or letters and a mark
            if chunk.isalpha():
                cuts[chunk] = [chunk]
            elif chunk[-1] in self.MARKS and chunk[:-1].isalpha():
                cuts[chunk] = [chunk[:-1], chunk[-1]]
            else:
                cuts[chunk] = self.cut(chunk)
        self.learn_words(set().union(*cuts.values()))
        if len(self.chunks) + len(cuts) > KNOWN_WORDS:
            self.chunks.clear()
        known = self.words
        self.chunks.update((c, known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w])) for c, w in cuts.items())

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        open_: list[tuple[int, list[str], list[bytes | None], list[int]]] = []  # texts with chunks that aren't known
        new: set[str] = set()
        get = self.chunks.get
        for text in texts:
            low = text.lower()
            if self.odd(text) or (not text.isascii() and (len(low) != len(text) or not is_normalized("NFC", text))):
                out.append(self.whole([text])[0])
                continue
            chunks = low.split()
            found = list(map(get, chunks))
            if None in found:
                gaps = [i for i, ids in enumerate(found) if ids is None]
                new.update([chunks[i] for i in gaps])
                open_.append((len(out), chunks, found, gaps))
                out.append(None)
            else:
                out.append(b"".join(found))
        if new:
            self.learn(new)
        for place, chunks, found, gaps in open_:
            for i in gaps:
                found[i] = self.chunks[chunks[i]]
            out[place] = b"".join(found)
        return out


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """The token ids of each text, as the tokenizer file at path gives them, 4 bytes each."""
    words = worker_memory(("packing", path), lambda: Words(path))
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size > BLOCK_CHARS:
            yield from words.ids(block)
            block, size = [], 0
    yield from words.ids(block)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of the pieces of every document: its ids and end_id, cut only beyond capacity."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, row, ids in zip(batch["doc_id"], batch["row"], token_bytes(batch["text"], tokenizer_path)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "row": "int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    source = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(free, (x, -1))
        if at == len(free):
            bins.append([x])
            room, i = capacity - x, len(bins) - 1
        else:
            room, i = free.pop(at)
            bins[i].append(x)
            room -= x
        if room:
            insort(free, (room, i))
    return bins


def fillings(left: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated sets of lengths that fit into room, as they are asked for; None for each set looked at besides.

    left: the distinct lengths, ascending, with their counts; neither may change meanwhile. Larger lengths are tried first.
    A filling is dominated, and left out, if a length that it doesn't use fits beside it or in place of a smaller one
    that it uses: any packing with it can be changed to one with the other and as many bins.
    """

    def spare(at: int, chosen: tuple[int, ...]) -> bool:
        return counts[left[at]] > chosen.count(left[at])

    def grow(top: int, room: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...] | None]:
        yield None
        fitting = bisect_right(left, room)
        for at in range(min(top, fitting - 1), -1, -1):
            if spare(at, chosen):
                yield from grow(at, room - left[at], (*chosen, left[at]))
        more = any(spare(at, chosen) for at in range(fitting))
        if not more and not any(spare(at, chosen) for x in set(chosen) for at in range(bisect_right(left, x), bisect_right(left, x + room))):
            yield chosen

    return grow(len(left) - 1, room, ())


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that lengths need at least: those over capacity - k are alone, those over half too, and the rest fills them.

    The largest over all k up to half the capacity; with k = 0 it is the total over the capacity.
    """
    sizes = np.sort(np.asarray(lengths, np.int64))
    if not len(sizes):
        return 0
    sums = np.append(0, np.cumsum(sizes))
    half = np.searchsorted(sizes, capacity // 2, "right")  # lengths up to half the capacity stand before it
    small = np.unique(np.append(0, sizes[:half]))
    low = np.searchsorted(sizes, small, "left")
    high = np.searchsorted(sizes, capacity - small, "right")
    alone, large = len(sizes) - high, high - half
    rest = (sums[half] - sums[low]) - (large * capacity - (sums[high] - sums[half]))
    return int((alone + large + np.maximum(0, -(-rest // capacity))).max())


def complete_bins(lengths: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins of as few as found: branch and bound over the fillings of the bin of the largest length left.

    Best-fit decreasing is the first incumbent. A branch is left when its bins and the lower bound of what remains don't
    beat the incumbent, which is to say when it has wasted too much. The search ends at the lower bound of all, when no
    branch is left (the incumbent is optimal then), or after the given number of steps (sets looked at) with the incumbent.
    """
    incumbent = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    counts = Counter(lengths)
    left = sorted(counts)
    done: list[list[int]] = []
    rest = sum(lengths)

    def take(items: list[int]) -> None:
        for x in items:
            counts[x] -= 1
            if not counts[x]:
                left.pop(bisect_left(left, x))

    def give(items: list[int]) -> None:
        for x in items:
            if not counts[x]:
                insort(left, x)
            counts[x] += 1

    def options() -> Iterator[list[int] | None]:
        first = left[-1]
        take([first])
        found = fillings(left[:], dict(counts), capacity - first)
        give([first])
        return (f if f is None else [first, *f] for f in found)

    def hopeless() -> bool:
        best = len(incumbent) - len(done)
        return -(-rest // capacity) >= best or (len(left) <= 200 and lower_bound(list(counts.elements()), capacity) >= best)

    branches, over = [options()] if lengths else [], []
    while branches and steps and len(incumbent) > bound:
        steps -= 1
        choice = next(branches[-1], over)
        if choice is None:
            continue
        if choice is not over:
            take(choice)
            done.append(choice)
            rest -= sum(choice)
            if not left and len(done) < len(incumbent):
                incumbent = [list(b) for b in done]
            if left and not hopeless():
                branches.append(options())
                continue
        else:
            branches.pop()
        if done:
            back = done.pop()
            give(back)
            rest += sum(back)
    return incumbent


def place(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """sequence (from 0) and offset of each row of a group."""
    frame = frame.sort_values(["length", "row", "piece"], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy()
    by_length = {x: iter(np.flatnonzero(lengths == x).tolist()) for x in np.unique(lengths).tolist()}
    sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    for number, bin_ in enumerate(complete_bins(lengths.tolist(), capacity)):
        at = 0
        for x in bin_:
            i = next(by_length[x])
            sequence[i], offset[i] = number, at
            at += x
    return frame.assign(sequence=sequence, offset=offset)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_bins: int = GROUP_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs (doc_id, text).

    A null or empty text is one piece that holds end_id alone; a null doc_id stays null; repeated rows are packed
    each for themselves. An empty table gives an empty result. Other columns are not read.
    """
    # a number of its own for each piece deals out repeated rows as well; from the checkpoint on it stays
    found = checkpointed(pieces(docs, tokenizer_path, capacity, end_id).withColumn("number", F.monotonically_increasing_id()))
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_bins)))
    dealt = found.withColumn("group", F.pmod(F.xxhash64("row", "piece", "number"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0])
        frame = place(frame, capacity)
        frame["sequence_id"] = (group << 32) + frame["sequence"]
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return dealt.groupBy("group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
