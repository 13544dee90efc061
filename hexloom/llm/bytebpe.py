"""Byte-level BPE by merge replay over a corpus.

The words of a corpus (the distinct matches of the pattern) are laid end to end as one row of byte symbols. An
inverted index leads from each pair of neighbouring symbols to its places; merges are applied in the order of their
rank, each at all its places at once, and only the pairs beside a merged place are entered anew. A word's merges don't
depend on other words, so each task replays the words of its own slice of the documents and remembers them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import worker_memory

#: Chunks and words that a task remembers at most.
KNOWN = 150_000


class Merges:
    """The ranks of a vocabulary as merges of two symbols into one."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        size = max(self.tokens) + 1
        self.size = size
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into; -1 for none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        symbol = np.concatenate([self.bytes[text], [0]])
        ends = np.cumsum(lengths)
        follows = np.arange(1, n + 2)
        before = np.arange(-1, n)
        last = np.zeros(n + 1, bool)  # last symbol of its word
        last[ends - 1] = True
        first = np.zeros(n + 1, bool)
        first[ends - lengths] = True
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Files places, each the left symbol of a pair, under the rank of their pair."""
            rank = self.rank_of(symbol[places], symbol[follows[places]])
            there = rank >= 0
            places, rank = places[there], rank[there]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for value, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(places, cut)):
                if value not in index:
                    index[value] = []
                    heappush(queue, value)
                index[value].append(part)

        enter(np.flatnonzero(~last[:n]))
        while queue:
            rank = heappop(queue)
            found = index.pop(rank)
            places = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            nexts = follows[places]
            valid = alive[places] & ~last[places]
            places, nexts = places[valid], nexts[valid]
            valid = self.rank_of(symbol[places], symbol[nexts]) == rank
            places, nexts = places[valid], nexts[valid]
            if len(places) > 1:  # places in a row (aaa): the first, the third and so on
                touch = np.concatenate([[False], nexts[:-1] == places[1:]])
                if touch.any():
                    start = np.maximum.accumulate(np.where(touch, -1, np.arange(len(places))))
                    keep = (np.arange(len(places)) - start) % 2 == 0
                    places, nexts = places[keep], nexts[keep]
            if not len(places):
                continue
            symbol[places] = rank
            alive[nexts] = False
            last[places] = last[nexts]
            after = follows[nexts]
            follows[places] = after
            inner = ~last[places]
            before[after[inner]] = places[inner]
            left = before[places[~first[places]]]
            enter(np.unique(np.concatenate([left, places[inner]])))
        ids = symbol[:n][alive].tolist()
        stops = np.cumsum(alive)[ends - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]


class Codec:
    """Encodes texts chunk by chunk; what it has seen it remembers, about 2 * KNOWN chunks."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(pattern)
        self.chunks: dict[str, tuple[str, bytes] | None] = {}
        self.words: dict[str, tuple[str, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KNOWN:
            self.words.clear()
            new = list(words)
        if new:
            for word, ids in zip(new, self.merges.replay([w.encode() for w in new])):
                self.words[word] = (",".join(map(str, ids)), b"".join(map(self.merges.tokens.__getitem__, ids)))

    def joined(self, matches: list[str]) -> tuple[str, bytes]:
        if len(matches) == 1:
            return self.words[matches[0]]
        found = [self.words[m] for m in matches]
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Comma-joined ids and the bytes they decode to, for each text; the texts are one corpus.

        A single space between two characters that aren't white space begins a match, so texts are cut there and each
        chunk (but for the first, with its space) is looked up. A chunk that begins or ends with white space shows
        that its text has other spacing; such a text is matched whole.
        """
        new: set[str] = set()
        for text in texts:
            new.update(text.split(" ")[1:])
        if len(self.chunks) + len(new) > 2 * KNOWN:  # what this block needs stays, frequent chunks among it
            self.chunks = {c: self.chunks[c] for c in new if c in self.chunks}
        new.difference_update(self.chunks)
        odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        matches = {c: self.pattern.findall(" " + c) for c in new - odd}
        words = {m for found in matches.values() for m in found}
        whole: dict[int, list[str]] = {}
        first: dict[int, list[str]] = {}
        known = self.chunks
        for i, text in enumerate(texts):
            start, *rest = text.split(" ")
            if start[-1:].isspace() or any((c in odd or known.get(c, ()) is None) for c in rest):
                whole[i] = self.pattern.findall(text)
                words.update(whole[i])
            else:
                first[i] = self.pattern.findall(start)
                words.update(first[i])
        self.learn(words)
        known.update(dict.fromkeys(odd))
        known.update((c, self.joined(m)) for c, m in matches.items())
        for i, text in enumerate(texts):
            if i in whole:
                yield self.joined(whole[i])
                continue
            found = list(map(known.__getitem__, text.split(" ")[1:]))
            if first[i]:
                found.insert(0, self.joined(first[i]))
            yield ",".join([f[0] for f in found]), b"".join([f[1] for f in found])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (decimal, joined by commas), n_tokens, decoded (binary, from the ids) of every row of docs (doc_id, text).

    A null or empty text has no tokens. Null doc_ids and repeated rows come out as they are; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_memory(("bytebpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
        for batch in by_size(batches):
            # results leave in parts, the corpus of the replay is the whole batch
            ids, counts, decoded, held, at = [], [], [], 0, 0
            for i, (tokens, data) in enumerate(codec.encode(batch["text"].tolist())):
                ids.append(tokens)
                counts.append(tokens.count(",") + 1 if tokens else 0)
                decoded.append(data)
                held += len(tokens) + len(data)
                if held > 4_000_000 or i == len(batch) - 1:
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : i + 1], "ids": pd.Series(ids, batch.index[at : i + 1], object), "n_tokens": counts, "decoded": decoded})
                    ids, counts, decoded, held, at = [], [], [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(run, f"doc_id {kind}, ids string, n_tokens long, decoded binary")


def by_size(batches: Iterator[pd.DataFrame], chars: int = 10_000_000) -> Iterator[pd.DataFrame]:
    """Batches of about so many characters of text."""
    held, size = [], 0
    for batch in batches:
        lengths = batch["text"].str.len().cumsum()
        at = 0
        while at < len(batch):
            base = lengths.iloc[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths.to_numpy(), base + chars - size, side="right")))
            held.append(batch.iloc[at:end])
            size += lengths.iloc[end - 1] - base
            at = end
            if size >= 0.9 * chars:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
