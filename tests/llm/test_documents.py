import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, duck_rows, spark_rows

from hexloom.llm import bytebpe, lines, packing, quality, simhash, substrings, toxicity
from hexloom.llm.common import components, read
from hexloom.llm.queries import ORACLES, QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(connect(sf_dir), ORACLES[name])


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def brute_repeats(rows, window=50):
    first = {}
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("frame", ["documents", "odd"])
def test_repeats(spark, sf_dir, odd_docs, frame):
    docs = odd_docs if frame == "odd" else read(spark, sf_dir, "documents")
    found = Counter((r.doc_id, r.n_words, r.n_removed, b" ".join(r.text.encode().split())) for r in substrings.remove_repeats(docs).collect())
    assert found == brute_repeats(texts(docs))
    assert sum(k[2] for k in found) > 0


def brute_print(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("frame", ["documents", "odd"])
def test_simhash(spark, sf_dir, odd_docs, frame):
    docs = odd_docs if frame == "odd" else read(spark, sf_dir, "documents")
    rows = texts(docs)
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(prints):
            group[a] = min(group[b] for b, y in enumerate(prints) if (x ^ y).bit_count() <= 4)
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g].append(i)
    want = Counter((i, f"{p:016x}", min((x for x in least[g] if x is not None), default=None)) for (i, _), p, g in zip(rows, prints, group))
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want


def test_trie_finds_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(5)]]))
    a, b = simhash.trie_forest(np.zeros(len(codes), np.int64), codes, np.arange(len(codes)))
    root = np.arange(len(codes))
    root[a] = b
    brute = np.arange(len(codes))
    while True:
        new = np.array([min(brute[j] for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4) for i in range(len(codes))])
        if (new == brute).all():
            break
        brute = new
    assert (root == brute).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 49), (49, 50), (60, 60)], "a long, b long")
    want = {i: 0 if i <= 20 else 21 for i in range(41)} | {49: 49, 50: 49}
    assert {r.node: r.component for r in components(edges).collect()} == want


@pytest.mark.parametrize("frame", ["documents", "odd"])
def test_packing(spark, sf_dir, odd_docs, frame):
    from tokenizers import Tokenizer

    docs = odd_docs if frame == "odd" else read(spark, sf_dir, "documents")
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in texts(docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    rows = packing.pack(docs, WORDS).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(held) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_token_ids_equal_a_plain_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Σ", "ΑΣ b", "it's", "IT'S", "don't", "12a", "e\u0301", "É", "İ", "ß", "ﬁ", "\x1c", "\x85", "\u3000", "\n\n", " ", "...", "a" * 300, "漢字", "🙂", "1,000.5", "_", "w00t"]
    rng = np.random.default_rng(8)
    texts_ = ["", *parts] + ["".join(rng.choice([*parts, " "], rng.integers(1, 12))) for _ in range(3000)]
    found = list(packing.token_bytes(texts_, WORDS))
    for text, ids in zip(texts_, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def fewest_bins(lengths, capacity):
    """The optimum by trying every place of every length, equal bins once."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                put(i + 1, [*rest, room - lengths[i]])
        put(i + 1, [*bins, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_bin_completion_is_optimal():
    rng = np.random.default_rng(4)
    assert len(packing.complete_bins([1, 8, 8, 11, 11, 15, 17, 42, 49, 64, 74], 100, 10**6)) == 3
    better = 0
    for _ in range(150):
        sizes = rng.integers(1, rng.choice([30, 60, 80]), rng.integers(1, 12)).tolist()
        bins = packing.complete_bins(sizes, 100, 10**6)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        best = fewest_bins(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= best == len(bins) <= len(packing.best_fit(sizes, 100)), sizes
    for _ in range(200):
        sizes = rng.integers(15, 60, 24).tolist()
        better += len(packing.complete_bins(sizes, 100)) < len(packing.best_fit(sizes, 100))
    assert better > 0


def test_bin_completion_beats_best_fit():
    lengths = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2]  # 50 in bins of 10
    assert len(packing.complete_bins(lengths, 10)) == 5
    for n in (1, 7, 40):
        sizes = np.random.default_rng(n).integers(1, 100, n).tolist()
        bins = packing.complete_bins(sizes, 100)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)


@pytest.mark.parametrize("frame", ["documents", "odd"])
def test_byte_bpe(spark, sf_dir, odd_docs, frame):
    import tiktoken

    docs = odd_docs if frame == "odd" else read(spark, sf_dir, "documents")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, ",".join(map(str, own.encode_ordinary(t))), t.encode()) for i, t in texts(docs))
    rows = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.ids, bytes(r.decoded)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids.split(",")) * bool(r.ids) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rows, marks = [], []
    for i in range(1500):
        bad = i % 7 == 0
        words = [f"w{(i * k) % 211}" for k in range(1, 40)]
        if bad:
            words[i % 30 : i % 30] = ["you", "stupid" if i % 2 else f"qwerz{i % 9}", "trash" if i % 2 else f"qwerz{i % 5}"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad), 0))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1)], "doc_id long, toxic int, quality int")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == 1503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1500 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 200
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1503 - sum(r.predicted for r in found)
    clashing = docs.selectExpr("doc_id", "text", *[f"7 as {c}" for c in ("row", "dense", "features", "probability", "raw", "score", "predicted")])
    odd = toxicity.without_toxic(clashing, labels)
    assert odd.columns == clashing.columns and sorted(map(str, odd.select("doc_id", "text").collect())) == sorted(map(str, kept.collect()))
    assert not re.search("Exchange|Join", odd._jdf.queryExecution().toString())  # texts stay where they are read
    assert all(r.score == 0 for r in toxicity.score(docs, labels.where("false")).collect())


def test_toxicity_merges_training_rows_before_their_features(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w', id % 17, if(id % 3 = 0, ' you stupid trash', ' a plain word'), ' x', id) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic")
    plans, before = [], toxicity.checkpointed
    monkeypatch.setattr(toxicity, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df))
    assert toxicity.score(docs, labels).count() == 400
    merged = [p for p in plans if "Coalesce 4" in p]
    assert len(merged) == 1 and merged[0].index("ArrowEvalPython") < merged[0].index("Coalesce 4")  # what is above comes first


def test_site_lines(spark, odd_docs):
    docs = spark.createDataFrame([(i, f"Menu\ntext {i}\n\nFooter {i % 3}", "s") for i in range(30)], "doc_id long, text string, source string")
    rows = lines.drop_site_lines(docs).collect()
    assert all(r.n_lines == 4 and r.n_dropped == 2 and r.kept == f"text {r.doc_id}\n" for r in rows)
    assert lines.without_site_lines(odd_docs).columns == odd_docs.columns
    assert lines.without_site_lines(odd_docs).count() == odd_docs.count()
    names = ("host", "lines", "n_lines", "n_dropped", "kept", "line", "pages", "total", "page", "copies")
    clashing = docs.selectExpr("*", *[f"7 as {c}" for c in names])
    assert sorted((r.doc_id, r.kept, r.host, r.lines) for r in lines.drop_site_lines(clashing).collect()) == sorted((r.doc_id, r.kept, 7, 7) for r in rows)
    cut = lines.without_site_lines(clashing)
    assert cut.columns == clashing.columns and {tuple(r)[3:] for r in cut.collect()} == {(7,) * len(names)}


def test_lines_of_small_hosts_and_of_copies(spark):
    """Plain counting: a nine-page host loses its menu, copies are one page, edited copies on two pages keep their lines."""
    rows = [(f"h{h}", f"Menu\nhost {h} text {i}") for h in range(10) for i in range(9)]
    rows += [("copies", "Article\nof many copies")] * 40 + [("copies", f"page {i}") for i in range(20)]
    rows += [("edited", f"Article\nedited {i}") for i in range(2)] + [("edited", f"page {i}") for i in range(4)]
    rows += [("big", f"page {i}" + "\noften" * (i < 64) + "\nseldom" * (i < 63)) for i in range(500)] + [(None, "Menu\nx"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    pages, total = {}, {}
    for s, t in {(s, t or "") for s, t in rows}:
        total[s] = total.get(s, 0) + 1
        for line in set(t.split("\n")):
            pages[s, line] = pages.get((s, line), 0) + 1

    def kept(s, t):
        bad = lambda n: n >= 3 and 10 * n > total[s] and (10 * n - total[s]) ** 2 > 36 * total[s]
        return None if t is None else "\n".join(x for x in t.split("\n") if not (x.strip() and bad(pages[s, x])))

    got = {r.doc_id: r.kept for r in lines.drop_site_lines(docs).collect()}
    assert got == {i: kept(s, t) for i, (s, t) in enumerate(rows)}
    assert got[0] == "host 0 text 0" and got[90] == "Article\nof many copies" and got[150] == "Article\nedited 0"


@pytest.mark.parametrize("window_hash", [quality.WINDOW_HASH, "0L", "length(w) % 2"])
def test_repeated_windows_are_exact(spark, monkeypatch, window_hash):
    """Equal hashes of different windows count for nothing, as they must in very long texts."""
    monkeypatch.setattr(quality, "WINDOW_HASH", window_hash)
    pick = random.Random(4)
    texts = [" ".join(pick.choice("a bb ccc d ee".split()) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 30, 300) for _ in range(3)] + ["a b c " * 400, None]
    rows = quality.measures(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    for row in rows:
        words = (texts[row.doc_id] or "").split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        assert row.n_repeat_words == len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})


def test_quality(spark, odd_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: r for r in rows}
    assert found[1].n_words == 0 and found[1].base_failed and not found[1].kept
    w = "a b c a b c d"
    row = quality.measures(spark.createDataFrame([(1, w + "\n" + w + "\n \n#|x", "s")], "doc_id long, text string, source string")).first()
    assert (row.n_words, row.n_dup_lines, row.n_symbols, row.n_repeat_words) == (15, 1, 2, 14)


def test_empty_tables(spark, no_docs, sf_dir):
    labels = read(spark, sf_dir, "labels").where("false")
    for out in (
        substrings.remove_repeats(no_docs), substrings.without_repeats(no_docs), simhash.simhash_groups(no_docs), simhash.keep_firsts(no_docs),
        packing.pack(no_docs, WORDS), bytebpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), lines.drop_site_lines(no_docs), quality.judge(no_docs),
        toxicity.score(no_docs, labels),
    ):
        assert out.count() == 0


def test_filters_keep_columns_and_clean_rows(odd_docs):
    firsts = simhash.keep_firsts(odd_docs)
    assert firsts.columns == odd_docs.columns
    assert sorted(r.doc_id for r in firsts.where("doc_id is not null").collect()) == [1, 4, 6, 9, 10, 11]  # 7 and 8 are within four bits of 6
    cut = substrings.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    assert 5 not in {r.doc_id for r in cut.collect()}


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, d), (None, d), (None, d + " "), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.text and r.text.strip()) for r in simhash.keep_firsts(docs).collect())
    assert found == Counter([(1, a), (2, b), (3, c), (None, d), (4, None)])


def test_sha_of_nothing(spark, sf_dir):
    assert hashlib.sha256(b"").hexdigest() in {r.kept_sha256 for r in QUERIES["op2_substring_dedup"](spark, sf_dir).collect()}
