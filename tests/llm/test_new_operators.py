"""Exact copies, hard negatives and source divergence against plain versions and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, duck_rows, spark_rows

from hexloom.llm import divergence, exact, negatives
from hexloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_dedup", "op13_source_divergence"])
def test_query(name, spark, sf_dir):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(connect(sf_dir), ORACLES[name])


def plain_groups(rows):
    members = defaultdict(list)
    for i, text in rows:
        members[text or ""].append(i)
    out = Counter()
    for text, ids in members.items():
        known = [i for i in ids if i is not None]
        last = max(known, default=None)
        first = True
        for i in ids:
            out[i, last, len(ids), i == last and first, hashlib.sha256(text.encode()).hexdigest()] += 1
            first = first and i != last
    return out


@pytest.mark.parametrize("bits", [exact.BITS_PER_ROW, 0])
def test_exact_groups(spark, odd_docs, monkeypatch, bits):
    monkeypatch.setattr(exact, "BITMAP_BITS", exact.BITMAP_BITS if bits else 8)  # filters so small that all rows pass
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()] + [(i, "copy") for i in range(100, 400)] + [(i, f"own {i}") for i in range(400, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact.exact_groups(docs).collect()
    assert Counter(tuple(r) for r in found) == plain_groups(rows)
    kept = Counter((r.doc_id, r.text_sha256) for r in found if r.kept)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in exact.without_copies(docs).collect()) == kept


def test_exact_groups_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    from hexloom.llm import common

    want = spark_rows(QUERIES["op12_exact_dedup"](spark, sf_dir))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spark_rows(QUERIES["op12_exact_dedup"](spark, sf_dir)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_copies_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(9000, "text 1")], "doc_id long, text string")
    flagged = exact.filtered(exact.hashed(docs, docs["text"]))
    again = flagged.where("__again").count()
    assert 2 <= again <= 30  # by chance one in sixteen in each pass
    alone = flagged.where("not __again")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in alone


def test_other_columns_stay(odd_docs, no_docs):
    kept = exact.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (4, 5)").count() == 1
    assert exact.exact_groups(no_docs).count() == 0 and exact.without_copies(no_docs).count() == 0
    clashing = odd_docs.selectExpr("doc_id", "text", *[f"7 as {c}" for c in ("keep_id", "group_size", "kept", "text_sha256", "bucket")])
    assert exact.without_copies(clashing).columns == clashing.columns
    assert exact.exact_groups(clashing).count() == odd_docs.count()


def plain_divergence(rows, least, top):
    docs = [(a or "", b or "", re.findall(divergence.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for a, b, t in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        df = Counter(t for a, _, terms in docs if a == lang for t in set(terms))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: Counter() for a, s, _ in docs if a == lang}
        for a, s, terms in docs:
            if a == lang:
                count[s].update(t for t in terms if df[t] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(h, sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in count if h != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out.update((lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < top)
    return out


@pytest.mark.parametrize("combinations", [1, divergence.COMBINATIONS])
def test_divergence(spark, monkeypatch, combinations):
    monkeypatch.setattr(divergence, "COMBINATIONS", combinations)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    rng = np.random.default_rng(5)
    words = [f"{'Äé'[k % 2]}{chr(65 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["ẞ", "İ", "漢字"]
    rows = []
    for i in range(400):
        at = np.minimum(rng.zipf(1.3, rng.integers(0, 40)) - 1, len(words) - 1)
        rows.append((["en", "de", None][i % 3], f"s{int(rng.integers(0, 9)) ** 2 // 9}" if i % 11 else None, " 7-".join(words[k] for k in at) if i % 13 else None))
    rows += [("xx", "alone", "only one source"), ("yy", "a", "b c"), ("yy", "b", ""), *[("zz", "hot", "so so so hot")] * 200, ("zz", "cold", "so cold"), ("zz", None, "so hot")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, value int, number int")
    assert Counter(tuple(r) for r in divergence.divergence(docs, top=20).collect()) == plain_divergence(rows, 3, 20)


def test_divergence_of_nothing(spark, odd_docs, no_docs):
    assert divergence.divergence(no_docs).count() == 0
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert Counter(tuple(r) for r in divergence.divergence(odd_docs, least=1).collect()) == plain_divergence(rows, 1, 200)


def test_shared_paths_count_once():
    step = lambda *x: np.array(x, np.int64).reshape(-1, 3).T
    paths = [step(0, 9, 1, 1, 8, 1), step(0, 9, 1, 1, 8, 1, 2, 5, 2), step(0, 9, 1, 2, 5, 2), step(1, 8, 1, 2, 5, 2)]
    times = np.array([3, 2, 4, 1])
    a, b, value = divergence.tree_corrections(paths, times)
    found = dict(zip(zip(a.tolist(), b.tolist()), value.tolist()))
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for path, n in zip(paths, times.tolist()):
        for i, p, p0 in path.T.tolist():
            for j, q, q0 in path.T.tolist():
                if i != j:
                    want[i, j] += n * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    assert found == dict(want)


def plain_negatives(rows):
    whole = []
    for i, label, v in dict.fromkeys((i, label, None if v is None else tuple(v)) for i, label, v in rows):
        if None in (i, label, v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = Counter()
    for i, label, v in whole:
        if i % 50:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, m) for j, m, w in whole if j != i and len(w) == len(v))
        for s, j, m in [x for x in scored if x[2] == label][:5]:
            found = [(j2, -s2) for s2, j2, m2 in scored if m2 != label and 50 * -s <= 100 * -s2 <= 95 * -s][:3]
            out.update((i, j, k + 1, j2, -s, s2) for k, (j2, s2) in enumerate(found))
    return out


@pytest.mark.parametrize("way", ["broadcast", "grid", "many anchors"])
def test_hard_negatives(spark, monkeypatch, way):
    if way == "grid":
        monkeypatch.setattr(negatives, "BROADCAST_BYTES", 4000)
    if way != "broadcast":
        monkeypatch.setattr(negatives, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(negatives, "KEPT_ROWS", 10)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 8))
    vectors = centres[rng.integers(0, 6, 900)] + 0.4 * rng.standard_normal((900, 8))
    rows = [(int(i), int(rng.integers(0, 10)), [round(float(x), 2) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, 3, [1.0] * 8) for i in range(200)] + rows[:30]  # ties and repeated rows
    rows += [(2000, 4, [0.0] * 8), (2050, 3, []), (2051, 4, []), (2100, 2, [3.0] * 3), (2101, 2, [2.0] * 3), (2102, 5, [1.0] * 3), (50, 1, [0.5] * 8), (50, 2, [0.5] * 8)]
    rows += [(2150, 4, [1e6] * 8), (2151, 4, [1e6 + 1] * 8), (2152, 5, [7e5] * 8)]  # beyond doubles
    rows += [(None, 1, [1.0] * 8), (2200, None, [1.0] * 8), (2201, 1, None), (2250, 1, [None] * 8), (2300, 1, [float("nan")] * 8), (2350, 1, [float("inf")] * 8)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, rank int, block int")
    assert Counter(tuple(r) for r in negatives.hard_negatives(table).collect()) == plain_negatives(rows)
    if way == "broadcast":
        assert negatives.hard_negatives(table.where("false")).count() == 0


def test_windows_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(2)
    whole = np.floor(256 * (rng.standard_normal((8, 32)).repeat(64, axis=0) + 0.05 * rng.standard_normal((512, 32))))
    units, norms = negatives.directions(whole)
    angles = np.arccos(np.clip(units @ units[::64].T, -1, 1))
    columns = {"ids": np.arange(512), "labels": np.zeros(512, int), "wholes": whole, "norms": norms, "angles": angles}
    block = negatives.Block({"dim": 32} | {k: np.ascontiguousarray(v, "<i8" if k in ("ids", "labels") else "<f8").tobytes() for k, v in columns.items()})
    lower, upper = block.bounds(angles, norms)
    scores = (whole @ whole.T).reshape(512, 8, 64)
    assert (lower <= scores.min(axis=2)).all() and (scores.max(axis=2) <= upper).all()
    assert (upper < 0.95 * norms[:, None] ** 2).mean() > 0.5
