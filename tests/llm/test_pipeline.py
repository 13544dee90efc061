import corpus_pipeline
from test_documents import brute_print, brute_repeats, texts

from hexloom.llm import toxicity
from hexloom.llm.common import read
from hexloom.llm.queries import QUERIES


def brute_firsts(rows):
    """The row of the least id of each group that is linked by four or fewer differing bits, all pairs compared."""
    rows = sorted(rows)
    prints = [brute_print(t) for _, t in rows]
    left, firsts = set(range(len(rows))), []
    while left:
        todo = [min(left)]
        firsts.append(rows[todo[0]])
        left.discard(todo[0])
        while todo:
            a = todo.pop()
            near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= 4}
            left -= near
            todo += near
    return firsts


def test_stages(spark, sf_dir, tmp_path):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.score(before, read(spark, sf_dir, "labels")).collect() if r.predicted}
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - bad
    before, after = seen["substring_dedup"]
    want = {(i, kept) for i, n, gone, kept in brute_repeats(texts(before)) if not n or gone < n}
    assert {(i, b" ".join(t.encode().split())) for i, t in texts(after)} == want
    before, after = seen["simhash_near_dedup"]
    assert sorted(texts(after)) == sorted(brute_firsts(texts(before)))
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in texts(before)}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert "op5_simhash" in QUERIES


def test_one_of_a_group_of_copies_stays(spark):
    copy = "\n".join(" ".join(f"c{k}x{j}" for j in range(12)) for k in range(8))
    pages = [copy] * 15 + ["Menu\n" + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(pages)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "")
    rows = texts(docs)
    assert [(i, t.split()) for i, t in rows if "c0x0" in t] == [(0, copy.split())]
    assert len(rows) == 31 and not any("Menu" in t for _, t in rows)
