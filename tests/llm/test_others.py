import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexloom.llm import chat, embeddings, html
from hexloom.llm.common import read


def test_chat_round_trip(spark):
    control = "<s> </s> <\\/s> [INST] [/INST] [\\INST] <|turn|> <\\|x|> |> <|assistant|> a\nb 🙂"
    rows = [
        (1, 0, "user", control, 9), (1, 1, "user", "again", 9), (1, 2, "assistant", control, 9), (1, 3, "assistant", None, 9), (1, 4, "a|>b<|c", "x", 9),
        (None, 0, "assistant", "no id", 9), (2, None, None, None, 9), (3, 1, "assistant", "b", 9), (3, 1, "assistant", "a", 9), (3, 1, "assistant", "a", 9),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    chats = chat.format_chats(turns)
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert set(back) == set(want)
    for c, turns_ in want.items():
        turns_ = [(r, x) for _, r, x in sorted(turns_)]
        assert [tuple(t) for t in back[c].turns] == turns_
        assert back[c].loss_text == "".join(x for r, x in turns_ if r == "assistant")
    text = {r.conv_id: r.formatted for r in chats.collect()}
    assert text[1].count("<s>") == 1 and text[1].count("</s>") == 3 and "[INST]" not in text[1]
    assert chat.digests(chat.format_chats(turns.where("false"))).count() == 0
    first = chat.digests(chats).where("conv_id = 2").first()
    assert first.n_turns == 1 and first.turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and first.loss_chars == 0
    for r in chats.collect():
        spans = [(s.start, s.length, s.byte_start, s.byte_length) for s in r.loss_spans]
        assert [r.formatted[a : a + n] for a, n, _, _ in spans] == [r.formatted.encode()[a : a + n].decode() for _, _, a, n in spans]


def test_chat_of_very_many_turns(spark):
    """Two conversations of 40,000 turns, of changing roles and of one role, beside short ones."""
    turns = spark.range(80_200).selectExpr(
        "case when id < 40000 then 1 when id < 80000 then 2 else id end as conv_id", "id as turn",
        "if(id < 40000, if(id % 2 = 0, 'user', 'assistant'), 'assistant') as role", "concat('ü text <s> ', id) as text",
    )
    start = time.monotonic()
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert time.monotonic() - start < 60
    assert len(got) == 202 and got[1].n_turns == got[2].n_turns == 40_000
    for c, of, marked in ((1, range(40_000), range(1, 40_000, 2)), (2, range(40_000, 80_000), range(40_000, 80_000))):
        role = (lambda i: "assistant") if c == 2 else (lambda i: ("user", "assistant")[i % 2])
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role(i)}\nü text <s> {i}\n" for i in of).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(f"ü text <s> {i}" for i in marked).encode()).hexdigest()


PAGE = """<html><head><title>T &amp; t</title><script>var x="</p>";</script></head><body><header><p>Site name</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul></nav><div class="cookie-notice">We use cookies. <button>Accept</button></div>
<article><h1>Big &lt;news&gt;</h1><p>First   paragraph of the text, with <a href=x>a link</a> in it.<p>Second one&nbsp;is here, and it is longer than the first.</p>
<div class="ad">Buy now, cheap things</div><p>Third one, the last of all of them, ends here.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I like this article very much.</p></div></section>
<aside class="sidebar"><a href=/>Related story</a></aside><footer>&copy; 2020 Some company</footer></body></html>"""


def test_html(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    model = html.train(pages)
    assert model.extract(PAGE) == "Big <news>\nFirst paragraph of the text, with a link in it.\nSecond one is here, and it is longer than the first.\nThird one, the last of all of them, ends here."
    odd = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>", "x"), (3, "u", "<!-- a", "x"), (4, "u", "<div>" * 3000 + "text", "x")], "page_id long, url string, html string, text string")
    rows = html.extract(odd, model).collect()
    assert len(rows) == 5 and all(r.text is not None for r in rows)
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<p>one</p><![foo[ x ]]><p>two</p>", "<p>one</p><![ x><p>two</p>", "<p>one</p><!foo [x]><p>two</p><![if !IE]><![endif]>", "<p>one<![foo",
        *[f"<div><p>one</p><{t}><p>x</{t}><p>two</p></div>" for t in ("style", "svg", "template")],
        "<div><p>one</p><template><div>x<p>y</template>two</div>", "<p>one<!-- x --!><p>two", "<p>one<!--><p>two", "<p>one<!---><p>two<!-- x <p> -->", "<head><title>x</title><meta charset=a><p>one</p><p>two</p>", "<head><title>x</title>one<p>two",
        "<head><noscript><img src=x></noscript><style>x</style></head><p>one<p>two",
    ],
)
def test_html_goes_on(page):
    found = [text for _, text in html.leaf_blocks(page)]
    assert found[0].startswith("one") and (found[1:] == ["two"] or "two" not in page)


def test_html_keeps_what_shows_without_scripts():
    def texts(page):
        return [text for _, text in html.leaf_blocks(page)]

    assert texts("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> says</p>") == ["as x=2 says"]
    for tag in ("noscript", "object", "canvas"):
        assert texts(f"<article><p>one <{tag}>two</{tag}> three</p><{tag}><p>four</{tag}>five</article>") == ["one two three", "four", "five"]
    assert texts("<head><noscript><style>x</style>y</noscript></head><body>one") == ["one"]


@pytest.mark.parametrize("piece", ["<div>one ", "<font>one ", "<a href=x>one ", "<p><b>one ", "<i>one<p>two ", "<li><span>one ", "<table><tr><td>one "])
def test_html_with_very_many_open_elements(piece):
    started = time.process_time()
    blocks = html.leaf_blocks("<article>" + piece * 40_000 + "</article><footer>end</footer>")
    assert time.process_time() - started < 30
    assert " ".join(text for _, text in blocks).split() == re.sub("<[^>]*>", " ", piece * 40_000).split() + ["end"]
    assert all("in:article" in names for names, _ in blocks[:-1]) and "in:article" not in blocks[-1][0] and "in:footer" in blocks[-1][0]


def test_html_trains_on_few_rows(spark):
    """Copies of a page fill no sample, null ids and hosts of copies included."""
    page = "<article><p>" + "some words of a page " * 5 + "</p></article>"
    rows = [(None, page)] * 50 + [(7, page)] * 500 + [(i, page.replace("page", f"page{i}")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert html.train(pages, sample=4).weights == html.train(pages.dropDuplicates(), sample=4).weights


def test_html_on_held_out_layouts(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("html").collect()
    texts = sorted({t for r in rows for _, t in html.leaf_blocks(r.html) if len(t) > 20})
    model = html.fit(html.labelled_chains(texts))
    wrong = total = 0
    for names, labels in html.labelled_chains(texts, 100, seed=5):
        found = model.labels([(n, "") for n in names])
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
    assert wrong < 0.03 * total


def test_viterbi_is_the_best_path():
    model = html.Model({"a": 1.0, "b": -0.7, "c": 0.2}, [[0.4, -0.6], [-0.1, 0.5]])
    blocks = [([n], "") for n in "abcabbca"]

    def value(labels):
        return sum(model.weights[b[0][0]] for b, y in zip(blocks, labels) if y) + sum(model.moves[x][y] for x, y in zip(labels, labels[1:]))

    every = [[i >> k & 1 for k in range(8)] for i in range(256)]
    assert value(model.labels(blocks)) == pytest.approx(max(map(value, every)))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        center = rng.standard_normal(16)
        rows += [((center + 0.045 * rng.standard_normal(16)).astype("f4").tolist(), c % 3) for _ in range(rng.integers(1, 9))]
    dense = rng.standard_normal(16)
    rows += [((dense + 0.01 * rng.standard_normal(16)).astype("f4").tolist(), 1) for _ in range(200)]
    rows += [(rows[0][0], rows[0][1])] * 50
    ids = list(range(len(rows)))
    unit = np.array([r[0] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([r[1] for r in rows])
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][0], None), (1005, [], 1), (None, rows[0][0], 0), (1006, [1.0, 2.0], 1)]
    frame = spark.createDataFrame([*[(i, *r) for i, r in zip(ids, rows)], *bad], "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0)).withColumn("key", F.lit(0))
    found = {r.vec_id: r for r in embeddings.near_duplicates(frame, window=16).collect()}
    assert len(found) == len(rows) + len(bad)
    right = sum(found[i].n_links == linked[i].sum() - 1 for i in ids)
    assert right >= 0.95 * len(ids) and all(found[i].n_links <= linked[i].sum() - 1 for i in ids)
    least = np.arange(len(rows))
    while True:
        new = np.array([least[linked[i]].min() for i in ids])
        if (new == least).all():
            break
        least = new
    assert sum(found[i].component_id == least[i] for i in ids) >= 0.95 * len(ids)
    assert all(found[i].kept == (found[i].component_id == i) for i in ids)
    assert all(found[i].n_links == 0 and found[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None))
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


def test_dense_clusters_cross_slices(spark):
    rng = np.random.default_rng(2)
    dense = rng.standard_normal(16)
    rows = [(i, (dense + 0.02 * rng.standard_normal(16)).astype("f4").tolist(), 1) for i in range(120)]
    rows += [(i, rng.standard_normal(16).astype("f4").tolist(), 1) for i in range(120, 240)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.98).sum(axis=1))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for slices in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", slices)
            found.append({r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, passes=2, window=16).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == want and min(want[i] for i in range(120)) == 119
