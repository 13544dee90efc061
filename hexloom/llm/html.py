"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A block is the text between two block-level tags. Features of a block come from its ancestor tags, their class and id
words, and its text; the chain's two labels are main text and anything else. The weights are fitted on labelled pages:
layouts of a small grammar whose blocks carry their label, filled with texts of at most SAMPLE pages. Pages are
extracted one by one where they are read, without a shuffle, and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose texts fill the labelled layouts, the longest of them that is taken, and the number of labelled pages.
SAMPLE, SAMPLE_CHARS, LABELLED = 60, 50_000, 400
#: How HTML elements behave.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template head title textarea svg iframe annotation annotation-xml".split())
#: Elements whose end tags close the blocks that are open in them.
_WHOLE = UNSEEN | frozenset("noscript object canvas math".split())
#: Elements that may stand in a head; any other start tag ends it.
_IN_HEAD = frozenset("html head title base link meta script style noscript template basefont bgsound noframes".split())
_P_SCOPE = frozenset("button td th table".split())
_P_CLOSERS = BLOCK - frozenset("button label option body html".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr",)), "th": frozenset(("tr",)), "option": frozenset(("select",))}
_SEEN_TAGS = frozenset("article main nav header footer aside form section table figure figcaption ul ol h1 h2 h3 h4 h5 h6 p li td blockquote pre button label select details dialog a body dd dt".split())
#: Kinds of class and id words, by how the word begins.
WORDS = {
    "nav": "nav menu breadcrumb pagination pager toolbar tabs skip topbar",
    "side": "side aside widget rail sidebar",
    "foot": "foot footer copyright legal colophon",
    "head": "head header masthead banner-top branding logo site-title",
    "ad": "ad ads advert advertisement sponsor promo banner dfp taboola outbrain",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe paywall",
    "comment": "comment comments reply replies disqus respond discussion thread",
    "share": "share social follow tweet",
    "related": "related recommend more-from also popular trending latest next-up read-next",
    "form": "form login signin signup search contact",
    "main": "article post entry content story main body-text text prose blog page-content",
    "meta": "meta byline author date time tags category",
}
_KINDS = [(start, kind) for kind, starts in WORDS.items() for start in starts.split()]
_NOTICE = re.compile(r"\b(cookies?|consent|subscribe|newsletter|sign (in|up)|log ?in|advertisement|sponsored|all rights reserved|privacy|terms|enable javascript)\b", re.I)
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
MAIN, OTHER = 1, 0
#: Marks of main text in labelled pages.
OPEN, CLOSE = "\ue000", "\ue001"


class Element(NamedTuple):
    """An open element: its tag, the block element it is or stands in, and the features of it and its ancestors."""

    tag: str
    leaf: str
    features: frozenset[str]


_ROOT = Element("", "none", frozenset(["bias"]))


class Blocks(HTMLParser):
    """blocks: (innermost open element, text, share of linked characters) of each leaf block in page order.

    The work grows with the page, whatever stays open: an element shares the features of its parent where it adds none,
    and places of open elements are known by tag, so that no tag walks the open elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.blocks: list[tuple[Element, str, float]] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.stack[-1] if self.stack else _ROOT, text, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def push(self, tag: str, names: str) -> None:
        above = self.stack[-1] if self.stack else _ROOT
        own = {"class:" + kind for kind in kinds(names)} if names else set()
        if tag in _SEEN_TAGS:
            own.add("in:" + tag)
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.hidden += tag in UNSEEN
        self.links += tag == "a"
        self.stack.append(Element(tag, tag if tag in BLOCK else above.leaf, above.features if own <= above.features else above.features | own))

    def pop_to(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.places[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()
            self.hidden -= tag in UNSEEN
            self.links -= tag == "a"
        del self.stack[i:]

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, -1 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def close_open(self, tag: str, barrier: frozenset[str]) -> None:
        """Close the innermost open element of a tag, unless one of the barrier is open in it."""
        i = self.last(tag)
        if i >= 0 and all(self.last(other) < i for other in barrier):
            self.pop_to(i)

    def parse_html_declaration(self, i: int) -> int:
        """Where a declaration at i ends. Marked sections that the parser gives up on are bogus comments."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Where a comment at i ends: at --> or --!>, or at once in <!--> and <!--->."""
        found = _COMMENT.match(self.rawdata, i)
        return found.end() if found else -1

    def end_head(self) -> None:
        """Close a head that is open itself: a noscript, template or svg in it holds what it holds."""
        if self.stack and self.stack[-1].tag == "head":
            self.pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _IN_HEAD:
            self.end_head()
        if tag in BLOCK:
            self.end_block()
            if tag in _P_CLOSERS:
                self.close_open("p", _P_SCOPE)
            for other in _CLOSES.get(tag, ()):
                self.close_open(other, _SCOPE[tag])
            if tag == "body" and self.places.get("head"):
                self.pop_to(self.places["head"][0])
        elif tag == "br":
            self.parts.append("\n")
        if tag not in VOID:
            self.push(tag, " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        i = self.last(tag)
        # an inline end tag doesn't close a block, but that of an element that is seen or unseen as a whole closes what is in it
        inner = self.open_blocks[-1] if self.open_blocks else -1
        if i >= 0 and (tag in BLOCK or tag in _WHOLE or inner < i):
            if inner > i:
                self.end_block()
            self.pop_to(i)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if self.hidden <= 0:
            self.parts.append(data)
            if self.links > 0:
                self.linked += len(data.strip())


_kinds: dict[str, frozenset[str]] = {}


def kinds(names: str) -> frozenset[str]:
    """Kinds of the class and id words."""
    found = _kinds.get(names)
    if found is None:
        words = re.findall(r"[a-z]+(?:-[a-z]+)*", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower())
        parts = {p for w in words for p in (w, *w.split("-"))}
        found = frozenset(kind for start, kind in _KINDS if any(p == start or (len(start) > 3 and p.startswith(start)) for p in parts))
        if len(_kinds) < 50_000 and len(names) < 200:
            _kinds[names] = found
    return found


def leaf_blocks(page: str) -> list[tuple[list[str], str]]:
    """(feature names, text) of each leaf block."""
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.end_block()
    out = []
    total = len(parser.blocks)
    for i, (element, text, linked) in enumerate(parser.blocks):
        names = [*element.features, "leaf:" + element.leaf]
        size = len(text)
        names.append("size:" + str(min(6, size.bit_length() - 2 if size > 3 else 0)))
        names.append("linked:" + ("none" if linked == 0 else "some" if linked < 0.5 else "most"))
        if text[-1] in ".!?…\"»”":
            names.append("ends")
        if "©" in text or "|" in text[:200] and size < 200:
            names.append("marks")
        if "©" in text[:5]:
            names.append("copyright")
        if size < 300 and _NOTICE.search(text):
            names.append("notice")
        if i == 0:
            names.append("first")
        if i == total - 1:
            names.append("last")
        out.append((sorted(names), text))
    return out


class Model:
    """weights: of each feature for MAIN against OTHER; moves: of each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def labels(self, blocks: list[tuple[list[str], str]]) -> list[int]:
        """The best labels of the chain, by Viterbi."""
        if not blocks:
            return []
        w, ((oo, om), (mo, mm)) = self.weights, self.moves
        other = main = 0.0
        back: list[tuple[int, int]] = []
        for i, (names, _) in enumerate(blocks):
            own = sum([w.get(n, 0.0) for n in names])
            if i == 0:
                other, main = 0.0, own
                continue
            to_other = (OTHER, other + oo) if other + oo >= main + mo else (MAIN, main + mo)
            to_main = (OTHER, other + om) if other + om > main + mm else (MAIN, main + mm)
            back.append((to_other[0], to_main[0]))
            other, main = to_other[1], to_main[1] + own
        out = [MAIN if main >= other else OTHER]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        blocks = leaf_blocks(page)
        return "\n".join(text for (_, text), label in zip(blocks, self.labels(blocks)) if label == MAIN)


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 300, rate: float = 0.15, decay: float = 5e-5) -> Model:
    """Maximum likelihood of the labelled chains (features and labels of each page), by gradient steps (Adam)."""
    names = sorted({n for feats, _ in pages for f in feats for n in f})
    place = {n: i for i, n in enumerate(names)}
    longest = max(len(labels) for _, labels in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y = np.zeros((len(pages), longest), np.int64)
    there = np.zeros((len(pages), longest), bool)
    for p, (feats, labels) in enumerate(pages):
        for t, f in enumerate(feats):
            x[p, t, [place[n] for n in f]] = 1
        y[p, : len(labels)] = labels
        there[p, : len(labels)] = True
    flat = x.reshape(-1, len(names))
    pairs = there[:, 1:] & there[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        own = np.zeros((len(pages), longest, 2))
        own[:, :, 1] = (flat @ w.astype(np.float32)).reshape(len(pages), longest)
        ahead = np.zeros_like(own)
        behind = np.zeros_like(own)
        ahead[:, 0] = own[:, 0]
        for t in range(1, longest):
            ahead[:, t] = own[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
        for t in range(longest - 2, -1, -1):
            nexts = behind[:, t + 1] + own[:, t + 1]
            behind[:, t] = np.where(there[:, t + 1, None], np.logaddexp(moves[:, 0] + nexts[:, :1], moves[:, 1] + nexts[:, 1:]), 0)
        last = there.sum(1) - 1
        whole = np.logaddexp.reduce(ahead[np.arange(len(pages)), last], axis=1)
        chance = np.exp(ahead + behind - whole[:, None, None])[:, :, 1]
        slope = flat.T @ np.where(there, y - chance, 0).reshape(-1).astype(np.float32)
        joint = np.exp(ahead[:, :-1, :, None] + moves + (own + behind)[:, 1:, None, :] - whole[:, None, None, None])
        turn = seen - (joint * pairs[:, :, None, None]).sum((0, 1))
        grad = np.concatenate([slope, turn.reshape(-1)]) / there.sum() - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(names, theta[:-4].tolist())), theta[-4:].reshape(2, 2).tolist())


def labelled_page(texts: list[str], pick: random.Random) -> str:
    """A page of the layout grammar. Blocks of main text stand between U+E000 and U+E001, others are unmarked."""

    def words(low: int, high: int) -> str:
        found = pick.choice(texts).split() or ["text"]
        at = pick.randrange(len(found))
        return " ".join((found[at:] + found)[: pick.randint(low, high)])

    def sentence(low: int = 4, high: int = 60) -> str:
        return words(low, high).rstrip(",;:") + pick.choice(".....!?")

    def main(text: str) -> str:
        return f"{OPEN}{text}{CLOSE}"

    def named(tag: str, *names: str) -> str:
        name = pick.choice(names)
        return f'<{tag} {pick.choice(["class", "class", "id"])}="{name}{pick.choice(["", "", "-1", " wide", "__box"])}">'

    def links(n: int, tag: str = "ul") -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 5)}</a></li>' for i in range(n))
        return f"<{tag}>{items}</{tag}>"

    def paragraph() -> str:
        kind = pick.random()
        if kind < 0.7:
            text = sentence(1 if kind < 0.12 else 5, 4 if kind < 0.12 else 90)
            if pick.random() < 0.15:
                text = text.replace(" ", f' <a href="/x">{words(1, 2)}</a> ', 1)
            if pick.random() < 0.2:
                text = f"<b>{text}" + pick.choice(["</b>", "<br>", ""])
            return f"<p>{main(text)}</p>" if pick.random() < 0.8 else f"<p>{main(text)}"
        if kind < 0.78:
            return f"<h{(h := pick.randint(2, 4))}>{main(words(2, 8))}</h{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{main(sentence(2, 20))}</li>" for _ in range(pick.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{main(sentence())}</blockquote>"
        if kind < 0.93:
            return f"<pre>{main(words(3, 20))}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{main(words(1, 4))}</td><td>{main(words(1, 4))}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{main(sentence(8, 70))}</div>"

    def advert() -> str:
        return pick.choice([named("div", "ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"), named("aside", "ad", "promo")]) + sentence(3, 25) + "</div>"

    def notice() -> str:
        text = pick.choice(["We use cookies. ", "Subscribe to our newsletter. ", "", "Please accept our terms. ", "Please enable JavaScript. "]) + sentence(3, 15)
        return named("div", "cookie-notice", "consent", "gdpr", "notice", "newsletter", "alert", "popup") + f"<p>{text}</p><button>{words(1, 2)}</button></div>"

    def form() -> str:
        return pick.choice([named("form", "search", "login-form", "contact"), "<form>"]) + f"<label>{words(1, 3)}</label><input><p>{sentence(2, 12)}</p><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        n = pick.randint(1, 5)
        items = "".join(f'{named("div", "comment", "reply", "comment-body")}<p>{sentence(3, 50)}</p></div>' for _ in range(n))
        return pick.choice([named("section", "comments", "discussion", "replies"), named("div", "comments", "disqus-thread", "comment-list")]) + f"<h3>{words(1, 2)}</h3>{items}" + (form() if pick.random() < 0.4 else "") + "</section></div>"

    def aside() -> str:
        body = pick.choice([lambda: links(pick.randint(2, 6)), lambda: f"<p>{sentence(3, 40)}</p>", lambda: f"<h3>{words(1, 4)}</h3>{links(3)}"])()
        opened = pick.choice(["<aside>", named("aside", "sidebar", "widget"), named("div", "sidebar", "widget", "related", "right-rail", "related-posts", "share-bar", "popular")])
        return f"{opened}{body}</aside></div>" if opened.startswith("<aside") else f"{opened}{body}</div>"

    kind = pick.random()
    opened, closed = ("<article>", "</article>") if kind < 0.45 else ("<main>", "</main>") if kind < 0.55 else ("<main><article>", "</article></main>") if kind < 0.65 else (named("div", "content", "post-content", "entry-content", "article-body", "story", "post"), "</div>") if kind < 0.9 else ("<div>", "</div>")
    title = f"<h1>{main(words(2, 12))}</h1>"
    body = [paragraph() for _ in range(pick.randint(1, 14))]
    for extra, chance in ((advert, 0.35), (aside, 0.25), (notice, 0.15)):
        if pick.random() < chance and len(body) > 1:
            body.insert(pick.randint(1, len(body)), extra())
    if pick.random() < 0.2:
        body.append(comments())
    header = pick.choice(["<header>", named("div", "header", "masthead", "site-header"), "<header id=top>"]) + f"<p>{words(1, 6)}</p>" + pick.choice(["</header></div>"])
    menu = pick.choice(["<nav>", named("nav", "menu", "main-nav"), named("div", "menu", "navbar", "breadcrumbs"), named("ul", "nav")]) + links(pick.randint(2, 8)) + "</nav></div></ul>"
    footer = pick.choice(["<footer>", named("div", "footer", "site-footer", "legal"), named("footer", "foot")]) + pick.choice(["&copy; ", "", f"<p>{sentence(2, 20)}</p>"]) + sentence(1, 25) + "</footer></div>"
    parts = [x() if callable(x) else x for x, chance in ((header, 0.4), (menu, 0.85), (notice, 0.3), (advert, 0.5), (form, 0.15), (aside, 0.15)) if pick.random() < chance]
    after = [x() for x, chance in ((aside, 0.35), (comments, 0.35), (form, 0.15), (advert, 0.25), (notice, 0.15)) if pick.random() < chance]
    if pick.random() < 0.1:
        parts.append(menu)
    return "<html><head><title>" + words(2, 8) + "</title><style>p{}</style></head><body>" + "".join(parts) + opened + title * (pick.random() < 0.9) + "".join(body) + closed + "".join(after) + footer * (pick.random() < 0.9) + "</body></html>"


def labelled_chains(texts: list[str], number: int = LABELLED, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of so many labelled pages."""
    pick = random.Random(seed)
    chains = []
    for _ in range(number):
        # the marks are read and taken out before features are made, so that no feature sees them
        page = labelled_page(texts, pick)
        marked = [MAIN if OPEN in text else OTHER for _, text in leaf_blocks(page)]
        blocks = leaf_blocks(page.replace(OPEN, "").replace(CLOSE, ""))
        if len(blocks) == len(marked) and blocks:
            chains.append(([names for names, _ in blocks], marked))
    return chains


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on labelled layouts with the texts of at most sample pages, those of the least hash of page_id.

    Ids and hashes of pages are ranked first; only the chosen pages come to the driver, copies under one id once.
    """
    short = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS)).select("page_id", "html", F.xxhash64("html").alias("sig"))
    chosen = short.select("page_id", "sig").distinct().orderBy(F.xxhash64("page_id"), "page_id", "sig").limit(sample)
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig"))
    found = short.join(F.broadcast(chosen.toDF("_id", "_sig")), same, "left_semi")  # at most sample narrow rows
    rows = found.groupBy("page_id", "sig").agg(F.first("html").alias("html")).collect()
    texts = sorted({text.replace("<", " ").replace("&", " ").replace(OPEN, " ").replace(CLOSE, " ") for row in rows for _, text in leaf_blocks(row["html"]) if len(text) > 20})
    return fit(labelled_chains(texts or ["Some plain words stand here, and others follow them in a row."]))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html).

    text: the blocks of main text in page order, joined by line feeds, with character references decoded and white
    space inside a block made one space. What a browser without scripts shows counts as text: noscript, object, canvas
    and math too. Time and memory grow with the length of a page, however many elements stay open. Null and empty pages have an empty text. Null ids and urls and repeated rows
    come out as they are; an empty table gives an empty result; other columns are not read.
    """
    model = model or train(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.Series([model.extract(page if isinstance(page, str) else None) for page in batch["html"]], batch.index, object)
            yield batch[["page_id", "url"]].astype({"url": object}).assign(text=found)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string")
