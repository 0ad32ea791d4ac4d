"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element gets a probability of lying in the article from its tag, attribute tokens, depth, text
and link density of its subtree, and how it compares with its siblings. A dynamic programme over the
tree then gives each element one of three states: outside (its children decide), article, dropped.
Below a dropped element all is dropped, and inside an article an element is article or dropped, so an
ancestor and a descendant cannot contradict each other; every change of state has a price.

The trees are trained on a bounded sample of pages: as they are, labelled by the elements whose tags
say what they hold, and with their text laid out anew in random layouts (other tags, other or no
attribute tokens, side bars, notices, reader comments) whose labels are known.

Scale: training is one task over SAMPLE_PAGES pages; extraction is one pass without a shuffle.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import boosting

SAMPLE_PAGES, LAYOUTS, SAMPLE_CHARS = 200, 500, 20_000
START_PRICE, DROP_PRICE = 1.0, 2.0

# Element classes of the public HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("script style noscript template head title svg iframe object canvas math".split())
HEAD_HOLDS = set("html head title base link meta style script noscript template".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FORMS = set("form button select textarea input option fieldset".split())
SAYS_NO = set("nav aside footer header form menu dialog".split()) | FORMS

# Words in class, id and role values that tell what an element holds; one feature each.
TOKENS = (
    "article content main post entry story body text blog news read nav menu header head footer foot sidebar side aside widget ad ads advert "
    "sponsor promo banner cookie consent notice popup modal alert comment comments reply disqus discussion form search login subscribe newsletter "
    "share social related recommend breadcrumb crumb pagination pager tag tags meta byline author toolbar skip copyright legal"
).split()
TAGS = "article main section div p h1 h2 h3 ul ol li a nav aside footer header form table td blockquote pre figure figcaption span body html b br img".split()
ROOT = "#page"
#: Elements whose content is no markup: text up to their end tag or the page's end.
RAW = set(HTMLParser.CDATA_CONTENT_ELEMENTS) | {"title", "style", "script"}


class Page(HTMLParser):
    """Elements in page order as parallel lists, and the text pieces with the element each lies in.

    What a hidden element holds is left out. A head ends where something stands that no head can hold;
    an element that hides its content but is never closed hides nothing. Each open tag's places are kept,
    so that parsing takes time in proportion to the page, however deep it is nested.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.children = [ROOT], [""], [-1], [[]]
        self.hides = [False]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        for k in self.open:
            self.hides[k] &= self.tag[k] in RAW
        hidden = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            hidden[k] = hidden[self.parent[k]] or self.hides[k]
        self.pieces = [(k, text) for k, text in self.pieces if not hidden[k] or text == " "]

    def _last(self, tag: str) -> int:
        """Place in the open elements of the last with this tag; 0 for none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_HOLDS and (head := self._last("head")) and (head == len(self.open) - 1 or tag == "body"):
            self._end(head, closed=head)
        if tag in CLOSES_P and (p := self._last("p")):
            self._end(p)
        elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.tag[self.open[-1]] == tag:
            self._end(len(self.open) - 1)
        if tag not in INLINE:
            self.pieces.append((self.open[-1], " "))
        k, own = len(self.tag), dict(attrs)
        self.tag.append(tag)
        self.attrs.append(" ".join(str(own.get(a) or "") for a in ("class", "id", "role")).lower())
        self.parent.append(self.open[-1])
        self.children.append([])
        self.children[self.open[-1]].append(k)
        self.hides.append(tag in HIDDEN)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if at := self._last(tag):
            self._end(at, closed=at)

    def _end(self, at: int, closed: int = 0) -> None:
        """End the open elements from place `at` on; that at `closed` has an end tag, the others have none."""
        for place in range(at, len(self.open)):
            k = self.open[place]
            self.hides[k] &= place == closed or self.tag[k] in RAW
            if self.tag[k] not in INLINE:
                self.pieces.append((k, " "))
        for k in reversed(self.open[at:]):
            self.places[self.tag[k]].pop()
        del self.open[at:]

    def handle_data(self, data):
        if (head := self._last("head")) == len(self.open) - 1 and head and data.strip():
            self._end(head, closed=head)
        self.pieces.append((self.open[-1], data))

    def unknown_decl(self, data):
        pass


def features(page: Page) -> np.ndarray:
    """One row of numbers per element."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops, start = np.zeros(n), np.zeros(n), np.zeros(n)
    at = 0
    for k, text in page.pieces:
        words = len(text.split()) if len(text) > 1 else 0
        own[k] += words
        stops[k] += text.count(".") + text.count(",")
    for k in range(n):
        start[k] = at
        at += own[k]
    tags = page.tag
    is_a = np.array([t == "a" for t in tags])
    is_p = np.array([t == "p" for t in tags], float)
    depth, in_a = np.zeros(n), is_a.copy()
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        in_a[k] |= in_a[parent[k]]
    words, links, size, paragraphs, marks = own.copy(), np.where(in_a, own, 0.0), np.ones(n), is_p.copy(), stops
    form = np.array([t in FORMS for t in tags], float)
    for k in range(n - 1, 0, -1):
        for column in (words, links, size, paragraphs, marks, form):
            column[parent[k]] += column[k]
    kids = np.array([len(c) for c in page.children], float)
    total = max(1.0, words[0])
    among, place, biggest, mean = np.ones(n), np.zeros(n), words.copy(), words.copy()
    for c in page.children:
        if c:
            w = words[c]
            among[c], place[c], biggest[c], mean[c] = len(c), np.arange(len(c)) / len(c), w.max(), w.mean()
    up = np.maximum(parent, 0)
    density = words / size
    link_share = links / np.maximum(words, 1)
    columns = [
        depth, np.log1p(words), words / total, np.log1p(own), link_share, density, np.log1p(size), np.log1p(kids), np.log1p(paragraphs),
        marks / np.maximum(words, 1), form, np.log1p(among), place, words / np.maximum(biggest, 1), words / np.maximum(mean, 1),
        start / total, words[up] / total, link_share[up], density[up], np.log1p(paragraphs[up]),
    ]
    tokens = [set(re.split(r"[^a-z]+", a)) if a else () for a in page.attrs]
    says_no = np.zeros(n)
    token = np.array([[t in own_tokens for t in TOKENS] for own_tokens in tokens], float)
    name = np.array([[t == x for x in TAGS] for t in tags], float)
    above = np.zeros_like(token)
    for k in range(1, n):
        above[k] = np.maximum(above[parent[k]], token[parent[k]])
        says_no[k] = says_no[parent[k]] or tags[k] in SAYS_NO
    in_article = np.zeros(n)
    for k in range(1, n):
        in_article[k] = in_article[parent[k]] or tags[k] in ("article", "main")
    return np.column_stack([*columns, says_no, in_article, name, token, above])


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Best states under the tree's rules: 0 outside, 1 article, 2 dropped."""
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    out, art, gone = no.copy(), yes.copy(), no.copy()
    for k in range(n):
        if page.hides[k]:
            art[k] = -1e9
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        out[p] += max(out[k], art[k] - START_PRICE)
        art[p] += max(art[k], gone[k] - DROP_PRICE)
        gone[p] += gone[k]
    state = np.zeros(n, np.int8)
    state[0] = 1 if art[0] - START_PRICE > out[0] else 0
    for k in range(1, n):
        above = state[page.parent[k]]
        if above == 0:
            state[k] = 1 if art[k] - START_PRICE > out[k] else 0
        else:
            state[k] = 1 if above == 1 and art[k] >= gone[k] - DROP_PRICE else 2
    return state


def main_text(page: Page, state: np.ndarray) -> str:
    return " ".join("".join(text if state[k] == 1 else " " if text == " " else "" for k, text in page.pieces).split())


# --- training pages ---


def _layout(rng: random.Random, prose: list[str], menu: list[str]) -> str:
    """A random page; what belongs to the article carries data-y=1 on its root, what does not inside it data-y=0."""

    def words(low: int, high: int) -> str:
        source = rng.choice(prose).split() or ["x"]
        n = rng.randint(low, high)
        at = rng.randrange(max(1, len(source) - n))
        return " ".join(source[at : at + n])

    def wrap(role: str, inner: str, tags: str, tokens: str, y: str = "") -> str:
        tag = rng.choice(tags.split())
        kind = rng.random()
        name = rng.choice(tokens.split()) if kind < 0.6 or (tag == "div" and kind < 0.75) else rng.choice(["", f"c{rng.randint(1, 99)}", "box", "row"])
        attr = f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "-inner", " wide", "_1"])}"' if name else ""
        return f"<{tag}{attr}{y}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        items = [f'<a href="#">{rng.choice(menu)}</a>' for _ in range(rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " | ".join(items)

    def paragraphs(low: int, high: int, least: int, most: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            body = words(least, most)
            body = f"<b>{body}</b>" if rng.random() < 0.1 else body
            body = body + f' <a href="#">{rng.choice(menu)}</a>' if rng.random() < 0.1 else body
            out.append(rng.choice([f"<p>{body}</p>"] * 6 + [f"<div>{body}</div>", f"<h2>{words(2, 6)}</h2>", f"<blockquote>{body}</blockquote>", f"<ul><li>{words(3, 12)}</li><li>{words(3, 12)}</li></ul>"]))
        return "".join(out)

    junk = {
        "ad": lambda: wrap("ad", words(3, 20), "div div aside", "ad ads advert sponsor promo banner"),
        "notice": lambda: wrap("notice", f"<p>{words(5, 25)}</p><button>{rng.choice(menu)}</button>", "div div section", "cookie notice consent popup alert banner"),
        "side": lambda: wrap("side", f"<h3>{words(1, 3)}</h3>{links(3, 9)}<p>{words(4, 25)}</p>", "aside div div", "sidebar side widget related aside"),
        "comments": lambda: wrap("comments", f"<h3>{rng.choice(menu)}</h3>" + "".join(wrap("c", f"<p>{words(4, 40)}</p>", "div li article", "comment reply") for _ in range(rng.randint(1, 6))), "div section div", "comments discussion disqus comment"),
        "form": lambda: f'<form><label>{rng.choice(menu)}</label><input name="q"><p>{words(2, 12)}</p><button>{rng.choice(menu)}</button></form>',
        "related": lambda: wrap("related", links(2, 6), "div section aside nav", "related recommend share social tags"),
    }
    title = words(3, 10)
    short = rng.random() < 0.15
    article = (f"<h1>{title}</h1>" if rng.random() < 0.85 else "") + (paragraphs(1, 3, 1, 6) if short else paragraphs(1, 12, 4, 90))
    if rng.random() < 0.06:  # nothing but an article
        return f"<body data-y=1>{article}</body>" if rng.random() < 0.5 else f"<div data-y=1>{article}</div>"
    if rng.random() < 0.35:
        kind = rng.choice(["ad", "related", "form", "notice"])
        article += junk[kind]().replace(">", " data-y=0>", 1) + paragraphs(1, 4, 5, 70)
    article = wrap("article", article, "article article main div div section", "article content post entry story main text body", " data-y=1")
    before = [junk[k]() for k in rng.sample(["ad", "notice", "form", "related"], rng.randint(0, 2))]
    after = [junk[k]() for k in rng.sample(["ad", "side", "comments", "related", "form", "notice"], rng.randint(0, 3))]
    head = wrap("header", f"<h2>{rng.choice(menu)}</h2>" + (f"<p>{words(2, 8)}</p>" if rng.random() < 0.4 else ""), "header div div", "header head banner toolbar") if rng.random() < 0.6 else ""
    nav = wrap("nav", links(3, 9), "nav nav div", "nav menu breadcrumb") if rng.random() < 0.8 else ""
    foot = wrap("footer", f"&copy; {words(1, 15)}" + (links(2, 5) if rng.random() < 0.4 else ""), "footer footer div", "footer foot copyright legal") if rng.random() < 0.85 else ""
    middle = "".join([*before, article, *after])
    if rng.random() < 0.5:
        middle = wrap("wrap", middle, "div main section", "wrap container page row main content")
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{head}{nav}{middle}{foot}</body></html>"


class _Labelled(Page):
    """A layout whose elements keep their data-y mark."""

    def __init__(self, html: str):
        self.mark = [None]
        super().__init__(html)

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.mark.append(dict(attrs).get("data-y"))


def _labels(page: Page) -> np.ndarray:
    """1 inside the article, 0 elsewhere: by the marks of a layout, else by elements whose tags say so."""
    y, marks = np.zeros(len(page.tag)), getattr(page, "mark", None)
    for k in range(1, len(page.tag)):
        above, tag = y[page.parent[k]], page.tag[k]
        if marks is None:
            y[k] = 1.0 if tag == "article" else 0.0 if tag in SAYS_NO or tag in HIDDEN else above
        else:
            y[k] = float(marks[k]) if marks[k] is not None else above
    return y


def train(htmls: list[str], seed: int = 11) -> boosting.Boosted:
    rng = random.Random(seed)
    pages = [Page(h) for h in htmls]
    pages = [p for p in pages if "article" in p.tag]
    prose = [t for p in pages for k, t in p.pieces if len(t.split()) > 8 and "article" in _path(p, k)] or ["lorem ipsum dolor sit amet, consectetur. " * 20]
    menu = [t.strip() for p in pages for k, t in p.pieces if p.tag[k] == "a" and t.strip()] or ["Home", "About", "Contact"]
    pages += [_Labelled(_layout(rng, prose, menu)) for _ in range(LAYOUTS)]
    return boosting.fit(np.concatenate([features(p) for p in pages]), np.concatenate([_labels(p) for p in pages]))


def _path(page: Page, k: int) -> list[str]:
    out = []
    while k > 0:
        out.append(page.tag[k])
        k = page.parent[k]
    return out


# --- Spark ---


def fit(pages: DataFrame) -> bytes:
    """Train on the SAMPLE_PAGES pages that come first by a hash of their url and id, of at most SAMPLE_CHARS characters."""
    sample = pages.where(F.length("html") <= SAMPLE_CHARS).select("html", F.xxhash64("url", "page_id").alias("_order")).orderBy("_order", "html").limit(SAMPLE_PAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [pickle.dumps(train([h for b in batches for h in b["html"]]))]})

    rows = sample.coalesce(1).mapInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else pickle.dumps(train([]))


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null html is empty; a page without an article gives the empty text. Character references are
    decoded, white space runs become one blank, blocks are joined by one blank in page order. Repeated
    rows and null ids are pages like any other; an empty table gives an empty result; other columns
    are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(pages))  # TREES small trees

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        boosted, out = pickle.loads(model.value), []
        for start in range(0, len(htmls), 200):
            parsed = [Page(h) if h else None for h in htmls.iloc[start : start + 200]]
            tables = [features(p) for p in parsed if p]
            logits = iter(np.split(boosted.logit(np.concatenate(tables)), np.cumsum([len(t) for t in tables])[:-1]) if tables else [])
            out += [main_text(p, decode(p, next(logits))) if p else "" for p in parsed]
        return pd.Series(out, dtype=object)

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
