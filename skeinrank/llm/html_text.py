"""HTML extraction: a tree-structured graphical model over the DOM.

Each block element is a node with two states, content and other. A node's potential comes
from what it is (tag, class words, length, share of links, its share of the page's text and
what it stands in), a parent-child potential ties it to the block it stands in. Sum-product messages go upward and then downward, which gives
the exact marginals of the tree; a block whose marginal of content is at least one half
is text. Weights are fitted by exact likelihood gradients (the same messages) on labelled
pages, which `labelled_pages` composes from a seed in many layouts. Their class words come
from lists of their own, are often made up or missing, and stand in articles, too; so a word
is evidence among others. Some pages are plain text, or have a single block.

Scripts, styles, forms' controls and the head never count as text. White space within a
block becomes one space (a line break counts as white space), blocks are trimmed and joined
in page order by one newline.

Edge cases: null and empty pages have an empty text; so has a page without any content
block; broken markup (unclosed or crossed tags, stray ends) is read as a browser would for
paragraphs and list items, else an end closes what it can; repeated pages give equal rows;
other columns are ignored. A page is one row's work, whatever its length or depth.
"""

from __future__ import annotations

import functools
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Element names of the HTML standard, and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template title textarea select option button svg iframe canvas".split())
#: What may stand in a head; anything else ends it, tags left out or not.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
BLOCK = frozenset(
    "html body article main section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption address fieldset details summary dialog menu center hgroup search".split()
)
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table menu".split())
TAGS = ["main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "p", "heading", "list", "item", "table", "cell", "quote", "figure", "dialog", "address", "other"]
KIND = {
    "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table",
    "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "search": "form", "hgroup": "heading", **{f"h{i}": "heading" for i in range(1, 7)},
}
NAMED = {
    "advert": "ad ads advert advertisement adverts banner sponsor sponsored promo promotion promoted adsense",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar pagination pager skip",
    "edge": "header footer masthead foot head colophon copyright legal bottom top",
    "side": "sidebar aside widget widgets related recommended popular trending rail share social tags more",
    "comment": "comment comments reply replies discussion disqus respond commentlist thread reader readers",
    "notice": "cookie cookies consent notice notification popup modal overlay alert newsletter subscribe subscription signup login paywall gdpr message",
    "content": "content article post entry story body main text prose page",
}
WORDS = {w: k for k, ws in NAMED.items() for w in ws.split()}
FEATURES = [
    *(f"tag {t}" for t in TAGS), *(f"named {k}" for k in NAMED), *(f"within {k}" for k in NAMED), "empty", "short", "long", "very long", "links", "stop", "most of the page", "some of the page", "in main", "beside main", "in an aside", "the only text", "root", "bias",
]
PLACE = {f: i for i, f in enumerate(FEATURES)}


@functools.lru_cache(100_000)
def _kinds(word: str) -> frozenset[str]:
    """What a class word stands for: itself, or a listed word of four letters or more that it begins or ends with."""
    if word in WORDS:
        return frozenset([WORDS[word]])
    parts = (word[:i] for i in range(4, len(word))), (word[i:] for i in range(1, len(word) - 3))
    return frozenset(WORDS[p] for own in parts for p in own if p in WORDS)


class _Tree(HTMLParser):
    """Block elements in page order: parent, kind, class words, and the text that stands in each between other blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.names, self.chars, self.linked = [-1], ["other"], [set()], [0], [0]
        self.open: list[tuple[str, int]] = [("", 0)]  # (element, its block)
        self.places: dict[str, list[int]] = {}  # of each element's name, where it is open
        self.runs: list[tuple[int, str]] = []  # (block, text), in page order
        self.run: list[str] = []
        self.hidden = self.links = 0

    def flush(self):
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.runs.append((self.open[-1][1], text))
                self.chars[self.open[-1][1]] += len(text)

    def pop(self, at: int):
        """Close open elements from place `at` on."""
        for tag, _ in reversed(self.open[at:]):
            if tag in BLOCK:
                self.flush()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.places[tag].pop()
            self.open.pop()

    def last(self, tags, until=()):
        """The innermost open element of `tags`, if none of `until` is within it; a constant's work at any depth."""
        inner = lambda names: max((at[-1] for n in names if (at := self.places.get(n))), default=0)
        at = inner(tags)
        return at if at >= inner(until) else 0

    def end_head(self):
        if self.open[-1][0] == "head":
            self.pop(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not self.hidden:
                self.run.append("" if tag == "wbr" else " ")
            return
        if tag in CLOSES_P and (at := self.last({"p"}, SCOPE | {"article", "main", "td", "th"})):
            self.pop(at)
        if tag in SAME and (at := self.last(SAME[tag], SCOPE)):
            self.pop(at)
        if tag == "body" and (at := self.last({"head"})):
            self.pop(at)
        block = self.open[-1][1]
        if tag in BLOCK:
            self.flush()
            given = dict(attrs)
            words = set(re.findall(r"[a-z]+", " ".join(str(given.get(k) or "") for k in ("class", "id", "role", "aria-label")).lower()))
            self.parent.append(block)
            self.kind.append(KIND.get(tag, tag if tag in TAGS else "other"))
            self.names.append(set().union(*map(_kinds, words)))
            self.chars.append(0)
            self.linked.append(0)
            block = len(self.parent) - 1
            if "hidden" in given or "display:none" in str(given.get("style") or "").replace(" ", ""):
                self.names[-1].add("notice")
        self.hidden += tag in HIDDEN
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, block))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br" and not self.hidden:
            self.run.append(" ")
        elif at := self.last({tag}):
            self.pop(at)

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.run.append(data)
            if self.links:
                self.linked[self.open[-1][1]] += len(data.strip())

    def finish(self):
        self.close()
        self.pop(1)
        self.flush()
        return self


def read(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    return tree.finish()


ASIDE = {"nav", "footer", "aside", "header", "form", "dialog"}


def features(tree: _Tree) -> np.ndarray:
    n = len(tree.parent)
    x = np.zeros((n, len(FEATURES)))
    last = {b: t for b, t in tree.runs}
    below = list(tree.chars)
    for i in range(n - 1, 0, -1):
        below[tree.parent[i]] += below[i]
    inside, beside, total = [False] * n, [False] * n, max(1, below[0])
    within: list[set] = [set()] * n
    holds = [k in ("main", "article") for k in tree.kind]
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i]
    for i in range(n):
        row, kind, chars = x[i], tree.kind[i], tree.chars[i]
        row[PLACE[f"tag {kind}"]] = 1
        for k in tree.names[i]:
            row[PLACE[f"named {k}"]] = 1
        row[PLACE["empty" if chars == 0 else "short" if chars < 40 else "long" if chars < 200 else "very long"]] = 1
        row[PLACE["links"]] = tree.linked[i] > 0.5 * chars > 0
        row[PLACE["stop"]] = i in last and last[i][-1] in ".!?…\"”»"
        row[PLACE["most of the page"]] = below[i] > 0.5 * total
        row[PLACE["some of the page"]] = below[i] > 0.1 * total
        row[PLACE["the only text"]] = chars > 0.9 * total
        if i:
            over = tree.parent[i]
            within[i] = within[over] | tree.names[over]
            for k in within[i]:
                row[PLACE[f"within {k}"]] = 1
            inside[i] = inside[over] or tree.kind[over] in ("main", "article")
            beside[i] = beside[over] or tree.kind[over] in ASIDE
        row[PLACE["beside main"]] = holds[0] and not inside[i] and not holds[i]
        row[PLACE["in main"]], row[PLACE["in an aside"]], row[PLACE["root"]] = inside[i], beside[i], i == 0
    x[:, PLACE["bias"]] = 1
    return x


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class TreeModel:
    """Weights of the node features and the table of parent-child potentials [parent, child]."""

    def __init__(self, weights: np.ndarray, table: np.ndarray):
        self.weights, self.table = weights, table

    def beliefs(self, parent: list[int], x: np.ndarray):
        """(marginal of content of each node, pair beliefs [node, parent state, own state]) by upward and downward messages."""
        n = len(parent)
        own = [[0.0, v] for v in (x @ self.weights).tolist()]  # what each block and all below it say of its two states
        (t00, t01), (t10, t11) = self.table.tolist()
        up: list = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = own[i]
            m0, m1 = _lse(a + t00, b + t01), _lse(a + t10, b + t11)
            low = max(m0, m1)
            up[i] = m0, m1 = m0 - low, m1 - low
            over = own[parent[i]]
            over[0] += m0
            over[1] += m1
        down: list = [(0.0, 0.0)] * n
        content, pair = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        content[0] = 1 / (1 + math.exp(min(max(own[0][0] - own[0][1], -500), 500)))
        for i in range(1, n):
            p, (a, b) = parent[i], own[i]
            # the parent's belief without this child's message is what came down, less that message
            q0, q1 = own[p][0] + down[p][0] - up[i][0], own[p][1] + down[p][1] - up[i][1]
            cells = (q0 + t00 + a, q0 + t01 + b, q1 + t10 + a, q1 + t11 + b)
            low = max(cells)
            c0, c1, c2, c3 = (math.exp(c - low) for c in cells)
            total = c0 + c1 + c2 + c3
            pair[i] = (c0 / total, c1 / total, c2 / total, c3 / total)
            content[i] = (c1 + c3) / total
            d0, d1 = _lse(q0 + t00, q1 + t10), _lse(q0 + t01, q1 + t11)
            low = max(d0, d1)
            down[i] = (d0 - low, d1 - low)
        return np.array(content), np.array(pair).reshape(n, 2, 2)

    def text(self, html: str | None) -> str:
        tree = read(html)
        if not tree.runs:
            return ""
        content, _ = self.beliefs(tree.parent, features(tree))
        return "\n".join(t for b, t in tree.runs if content[b] >= 0.5)


def fit(pages: list[tuple[str, set[str]]], steps: int = 120) -> TreeModel:
    """From (html, the texts that are content): a block is content if a run in it is, or a block within it."""
    data = []
    for html, wanted in pages:
        tree = read(html)
        y = np.zeros(len(tree.parent), int)
        for b, t in tree.runs:
            y[b] |= t in wanted
        for i in range(len(y) - 1, 0, -1):
            if tree.kind[i] not in ASIDE and tree.parent[i]:  # the root is content by its own text only
                y[tree.parent[i]] |= y[i]
        data.append((tree.parent, features(tree), y))
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    square = [np.full(len(FEATURES), 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(steps):
        gw, gt = -0.02 * model.weights, -0.02 * model.table
        for parent, x, y in data:
            content, pair = model.beliefs(parent, x)
            gw = gw + (y - content) @ x
            np.add.at(gt, (y[parent[1:]], y[1:]), 1)
            gt = gt - pair[1:].sum(0)
        for s, g in zip(square, (gw, gt)):
            s += g * g
        model.weights = model.weights + 0.5 * gw / np.sqrt(square[0])
        model.table = model.table + 0.5 * gt / np.sqrt(square[1])
    return model


# Class words of the labelled pages, by what they stand for; they are not the features' lists.
CLASSES = {
    "menu": "navigation nav-primary site-nav menu-item mainmenu nav-links breadcrumb-trail pager tabs", "edge": "site-header page-footer footer-bottom masthead-wrap copyright-note brand-bar header-top",
    "side": "sidebar-right widget-area related-posts recommended-box most-read tag-list share-buttons aside-block", "advert": "ad-slot advert-box banner-top sponsored-content promo-card adsense-unit ad ads",
    "notice": "cookie-banner consent-layer newsletter-box alert-info modal-body popup-wrap signup-form paywall-hint", "comment": "comments-area comment-list reply-thread discussion-box reader-comments respond-form",
    "content": "post-content article-body entry-content story-text main-column prose-block legal-text page-top section-body message-text content",
}


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages in many layouts, with the texts of their articles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))

    def sentence(lo=4, hi=18):
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice(["", ".", ".", "!"])

    def prose(k):
        return " ".join(sentence().rstrip(".!") + "." for _ in range(rng.randint(1, k)))

    def links(k):
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, k)))

    def named(kind, told=0.75):
        """A class or id: of its kind, made up, or none (only where the element tells what it is)."""
        k = rng.random()
        if k < told:
            return f' {rng.choice(["class", "class", "id"])}="{rng.choice(CLASSES[kind].split())}{rng.choice(["", "", f" {word()}", f"-{rng.randint(1, 9)}"])}"'
        return f' class="{word()}"' if k < told + 0.15 else ""

    def stray():
        """A class in an article: mostly none, else of any kind."""
        return named(rng.choice(list(CLASSES)), 1.0) if rng.random() < 0.12 else ""

    def part(kind):
        return rng.choice({
            "menu": [f"<nav{named('menu', 0.3)}><ul>{links(8)}</ul></nav>", f"<div{named('menu', 1.0)}><ul>{links(6)}</ul></div>", f"<ul{named('menu', 1.0)}>{links(5)}</ul>", f"<nav>{word()} <a href=/>{word()}</a></nav>"],
            "header": [f"<header><p>{sentence()}</p><div>{word()}</div></header>", f"<div{named('edge', 1.0)}><p>{sentence()}</p></div>", f"<header{named('edge', 0.3)}><h2>{sentence(1, 4)}</h2></header>"],
            "footer": [f"<footer>&copy; {word()}.com &middot; {prose(3)}</footer>", f"<div{named('edge', 1.0)}><p>{prose(2)}</p></div>", f"<footer><p>{sentence()}</p><ul>{links(4)}</ul></footer>"],
            "side": [f"<aside{named('side', 0.4)}><h3>{sentence(1, 4)}</h3><p>{prose(3)}</p></aside>", f"<div{named('side', 1.0)}><h3>{word()}</h3><ul>{links(6)}</ul><p>{prose(2)}</p></div>", f"<aside>{prose(3)}</aside>"],
            "advert": [f"<div{named('advert', 1.0)}>{prose(3)}</div>", f"<div{named('advert', 1.0)}><p>{prose(2)}</p></div>", f"<section{named('advert', 1.0)}><h4>{sentence(1, 4)}</h4><p>{prose(2)}</p></section>"],
            "notice": [f"<div{named('notice', 1.0)}><p>{prose(2)}</p></div>", f"<div{named('notice', 1.0)}>{prose(2)}</div>", f"<dialog><p>{prose(1)}</p></dialog>"],
            "form": [f"<form><label>{word()}</label><input name=q><button>{word()}</button></form>", f"<form action=/><p>{sentence()}</p><textarea>{word()}</textarea></form>"],
            "comment": [
                f"<div{named('comment', 1.0)}><h3>{word()}</h3><div><p>{prose(3)}</p></div><div><p>{prose(2)}</p></div></div>", f"<section{named('comment', 1.0)}><p>{prose(4)}</p></section>", f"<ol{named('comment', 1.0)}><li><p>{prose(3)}</p></li><li>{prose(2)}</li></ol>",
            ],
        }[kind])

    def some(*kinds):
        return "".join(part(k) for k in kinds if rng.random() < 0.5)

    out = []
    for _ in range(n):
        wanted: set[str] = set()

        def keep(text):
            wanted.add(" ".join(text.split()))
            return text

        if rng.random() < 0.12:  # hardly any markup: plain or loose text, or a single block
            body = keep(prose(rng.choice([1, 2, 8])))
            shape = rng.choice(["%s", "<span>%s</span>", "<div>%s</div>", "<p>%s</p>", "<b>%s", f"<div{stray()}>%s</div>", "<main>%s</main>", "<pre>%s</pre>"]) % body
            around = rng.choice(["%s", "<body>%s</body>", f"<html><head><title>{word()}</title></head><body>%s</body></html>"])
            more = some("menu", "footer") if shape != body and rng.random() < 0.4 else ""
            out.append((around % (shape + more), wanted))
            continue
        blocks = [f"<h1{stray()}>{keep(sentence(2, 9))}</h1>"] if rng.random() < 0.85 else []
        tiny = rng.random() < 0.25  # an article of hardly any text
        if tiny:
            blocks.append(f"<p>{keep(sentence(1, 9).rstrip('.!') + rng.choice(['', ' |', '##']))}" + rng.choice(["</p>", ""]))
        for _ in range(0 if tiny else rng.randint(1, 9)):
            k = rng.random()
            if k < 0.5:
                blocks.append(f"<p{stray()}>{keep(prose(6))}</p>")
            elif k < 0.55:
                blocks.append(f"<section{stray()}><h2>{keep(sentence(1, 6))}</h2><p{stray()}>{keep(prose(4))}</p></section>")
            elif k < 0.62:
                blocks.append(f"<p><b>{keep(sentence(3, 12))}<br>")
            elif k < 0.7:
                blocks.append(f"<h{(h := rng.randint(2, 4))}>{keep(sentence(1, 6))}</h{h}>")
            elif k < 0.77:
                blocks.append("<ul>" + "".join(f"<li>{keep(sentence(3, 14))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif k < 0.83:
                blocks.append(f"<blockquote><p>{keep(prose(2))}</p></blockquote>")
            elif k < 0.88:
                blocks.append("<table>" + "".join(f"<tr><td>{keep(sentence(1, 4))}</td><td>{keep(sentence(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
            elif k < 0.92:
                blocks.append(f"<p>{keep(sentence(1, 9).rstrip('.!'))}</p>")
            else:
                blocks.append(part(rng.choice(["advert", "side", "notice", "form"])))
        body = "".join(blocks)
        shell = rng.choice([
            "<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", f"<div{named('content')}>%s</div>", f"<div id=main><div{named('content', 0.6)}>%s</div></div>",
            f"<article{named('content')}><div{named('content', 0.5)}>%s</div></article>", f"<div class=page><section{named('content')}>%s</section></div>", f"<main><section{named('content', 0.9)}>%s</section></main>",
        ])
        # an article may hold the readers' comments, too
        inner = body + (part("comment") if rng.random() < 0.15 else "")
        page = some("notice", "header", "menu", "advert", "menu") + shell % inner + some("side", "comment", "advert", "form", "notice") + part("footer")
        if rng.random() < 0.05:
            out.append((shell % body, wanted))
            continue
        out.append((f'<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{page}</body></html>', wanted))
    return out


_fitted: list[TreeModel] = []


def default_model() -> TreeModel:
    """Fitted once a process, on the driver; its few dozen weights are sent to the tasks."""
    if not _fitted:
        _fitted.append(fit(labelled_pages()))
    return _fitted[0]


def extract(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` and the text of each page."""
    model = model or default_model()
    carried = [f for n in keep for f in pages.schema.fields if f.name == n]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in carried), pa.array([model.text(h.as_py()) for h in batch["__html"]], pa.string())], [*(f.name for f in carried), "text"])

    source = pages.select(*(F.col(f"`{f.name}`") for f in carried), F.col(f"`{html_col}`").alias("__html"))
    return source.mapInArrow(run, T.StructType([*carried, T.StructField("text", T.StringType())]))
