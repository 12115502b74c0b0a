"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

A page is parsed to its block elements.  Each gets features (tag, attribute tokens,
depth, text, link and tag density of its subtree, and how it stands among its
siblings), and the trees give the log-odds that it holds main text.  Decoding is
hierarchical: the best labelling in which nothing below a dropped element is kept,
found by one pass from the leaves up, so an ancestor and a descendant never
contradict each other.

The trees are trained here, on ``TRAIN_PAGES`` pages that a seeded generator draws
from page plans of many kinds with each element's label known; nothing of the data
is needed, so the model does not depend on the table it is applied to.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import lean, slices, texts

TRAIN_PAGES = 700
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select button".split())
#: Of these, those that without an end tag lose the start tag only, and those that may hold one another.
OPEN = frozenset("select button svg template noscript".split())
NESTED = frozenset(("svg", "template"))
#: Elements that are part of a block's text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Open elements that a start tag ends: itself by itself, a paragraph by any block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that end tags of others do not reach across.
WALLS = frozenset("table td th tr ul ol article section main body html div".split())
GOOD = re.compile(r"article|content|main|post|entry|body|story|text|prose|page|read")
BAD = re.compile(r"nav|menu|\bads?\b|advert|sponsor|banner|promo|foot|head(?:er)?\b|masthead|side|aside|comment|repl(?:y|ies)|disqus|cookie|consent|notice|alert|share|social|related|recommend|widget|form|popup|modal|subscribe|newsletter|bread|login|search|tag|toolbar|pagination|copyright|legal|disclaimer")
FEATURES = 34

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<close>>|\Z)|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"']+/\Z")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


@lru_cache
def _tags(name: str) -> re.Pattern:
    """Start and end tags of name, and what may hold tags that are none."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)(?=[\s/>]).*?(?:</(?P=raw)\b|\Z)|</(?P<end>{name})(?=[\s/>])[^>]*(?:>|\Z)"
        rf"|<(?P<start>{name})(?=[\s/>])(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>{name})(?=[\s/>])(?P<rest>[^>]*)>",
        re.S | re.I,
    )


def _self_closed(name: str, attrs: str) -> bool:
    return name == "svg" and attrs.endswith("/") and not _UNQUOTED.search(attrs)


def _ends(name: str, source: str) -> dict[int, int]:
    """Where each closed element of name in source starts, and the place after its own end tag."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _tags(name).finditer(source):
        if m["end"]:
            if open_:
                out[open_.pop()] = m.end()
        elif m["start"] or m["odd"]:
            if not _self_closed(name, m["attrs"] or m["rest"] or ""):
                if name not in NESTED:
                    open_.clear()  # a start tag ends an open one
                open_.append(m.start())
    return out


class Page:
    """The block elements of a page in page order, and its text in pieces between block edges.

    Text outside of all elements belongs to the body, an implied one where the page has none.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.attrs, self.parent, self.depth = ["#root"], [""], [-1], [0]
        self.own, self.link, self.marks = [0], [0], [0]  # characters of text, of linked text, inline tags
        self.pieces: list[tuple[int, str]] = []
        self._read(source.removeprefix("\ufeff"))

    def _read(self, source: str) -> None:
        stack, names = [0], ["#root"]
        at, size = 0, len(source)
        held: list[str] = []
        linked, anchors = 0, 0
        ends: dict[str, dict[int, int]] = {}
        body = implied = 0

        def enter(name: str, attrs: str) -> None:
            self.tag.append(name)
            self.attrs.append(attrs)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.own.append(0)
            self.link.append(0)
            self.marks.append(0)
            stack.append(len(self.tag) - 1)
            names.append(name)

        def close() -> None:
            nonlocal linked, body, implied
            if held:
                text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
                if text:
                    of = stack[-1] or body
                    if not of:
                        enter("body", "")
                        of = body = implied = stack[-1]
                        self.marks[of], self.marks[0] = self.marks[0], 0
                    self.pieces.append((of, text))
                    self.own[of] += len(text)
                    self.link[of] += min(linked, len(text))
                held.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            close()
            del stack[depth:], names[depth:]

        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                held.append(source[at:])
                if anchors:
                    linked += size - at
                break
            if m.start() > at:
                held.append(source[at : m.start()])
                if anchors:
                    linked += m.start() - at
            at = m.end()
            name = m["start"] or m["odd"]
            if name is not None:
                if not source.endswith(">", 0, at):
                    break  # a tag that the end of the page cut off
                name = name.lower()
                attrs = m["attrs"] if m["start"] else m["rest"]
                if name in RAW:
                    if name in OPEN:
                        if not _self_closed(name, attrs):
                            if name not in ends:
                                ends[name] = _ends(name, source)
                            at = ends[name].get(m.start(), at)
                        continue
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    if name in ("script", "style", "title", "textarea", "iframe") or end:
                        at = end.end() if end else size
                    continue
                if name in INLINE:
                    self.marks[stack[-1]] += 1
                    if name == "br":
                        held.append(" ")
                    anchors += name == "a"
                    continue
                close()
                if implied and name in ("html", "body") and stack == [0, implied]:
                    pop_to(1)
                    body = 0
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == "p" or names[k] in ENDS.get(name, ()):
                        pop_to(k)
                        break
                    if names[k] in WALLS:
                        break
                anchors = 0
                if name in VOID:
                    continue
                enter(name, " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower() if attrs else "")
                if name == "body" and not body:
                    body = stack[-1]
            elif m["end"] is not None:
                name = m["end"].lower()
                if name == "a":
                    anchors = max(0, anchors - 1)
                elif name not in INLINE and name in names:
                    k = len(names) - 1 - names[::-1].index(name)
                    if name in WALLS or not WALLS.intersection(names[k + 1 :]):
                        pop_to(k)
                        anchors = 0
        close()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        text, link, tags, paras, items, links = list(self.own), list(self.link), [1] * n, [t == "p" for t in self.tag], [t == "li" for t in self.tag], list(self.marks)
        children = [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            link[p] += link[i]
            tags[p] += tags[i]
            paras[p] += paras[i]
            items[p] += items[i]
            links[p] += links[i]
            children[p] += 1
        good = [len(GOOD.findall(a)) if a else 0 for a in self.attrs]
        bad = [len(BAD.findall(a)) if a else 0 for a in self.attrs]
        bad_tag = [t in _BAD_TAGS for t in self.tag]
        up_good, up_bad, up_tag = [0] * n, [0] * n, [0] * n
        index, seen = [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            up_good[i] = min(up_good[p] + (good[p] > 0 or self.tag[p] in ("article", "main")), 3)
            up_bad[i], up_tag[i] = min(up_bad[p] + (bad[p] > 0), 3), min(up_tag[p] + bad_tag[p], 3)
            index[i] = seen[p]
            seen[p] += 1
        whole = max(text[0], 1)
        column = lambda x: np.array(x, np.float64)
        up = np.maximum(column(parent).astype(np.int64), 0)
        t, own, ln, tg, ch = column(text), column(self.own), column(link), column(tags), column(children)
        kind = [_KINDS.get(x, 0) for x in self.tag]
        hot = np.zeros((n, 12))
        hot[np.arange(n), kind] = 1
        siblings = np.maximum(ch[up], 1)
        rest = np.stack(
            [
                column(self.depth), np.log1p(t), np.log1p(own), ln / np.maximum(t, 1), t / tg, column(paras), column(items) / tg, ch, column(links) / np.maximum(t, 1) * 100,
                column(good), column(bad), column(up_good), column(up_bad), column(up_tag), column(bad_tag), t / whole, t / np.maximum(t[up], 1), column(index) / siblings, siblings,
                (t[up] - own[up]) / siblings, np.array([x in ("article", "main") for x in self.tag], np.float64), ln[up] / np.maximum(t[up], 1),
            ],
            axis=1,
        )
        return np.concatenate([hot, rest], axis=1)

    def decode(self, margin: np.ndarray) -> str:
        """The text of the best labelling: each element weighs by its log-odds and its own text."""
        n = len(self.tag)
        gain = margin * (1 + np.log1p(np.array(self.own)))
        # kept: its gain and the best of its children; dropped with all below: what they would cost
        keep, drop = gain.tolist(), (-gain).tolist()
        for i in range(n - 1, 0, -1):
            keep[self.parent[i]] += max(keep[i], drop[i])
            drop[self.parent[i]] += drop[i]
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i] and self.tag[i] not in _NEVER
        return "\n".join([t for i, t in self.pieces if kept[i] and i])


_NEVER = frozenset("head nav form footer aside dialog menu object applet".split())
_BAD_TAGS = frozenset("nav footer header aside form head menu dialog fieldset".split())
_KINDS = {t: k + 1 for k, ts in enumerate(("article main", "section", "div center", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr td th", "figure figcaption picture", "html body #root", "nav footer header aside form head menu dialog fieldset")) for t in ts.split()}


class _Draw:
    """Draws pages from page plans; every element's label is known as it is written."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[bool] = []

    def words(self, a: int, b: int) -> str:
        n = self.r.randint(a, b)
        w = ["".join(self.r.choice("aeioustrnlmdpch") for _ in range(self.r.randint(1, 9))) for _ in range(n)]
        return " ".join(x + ("." if self.r.random() < 0.1 else "") for x in w).capitalize()

    def attr(self, names: str, plain: float = 0.15) -> str:
        if self.r.random() < plain:
            return ""
        name = self.r.choice(names.split())
        if self.r.random() < 0.3:
            name += self.r.choice(["-1", "-box", "-wrap", " clearfix", "_main2", " col"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def block(self, tag: str, label: bool, attrs: str, body, close: bool = True) -> None:
        self.out.append(f"<{tag}{attrs}>")
        self.labels.append(label)
        body() if callable(body) else self.out.append(body)
        if close:
            self.out.append(f"</{tag}>")

    def menu(self, n: int) -> None:
        def items() -> None:
            for _ in range(n):
                self.block("li", False, "", f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>')

        self.block(self.r.choice(["ul", "ul", "ol"]), False, "", items)

    def noise(self) -> None:
        r = self.r
        kind = r.randint(0, 9)
        if kind == 0:
            self.block(r.choice(["nav", "div", "nav"]), False, self.attr("nav menu navbar topnav breadcrumbs pagination", 0.2), lambda: self.menu(r.randint(3, 9)))
        elif kind in (1, 2):
            self.block(r.choice(["div", "div", "aside", "section"]), False, self.attr("ad ads advert banner sponsored promo ad-slot", 0.02), self.words(3, 40) if r.random() < 0.6 else lambda: self.block("p", False, "", self.words(4, 30)))
        elif kind == 3:
            self.block(r.choice(["aside", "div", "aside"]), False, self.attr("sidebar side related widget recommended", 0.05), lambda: (self.block("h3", False, "", self.words(1, 4)), self.menu(r.randint(2, 6)) if r.random() < 0.6 else self.block("p", False, "", self.words(5, 40))))
        elif kind == 4:
            self.block("form", False, self.attr("newsletter subscribe search login", 0.4), lambda: self.block(r.choice(["p", "div", "label"]) if r.random() < 0.7 else "fieldset", False, "", self.words(2, 12)) if r.random() < 0.8 else self.out.append('<input name="q">'))
        elif kind == 5:
            self.block(r.choice(["div", "section", "div"]), False, self.attr("notice cookie-notice cookie consent alert gdpr-notice", 0.02), lambda: self.block("p", False, "", self.words(6, 35)) if r.random() < 0.6 else self.out.append(self.words(6, 35)))
        elif kind in (6, 7):

            def replies() -> None:
                if r.random() < 0.5:
                    self.block(r.choice(["h2", "h3"]), False, "", "Comments")
                for _ in range(r.randint(1, 6)):
                    self.block(r.choice(["div", "li", "div", "article"]), False, self.attr("comment reply comment-body", 0.15), lambda: [self.block("p", False, "", self.words(3, 60)) for _ in range(r.randint(1, 2))])

            self.block(r.choice(["section", "div", "ol", "div"]), False, self.attr("comments replies comment-list disqus reader-comments", 0.02), replies)
        elif kind == 8:
            self.block("div", False, self.attr("share social share-buttons tags related-links", 0.05), lambda: self.menu(r.randint(2, 5)) if r.random() < 0.5 else self.out.append(" ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(3))))
        else:
            self.block(r.choice(["div", "aside"]), False, self.attr("popup modal newsletter subscribe disclaimer copyright legal", 0.02), lambda: [self.block("p", False, "", self.words(3, 20)) for _ in range(r.randint(1, 2))])

    def story(self) -> None:
        r = self.r
        if r.random() < 0.8:
            self.block(r.choice(["h1", "h1", "h2"]), True, "", self.words(3, 12))
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.62:
                body = self.words(*r.choice([(1, 4), (5, 30), (20, 120), (60, 200)]))
                if r.random() < 0.2:
                    body = body.replace(" ", f' <a href="/x">{self.words(1, 3)}</a> ', 1)
                if r.random() < 0.15:
                    self.block("p", True, "", f"<b>{body}<br>", close=False)
                else:
                    self.block("p", True, self.attr("text lead intro", 0.9), body, close=r.random() > 0.05)
            elif kind < 0.7:
                self.block(r.choice(["h2", "h3", "h4"]), True, "", self.words(1, 7))
            elif kind < 0.78:
                self.block(r.choice(["ul", "ol"]), True, "", lambda: [self.block("li", True, "", self.words(2, 20)) for _ in range(r.randint(2, 6))])
            elif kind < 0.84:
                self.block("blockquote", True, "", self.words(5, 40) if r.random() < 0.5 else lambda: self.block("p", True, "", self.words(5, 40)))
            elif kind < 0.88:
                self.block(r.choice(["div", "section"]), True, self.attr("section text part content", 0.5), lambda: [self.block("p", True, "", self.words(5, 80)) for _ in range(r.randint(1, 4))])
            elif kind < 0.91:
                self.block("table", True, "", lambda: [self.block("tr", True, "", lambda: [self.block("td", True, "", self.words(1, 4)) for _ in range(3)]) for _ in range(r.randint(2, 5))])
            elif kind < 0.93:
                self.block("pre", True, "", self.words(5, 40))
            else:
                self.noise()

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.out, self.labels = ["<!DOCTYPE html>"], [True]
        holder = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        names = "content article post entry main-content story post-body article-body page-content"

        def inner() -> None:
            self.story()
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                self.noise()

        def middle() -> None:
            if holder == "td":
                self.block("table", True, "", lambda: self.block("tr", True, "", lambda: (self.block("td", False, "", lambda: self.menu(5)), self.block("td", True, self.attr(names, 0.5), inner))))
            else:
                self.block(holder, True, self.attr(names, 0.75 if holder in ("article", "main") else 0.1), inner)
            for _ in range(r.choice([0, 0, 1, 2])):
                self.noise()

        def body() -> None:
            if r.random() < 0.6:
                self.block(r.choice(["header", "div"]), False, self.attr("header masthead site-header top", 0.1), lambda: (self.block(r.choice(["h1", "p", "div"]), False, "", self.words(1, 5)), self.menu(r.randint(2, 6)) if r.random() < 0.4 else None))
            if r.random() < 0.8:
                self.block(r.choice(["nav", "nav", "div"]), False, self.attr("nav menu navbar", 0.5), lambda: self.menu(r.randint(3, 9)))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                self.noise()
            if r.random() < 0.4:
                self.block(r.choice(["div", "main", "section"]), True, self.attr("wrapper container page main layout row", 0.3), middle)
            else:
                middle()
            for _ in range(r.choice([0, 0, 1, 2])):
                self.noise()
            if r.random() < 0.9:
                self.block(r.choice(["footer", "footer", "div"]), False, self.attr("footer site-footer bottom copyright", 0.3), f"&copy; {self.words(1, 6)} &middot; {self.words(2, 14)}" if r.random() < 0.6 else lambda: (self.block("p", False, "", self.words(3, 14)), self.menu(3)))

        self.out.append("<html>")
        self.labels.append(True)
        if r.random() < 0.9:
            self.block("head", False, "", "<title>x</title>")
        self.block("body", True, "", body)
        if r.random() < 0.9:
            self.out.append("</html>")
        return "".join(self.out), self.labels


@lru_cache
def model(pages: int = TRAIN_PAGES, seed: int = 5) -> boosting.Forest:
    """The trees, trained on drawn pages; deterministic, once a process."""
    draw = _Draw(seed)
    x, y = [], []
    for _ in range(pages):
        source, labels = draw.page()
        page = Page(source)
        if len(page.tag) == len(labels):
            x.append(page.features())
            y.append(labels)
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(np.float64))


def extract(sources: list[str], forest: boosting.Forest) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    parts = [p.features() for p in pages]
    margin = forest.margin(np.concatenate(parts)) if parts else np.empty(0)
    edge = np.cumsum([len(p) for p in parts])[:-1] if parts else []
    return [p.decode(m) for p, m in zip(pages, np.split(margin, edge))]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Null and empty html give an empty text, never null.  A page cut off in a tag loses
    that tag only.  Repeated rows and null ids stay; other columns are ignored.
    """
    forest = model()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = extract([t.decode("utf-8", "replace") for t in texts(batch, "text")], forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html as text").mapInArrow(run, "page_id long, url string, text string, n_chars long")
