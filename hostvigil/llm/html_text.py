"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of the page becomes a line, and over the lines runs a window of WINDOW lines.
Where the window's sum of weights exceeds the page's threshold the text surges, and it goes on until a window of weight
zero, where it dives. The weighted lines between surges and dives are the text.

A line weighs its length. Structure only changes weights: lines of the page's <article> or <main> weigh SURGE more, so
that its short lines surge too; text in containers that hold no article text (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) weighs nothing, nor does text outside of <article> or <main> on pages that
have one, nor lines elsewhere that are mostly links. A container is known by its element, its role or a whole class or
id such as 'sidebar' or 'site-footer' ('no-sidebar' says nothing). <article> and <main> never go by their names, nor by
those of what they stand in; inside of them paragraphs, headings, captions and the like go by names of adverts and
comments only, and a container whose name may be a subject (search, discussion, social, ...) loses only lists of links.
The threshold is SHARE of the heaviest window (SURGE at most). Without <article> or <main>, a container that holds a
paragraph found so keeps its other lines too, such as a title above a share bar, a short end after an advert, or a
paragraph that is a link as a whole.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by one space;
nothing else is dropped. The time is linear in the page's size, broken markup included: a tag without an end is text
up to the next '<'. Null html gives an empty text. Each row is a page of its own, repeated or not; columns beside
page_id, url and html may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hostvigil.llm.common import only, read_table, row_chunks

WINDOW = 3
SURGE = 60
SHARE = 0.05
LINK_SHARE = 0.6
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemtype|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Elements whose content is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "option", "button", "title", "canvas", "audio", "video", "annotation", "annotation-xml"}
_RAW_END = {"script", "style", "textarea", "title", "iframe", "noscript"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_HEADER = {"header"}
_MAIN = {"article", "main"}
_INLINE = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "semantics", "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold running text; often left open, they hold no state unless named.
_TEXT = {"p", "li", "td", "tr", "th", "dt", "dd"}
_PROSE = _TEXT | {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "span", "label", "caption", "table", "tbody", "dl", "address"}
_NAMES = (
    r"ad|ads|adv|advert[^\W_]*|adsense|sponsor[^\W_]*|promo[^\W_]*|banner|sidebar|side|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|footer|foot|header|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommend[^\W_]*|comments?|respond|replies|reply|discussion|disqus|tags|copyright|legal|skip|hidden|complementary|contentinfo"
)
#: Words that may stand beside a name in one class or id: where it is and what it is made of, never whether the page has it.
_BESIDE = r"site|page|global|main|primary|secondary|left|right|top|bottom|upper|lower|post|entry|div|area|section|container|wrapper|wrap|box|block|bar|list|form|links?|body|inner|slot|unit|\d+"
#: Names of containers that may as well be what a part of an article is about.
_TOPICS = r"side|head|foot|alert|search|share|sharing|social|related|recommend[^\W_]*|discussion|tags|copyright|legal|subscription"
_WORD, _NAMED, _TOPIC = (re.compile(x, re.I) for x in (rf"{_NAMES}|{_BESIDE}", _NAMES, _TOPICS))
#: Names that hold for paragraphs inside of an article too.
_STRONG = re.compile(r"ad|ads|adv|advert[^\W_]*|adsense|sponsor[^\W_]*|promo[^\W_]*|comments?|respond|replies|reply|disqus|cookies?|newsletter", re.I)
_COMMENTS = re.compile(r"comment|respond|repl(?:y|ies)|discussion|disqus", re.I)
_OUT = ("out", "comments")
#: Elements that are no container of their own.
_NO_HOME = _PROSE | {"html", "body", "ul", "ol"}
#: Elements that hold no article text even if they hold an <article>.
_CLOSED = ("nav", "aside", "footer", "form")
#: Elements whose text is a paragraph, though it may be a link as a whole.
_PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "dd"}


def _says(name: str, tag: str, in_main: bool) -> str:
    """What a class or id says of its container: 'comments', 'out', 'maybe' (out where it is mostly links), or ''."""
    words = re.split(r"[_-]+", name.rstrip("_-"))
    if not all(map(_WORD.fullmatch, words)):
        return ""
    named = [w for w in words if _NAMED.fullmatch(w)]
    if not named or (in_main and tag in _PROSE and not any(map(_STRONG.fullmatch, named))):
        return ""
    if in_main and tag not in _MAIN and all(map(_TOPIC.fullmatch, named)):
        return "maybe"
    return "comments" if _COMMENTS.search(name) else "out"


def _kind(tag: str, attributes: str, in_main: bool) -> str:
    """What a container holds: 'out' (no article text), 'comments' (of readers), 'main', 'maybe' (no lists of links), or '' (as its parent)."""
    found = ""
    if tag in _BOILERPLATE or (tag in _HEADER and not in_main):
        return "out"
    if tag not in ("html", "body") and attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for name in m[2].strip("\"'").split():
                kind = _says(name, tag, in_main)
                if kind == "maybe":
                    found = kind
                elif kind and (tag not in _MAIN or (kind == "comments" and in_main)):  # an article in an article may be a comment on it
                    return kind
                if m[1].lower() == "role" and name.lower() in ("form", "dialog") and tag not in _MAIN:
                    return "out"
    return "main" if tag in _MAIN else found


class Open:
    """The elements that are open, with what they say of the text inside of them."""

    def __init__(self):
        # tag, kind, and of the text inside: may be article text, in <article> or <main>, closed to it, no lists of links, its container's number
        self.stack: list[tuple[str, str, bool, bool, bool, bool, int]] = []
        self.count: dict[str, int] = {}
        self.containers = 0

    def push(self, tag: str, kind: str) -> None:
        _, _, ok, main, closed, maybe, home = self.stack[-1] if self.stack else ("", "", True, False, False, False, 0)
        if tag not in _NO_HOME:
            self.containers += 1
            home = self.containers
        # a container that an <article> stands in, or that was left open before it, doesn't swallow it
        ok, closed = kind == "main" or (ok and kind not in _OUT), closed or kind == "comments" or (kind == "out" and tag in _CLOSED)
        self.stack.append((tag, kind, ok, main or kind == "main", closed, kind != "main" and (maybe or kind == "maybe"), home))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> tuple[str, str]:
        tag, kind, *_ = self.stack.pop()
        self.count[tag] -= 1
        return tag, kind

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def state(self) -> tuple[bool, bool, bool, int]:
        """Whether text here may be article text, whether it stands in <article> or <main>, whether lists of links are none
        of it, and the number of its container (0: the page)."""
        if not self.stack:
            return True, False, False, 0
        _, _, ok, main, closed, maybe, home = self.stack[-1]
        return ok and not closed, main, maybe, home


class Tags:
    """Tokens of a page: (text before, closing, tag, attributes), in time linear in its size."""

    def __init__(self, page: str):
        self.page, self.at, self.quoted, self.ended = page, 0, True, set()

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        page, size, begin = self.page, len(self.page), 0
        while True:
            begin = max(begin, self.at)
            start = page.find("<", begin)
            if start < 0 or start + 1 >= size:
                break
            after = page[start + 1]
            if after in "!?":
                comment = page.startswith("<!--", start)
                end = page.find("-->" if comment else ">", start + 4 if comment else start)
                end = size if end < 0 else end + (3 if comment else 1)
                text, self.at = page[self.at : start], end
                yield text, False, "", ""
                continue
            if not (after.isascii() and after.isalpha()) and not (after == "/" and page[start + 2 : start + 3].isalpha()):
                begin = start + 1  # a sign, no tag
                continue
            m = _TAG.match(page, start) if self.quoted else None
            if m:
                end, closing, tag, attributes = m.end(), bool(m[1]), m[2], m[3]
            else:
                self.quoted = False  # a quote or tag without an end: from here on a tag ends at the next '>'
                end = page.find(">", start) + 1
                if not end:
                    break
                cut = page.rfind("<", start, end)
                if cut > start:  # this one has no end, but a later one has
                    begin = cut
                    continue
                closing = after == "/"
                tag, _, attributes = page[start + 1 + closing : end - 1].partition(" ")
            text, self.at = page[self.at : start], end
            yield text, closing, tag.rstrip("/").lower(), attributes
        if self.at < size:  # what follows the last tag, without a tag that never ends
            rest = page[self.at :]
            cut = re.search(r"<[/a-zA-Z!]", rest)
            yield rest[: cut.start()] if cut else rest, False, "", ""
            self.at = size

    def skip(self, tag: str, all_: bool) -> None:
        """Go on after the element's end; without one, after the page's (`all_`) or right here."""
        if tag not in self.ended:
            end = re.compile(rf"</{re.escape(tag)}\b[^<>]*+>", re.I).search(self.page, self.at)
            if end:
                self.at = end.end()
                return
            self.ended.add(tag)
        if all_:
            self.at = len(self.page)


class Line(NamedTuple):
    text: str
    ok: bool  # may be article text
    main: bool  # stands in <article> or <main>
    links: bool  # mostly links
    paragraph: bool
    home: int  # its container


def lines(page: str) -> list[Line]:
    """Blocks in page order."""
    out: list[Line] = []
    open_, text, links, anchors, opener = Open(), [], 0, 0, ""

    def flush() -> None:
        nonlocal links
        t = " ".join("".join(text).split())
        if t:
            ok, main, maybe, home = open_.state()
            linked = links > LINK_SHARE * len(t)
            out.append(Line(t, ok and not (maybe and linked), main, linked, opener in _PARAGRAPH, home))
        text.clear()
        links = 0

    tags = Tags(page)
    for raw, closing, tag, attributes in tags:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            links += len(t) if anchors else 0
        if not tag:
            continue
        if tag in _SILENT and not closing:
            if tag in _RAW_END or not attributes.rstrip().endswith("/"):
                tags.skip(tag, tag in _RAW_END)
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
        if tag in ("span", "label"):  # inline, but may be named
            if not closing:
                kind = _kind(tag, attributes, open_.state()[1])
                if kind in _OUT:
                    flush()
                open_.push(tag, "out" if kind in _OUT else "")
            elif open_.has(tag):
                while True:
                    if open_.stack[-1][1] in _OUT:
                        flush()
                    if open_.pop()[0] == tag:
                        break
            continue
        if tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        opener = "" if closing else tag
        if tag in _TEXT:
            if closing:
                if open_.stack and open_.stack[-1][0] == tag:
                    open_.pop()
            elif (kind := _kind(tag, attributes, open_.state()[1])) in _OUT:
                open_.push(tag, kind)
            continue
        if closing:
            if open_.has(tag):
                while open_.pop()[0] != tag:
                    pass
            if tag in _MAIN:
                anchors = 0
            continue
        if not attributes.rstrip().endswith("/"):
            open_.push(tag, _kind(tag, attributes, open_.state()[1]))
    flush()
    return out


def weights(blocks: list[Line]) -> np.ndarray:
    """What each line adds to the windows that it is in."""
    has_main = any(b.ok and b.main for b in blocks)
    return np.array([0 if not b.ok else len(b.text) + SURGE if b.main else 0 if has_main or b.links else len(b.text) for b in blocks], np.int64)


def between(weight: np.ndarray) -> np.ndarray:
    """Which lines stand between a surge and the dive after it, and weigh anything."""
    n = len(weight)
    keep, inside = np.zeros(n, bool), False
    if not weight.any():
        return keep
    total = np.concatenate((np.cumsum(weight), np.full(WINDOW - 1, weight.sum())))
    window = total[WINDOW - 1 :] - np.concatenate(([0], total[: n - 1]))  # lines i to i + WINDOW - 1
    surge = min(SURGE, SHARE * window.max())
    for i in range(n):
        inside = (inside or (window[i] >= surge and weight[i] > 0)) and window[i] > 0
        keep[i] = inside and weight[i] > 0
    return keep


def beside(blocks: list[Line], weight: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """`keep`, and lines that share the container of a paragraph kept: those that weigh anything, and paragraphs that are a
    link as a whole. The page itself is no such container."""
    if any(b.ok and b.main for b in blocks):
        return keep
    homes = {b.home for b, k in zip(blocks, keep.tolist(), strict=True) if k and b.paragraph and b.home}
    return keep | np.array([b.home in homes and b.ok and (w > 0 or b.paragraph) for b, w in zip(blocks, weight.tolist(), strict=True)], bool)


def main_text(page: str | None) -> str:
    """Article text of a page."""
    blocks = lines(page or "")
    weight = weights(blocks)
    return " ".join(b.text for b, k in zip(blocks, beside(blocks, weight, between(weight)).tolist(), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_chunks(batches, "html"):
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
