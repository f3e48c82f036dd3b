"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between the boundaries of block elements, each with its
path of tags from the root, in which containers that differ in class differ. For every path the characters outside links, the punctuation marks and
the blocks are counted; characters a block and punctuation a block are the path's ratios. Each
block takes the ratios of its path, both series are smoothed along the page and fused by
multiplication, but no block gets more than its path's own ratios give. A path's score is the mean
over its blocks, and paths that score at or above a threshold, a part of the deviation of the fused
series, are content: all their blocks are. What names itself as something else (a menu, a footer,
an advert, a form, a comment) counts as empty.

Short blocks such as headings share no path with long ones. The innermost element around most of
the content tells where they belong: its blocks are kept too, whatever their path and their links,
unless they are named as something else. Outside it, blocks of content paths that are mostly links
are left out.

Everything is linear in the page: paths and elements are numbers, an element holds one run of
blocks, and open elements are looked up by tag.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches

#: Elements whose content is not markup. Fixed values.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
#: Elements without an end tag. Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that don't break a line of text. Fixed values.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "mroot", "msqrt", "msub", "msubsup", "msup", "mtext", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are never part of an article's text. Fixed values.
OTHER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "dialog", "template", "noscript", "svg", "canvas", "object", "audio", "video", "menu", "map", *RAW}
#: Words of a class, id or role that name something besides the article. Fixed values.
NAMES = re.compile(
    r"ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|captcha|comment|comments|commentlist|consent|cookie|cookies|disclaimer|discussion|disqus|footer|form|gdpr|"
    r"header|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|paywall|popup|privacy|promo|promoted|promotion|recommended|"
    r"related|replies|reply|respond|responses|search|share|sharing|sidebar|sidebox|signup|skip|social|sponsor|sponsored|subscribe|subscription|tags|toc|toolbar|tooltip|topbar|widget|widgets|"
    r"contentinfo|complementary|alert"
)
#: Words beside them that say where or how large the thing is. Fixed values.
PLACES = frozenset(
    """site page main global top bottom left right upper lower primary secondary outer inner wrap wrapper container content box block area section bar slot item items list link links button buttons icon icons group row
    col column panel unit zone region holder body title text post posts article entry user users web mobile desktop small large big sticky fixed float js is has no byline form input field nav menu"""
    .split()
)
#: Elements whose id is an anchor into the text and names nothing. Fixed values.
ANCHORS = {"section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "figure", "table", "blockquote"}
#: A start tag of the first kind ends an open element of the second. Fixed values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements past which an end tag or an implied end doesn't reach. Fixed values.
WALLS = {"table", "ul", "ol", "dl", "article", "section", "main", "div", "body", "html", "td", "th", "li", "blockquote", "form", "nav", "aside", "footer", "header"}
#: Elements that hold others; what is in ones of different classes has different paths. Fixed values.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "blockquote", "center", "details", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Every repetition is possessive, so that no page is read twice; a quote that isn't closed runs to the page's end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"?|'[^']*+'?)*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
SPACE = re.compile(r"\s+")

#: Part of the content's characters that the innermost element around it holds.
MOST = 0.8


@dataclass
class Block:
    path: int
    node: int
    tag: str  #: of the innermost element
    other: bool  #: it, or what it stands in, is named as something else
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


@dataclass
class Tree:
    """Elements by number, the root being 0: their parents, depths, tags, and the blocks closed before each began and ended."""

    up: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    begin: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])


def names_other(value: str) -> bool:
    """Whether a word of a class, id or role is made of NAMES and, besides, only of PLACES and numbers: cookie-banner is, search-algorithms isn't."""
    for word in value.split():
        parts = [p for p in re.split(r"[_-]|\d+", word) if p]
        if any(map(NAMES.fullmatch, parts)) and all(NAMES.fullmatch(p) or p in PLACES for p in parts):
            return True
    return False


def named_other(tag: str, attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if (name in ("class", "role") or name == "id" and tag not in ANCHORS) and names_other(value):
            return True
    return False


def class_of(attributes: str) -> str:
    return next(("".join(values).lower() for name, *values in ATTRIBUTE.findall(attributes) if name.lower() == "class"), "")


class Reader:
    """Reads a page into blocks in page order; what stands in raw elements is left out."""

    def __init__(self) -> None:
        self.tree, self.blocks = Tree(), []
        self.open: list[tuple[int, str, int, bool, bool]] = [(0, "", 0, False, False)]  # node, tag, path, other, link
        self.places: dict[str, list[int]] = {}  # by tag, where in `open` elements of it are
        self.paths: dict[tuple[int, str], int] = {}
        self.block = Block(0, 0, "", False)

    def close(self) -> None:
        if self.block.parts:
            self.blocks.append(self.block)
        self.stand()

    def stand(self) -> None:
        node, tag, path, other, _ = self.open[-1]
        self.block = Block(path, node, tag, other)

    def innermost(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def leave(self, tags: set[str], walls: set[str]) -> None:
        """Ends the innermost open element among tags and all in it, unless a wall is nearer."""
        at = self.innermost(tags)
        if at and at >= self.innermost(walls):
            while len(self.open) > at:
                node, tag, *_ = self.open.pop()
                self.places[tag].pop()
                self.tree.end[node] = -1

    def enter(self, tag: str, attributes: str) -> None:
        node, _, path, other, link = self.open[-1]
        inside = bool(self.places.get("article") or self.places.get("main"))
        other = other or tag in OTHER or tag == "header" and not inside or tag not in ("body", "html", "article", "main") and named_other(tag, attributes)
        label = f"{tag}.{class_of(attributes)}" if tag in CONTAINERS and "class" in attributes else tag
        own = path if tag in INLINE else self.paths.setdefault((path, label), len(self.paths) + 1)
        t = self.tree
        t.up.append(node)
        t.depth.append(t.depth[node] + 1)
        t.tag.append(tag)
        t.begin.append(len(self.blocks))
        t.end.append(0)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((len(t.up) - 1, tag, own, other, link or tag == "a"))

    def say(self, text: str) -> None:
        decoded = html.unescape(text) if "&" in text else text
        if not self.block.parts:
            self.stand()
        self.block.parts.append(decoded)
        if self.open[-1][4]:
            self.block.linked += len(decoded.strip())

    def read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            start = page.find("<", at)
            start = size if start < 0 else start
            found = TOKEN.match(page, start) if start < size else None
            end = found.end() if found else min(size, start + 1)
            text = page[at : start if found else end]  # a lone < is text
            if text:
                self.say(text)
            at = end
            if found is None or found[2] is None:
                continue
            tag, attributes = found[2].lower(), found[3] or ""
            if found[1]:
                if tag not in INLINE:
                    self.close()
                self.leave({tag}, set() if tag in WALLS else {"table", "body", "html"} - {tag})
                if tag not in INLINE:
                    self.stand()
            elif tag == "br":
                self.block.parts.append("\n")
            elif tag in VOID:
                if tag == "hr":
                    self.close()
            else:
                if tag not in INLINE:
                    self.close()
                    self.leave({"p"}, WALLS)
                    if tag in HEADINGS:
                        self.leave(HEADINGS, WALLS)
                if tag in ENDS:
                    self.leave(ENDS[tag], {"table", "ul", "ol", "dl", "select"} - ENDS[tag])
                if tag in RAW:
                    last = ENDS_OF_RAW[tag].search(page, at)
                    at = size if last is None else last.end()
                elif not (attributes.rstrip().endswith("/") and tag in ("path", "circle", "use")):
                    self.enter(tag, attributes)
                    if tag not in INLINE:
                        self.stand()
        self.close()


def smooth(x: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Weighted means of neighbours, weights falling off as a Gaussian."""
    k = np.arange(-2, 3)
    w = np.exp(-(k**2) / (2 * width**2))
    return np.convolve(x, w, "same") / np.convolve(np.ones(len(x)), w, "same") if len(x) >= len(k) else np.full(len(x), x.mean()) if len(x) else x


def content_paths(path: np.ndarray, size: np.ndarray, marks: np.ndarray, part_of_deviation: float) -> np.ndarray:
    """For each block whether its path is content. path: a number for each block's path; size, marks: its characters and punctuation."""
    n = np.bincount(path)
    ratio = [(np.bincount(path, x) / np.maximum(n, 1))[path] for x in (size, marks)]
    # what stands beside content gains nothing from it
    fused = np.minimum(ratio[0] * (1 + ratio[1]), smooth(ratio[0]) * (1 + smooth(ratio[1])))
    score = np.bincount(path, fused) / np.maximum(n, 1)
    score[np.bincount(path, size) == 0] = 0
    top = score.max(initial=0)
    return (score >= min(part_of_deviation * fused.std(), top))[path] & (top > 0) & (size > 0)


def container(tree: Tree, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> int:
    """The innermost element whose blocks, first to last, hold MOST of the weight; ties go to the first."""
    before = np.concatenate([[0.0], np.cumsum(weight)])
    inside = before[last] - before[first]
    fits = inside >= MOST * before[-1]
    return int(np.where(fits, np.array(tree.depth), -1).argmax())


def main_text(page: str | None, part_of_deviation: float = 1.5) -> str:
    """The article's text: white space in a block is one space, blocks are joined by one space."""
    if not page:
        return ""
    reader = Reader()
    reader.read(page)
    texts = [b.text() for b in reader.blocks]
    number = np.concatenate([[0], np.cumsum([bool(t) for t in texts])]).astype(np.int64)  # of the blocks with text, those before each
    found = [(b, t) for b, t in zip(reader.blocks, texts) if t]
    if not found:
        return ""
    own = np.array([1 - min(1.0, b.linked / len(t)) for b, t in found])
    other = np.array([b.other for b, _ in found])
    size = np.array([0 if b.other else len(t) for b, t in found]) * own
    marks = np.array([0 if b.other else len(PUNCTUATION.findall(t)) for b, t in found]) * own
    path = np.unique(np.array([b.path for b, _ in found]), return_inverse=True)[1]
    content = content_paths(path, size, marks, part_of_deviation)
    if not content.any():
        return ""
    tree = reader.tree
    # the blocks of an element are those from its beginning up to that of the next element outside it
    owner = np.array([b.node for b in reader.blocks])
    last_of = np.zeros(len(tree.up), np.int64)
    np.maximum.at(last_of, owner, np.arange(1, len(owner) + 1))
    for node in range(len(tree.up) - 1, 0, -1):
        last_of[tree.up[node]] = max(last_of[tree.up[node]], last_of[node])
    first = number[np.array(tree.begin)]
    last = np.maximum(first, number[last_of])
    root = container(tree, first, last, size * content)
    # a tie: what an article, or an element around, has besides are headings
    heading = np.array([b.tag in HEADINGS for b, _ in found])
    extra = np.concatenate([[0], np.cumsum(~heading & ~other)])
    while tree.up[root] >= 0 and tree.tag[tree.up[root]] not in ("", "html", "body"):
        a, b = tree.up[root], root
        if tree.tag[b] not in ("p", *HEADINGS, *INLINE) and tree.tag[a] not in ("article", "main") and extra[last[a]] - extra[first[a]] > extra[last[b]] - extra[first[b]]:
            break
        if tree.tag[b] in ("article", "main"):
            break
        root = a
    place = np.arange(len(found))
    if tree.tag[root] in ("", "html", "body", "p", *HEADINGS, *INLINE):
        # no element of its own: from the first to the last content block, and the headings right before
        low, high = int(content.argmax()), len(content) - int(content[::-1].argmax())
        while low and heading[low - 1]:
            low -= 1
    else:
        low, high = int(first[root]), int(last[root])
    near = (place >= low) & (place < high)
    keep = ~other & (near | content & (own >= 0.5))
    return " ".join(t for k, (_, t) in zip(keep, found) if k)


def extract(pages: DataFrame, keys: list[str] = ["page_id", "url"]) -> DataFrame:  # noqa: B006
    """keys, text and n_chars of each page. Needs keys and html; a null page has an empty text, and so has one without content."""
    bound_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["text string", "n_chars long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["text"] = [main_text(x) for x in batch["html"].tolist()]
            out["n_chars"] = [len(t) for t in out["text"]]
            yield out

    return pages.select(*keys, "html").mapInPandas(run, schema)
