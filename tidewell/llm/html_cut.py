"""Operator 1, HTML extraction by minimum-cut labelling.

A page is read into blocks of text (what stands between the boundaries of block-level elements). A linear classifier gives
each block a leaning, which becomes a terminal capacity: towards the source for content, towards the sink for boilerplate.
Neighbouring blocks, and blocks that follow each other in one parent element, are joined by smoothness edges, the
stronger the closer they are in the element tree. The minimum cut labels all blocks at once: what the source still reaches
after a maximum flow is content.

What an element is (nav, form, hidden) settles what is in it. Its name is evidence only, and is weighed when the page has been read: a
name made of words for boilerplate and of filler ("comments-section") speaks against all below it, unless that is nearly the whole
page with its title; a name with other words in it ("legal-news") speaks against it the less, the more of the page's text it
holds, and half as much if it has headings.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_SPLIT, _CAMEL = re.compile(r"[^a-z0-9]+"), re.compile(r"([a-z])([A-Z])")

#: Elements that hold plain characters up to their end tag, or to the end of the page; none of it is shown as text.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text isn't shown as text; without an end tag they end with their parent.
SILENT = frozenset("noscript template svg canvas video audio select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open element of the same kind up to the nearest of the containers.
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("datalist",)}
ENDS_P = BLOCKS - {"br", "button", "body", "html"}
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Elements whose names are often made from the words of a title, so that a name with other words in it tells nothing.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p section article li dt dd td th blockquote figure".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies pagination pager "
    "skip copyright legal disclaimer search form hidden".split()
)
CONTENT_NAMES = frozenset("article post entry story content body main text".split())
#: Words that say nothing of their own in a name; so do single letters and what has digits.
FILLER = frozenset(
    "area bar bars block blocks bottom box button buttons col column container div field fields form global group heading holder icon icons inner item items js left "
    "link links list main module new outer page panel posts primary region right row secondary section site slot slots thread title top unit units view wp wrap wrapper".split()
)
#: All that a name can say of these, which hold the page.
OUTER, OUTER_NAMES = ("html", "body", "main", "article"), frozenset("comment comments ad advert".split())

#: The classifier's weights, in units of one smoothness edge between siblings.
INSIDE_BOILERPLATE, INSIDE_CONTENT, OUTSIDE_CONTENT, LINKS, WORDS, SENTENCE, HEADING, RIGHTS, SHORT = -8.0, 4.0, -2.0, -4.0, 1.5, 0.6, 0.5, -2.5, -0.4
#: A name with other words than those for boilerplate, a block that is all there is on a page, and the share of a page that is nearly all.
NAMED, ALONE, NEARLY = -7.0, 1.0, 0.8
ADJACENT, SIBLING = 0.5, 0.7


class Element(NamedTuple):
    tag: str
    number: int
    boilerplate: bool
    content: bool
    link: bool
    silent: bool = False
    named: int = 0  # the innermost element with evidence by name; 0 for none


class Block(NamedTuple):
    text: str
    parent: int
    depth: int
    tag: str
    boilerplate: bool
    content: bool
    link_share: float
    name: float = 0.0  # what names say, 0 or less
    share: float = 0.0  # of the page's text that isn't boilerplate


class Evidence:
    """Elements whose names speak against them, as a tree: the one around each, whether the name is sure, characters of text, and
    whether there is a title or a heading. The first stands for the page."""

    def __init__(self):
        self.above, self.sure, self.size, self.title, self.heading = [0], [False], [0], [False], [False]

    def add(self, above: int, sure: bool) -> int:
        for column, x in ((self.above, above), (self.sure, sure), (self.size, 0), (self.title, False), (self.heading, False)):
            column.append(x)
        return len(self.above) - 1

    def weights(self) -> tuple[list[float], int]:
        """What each element's names, and those around it, say; the characters that no sure name speaks against."""
        inside = list(self.size)
        for i in range(len(self.above) - 1, 0, -1):  # the inner ones come later
            up = self.above[i]
            inside[up] += inside[i]
            self.title[up] |= self.title[i]
            self.heading[up] |= self.heading[i]
        sure = [False] * len(self.above)
        for i in range(1, len(self.above)):
            sure[i] = sure[self.above[i]] or (self.sure[i] and not (self.title[i] and inside[i] >= NEARLY * inside[0]))
        free = max(sum(x for x, gone in zip(self.size, sure, strict=True) if not gone), 1)
        out = [0.0] * len(self.above)
        for i in range(1, len(self.above)):
            weak = 0.0 if self.sure[i] else NAMED * min(1.0, max(0.0, 3 - 5 * inside[i] / free)) * (0.5 if self.heading[i] else 1.0)  # from 0.4 to 0.6 of the page
            out[i] = INSIDE_BOILERPLATE if sure[i] else min(weak, out[self.above[i]])
        return out, free


def _says(name: str, noise: frozenset[str]) -> int:
    """2 for a name of words for boilerplate and filler, 1 for one with other words, too, 0 for one without any such word."""
    words = [x for x in _SPLIT.split(name) if x]
    if name in noise:
        return 2
    if len(words) > 4 or not noise & set(words):
        return 0
    rest = set(words) - noise - FILLER
    return 2 if all(len(x) == 1 or any(c.isdigit() for c in x) for x in rest) else 1


def _element(tag: str, attributes: str, number: int, above: Element, evidence: Evidence) -> Element:
    boilerplate, content, says = above.boilerplate, above.content, 0
    names: set[str] = set()
    if attributes and not attributes.isspace():
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault((m[1] or m[5]).lower(), next((v for v in (m[2], m[3], m[4]) if v is not None), ""))
        names = {_CAMEL.sub(r"\1-\2", x).lower() for x in (*found.get("class", "").split(), found.get("id", "").strip())}
        if found.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", ""):
            boilerplate = True
        content = content or found.get("role", "").lower() in ("main", "article")
        noise = OUTER_NAMES if tag in OUTER else BOILERPLATE_NAMES
        if tag in BLOCKS and not content and not names & CONTENT_NAMES:
            noise |= {"header"}
        says = max([_says(x.strip("-_"), noise) for x in names], default=0)
        if says == 1 and (tag in TITLED or tag in OUTER or tag not in BLOCKS):
            says = 0
    if tag in BOILERPLATE_TAGS or (tag == "header" and not content and not names & CONTENT_NAMES):
        boilerplate = True
    if says and tag not in BLOCKS:  # within a line
        boilerplate, says = True, 0
    named = evidence.add(above.named, says == 2) if says else above.named
    return Element(tag, number, boilerplate, content or tag in ("article", "main"), above.link or tag == "a", above.silent or tag in SILENT, named)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, with character references decoded and white space made single."""
    top, evidence = Element("", 0, False, False, False), Evidence()
    stack, blocks, count = [top], [], 1
    parts: list[str] = []
    beside: list[str] = []  # boilerplate within a line, as an advert in a paragraph
    linked = shown = 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each kind of open elements in the stack
    lines = [0]  # those of the open elements of blocks

    def flush() -> None:
        nonlocal linked, shown
        at = stack[lines[-1]]
        for own, boilerplate in ((parts, at.boilerplate), (beside, True)):
            text = " ".join(html.unescape("".join(own)).split()) if own else ""
            if text:
                blocks.append((Block(text, at.number, len(stack), at.tag, boilerplate, at.content, linked / max(shown, 1)), at.named))
                if not boilerplate:
                    evidence.size[at.named] += len(text)
                    evidence.title[at.named] |= at.tag == "h1"
                    evidence.heading[at.named] |= at.tag in ("h1", "h2", "h3")
            own.clear()
        linked = shown = 0

    def push(element: Element) -> None:
        places[element.tag].append(len(stack))
        if element.tag in BLOCKS:
            lines.append(len(stack))
        stack.append(element)

    def pop_to(tag: str, limits: tuple[str, ...] | frozenset = ()) -> None:
        if not places[tag] or any(places[x] and places[x][-1] > places[tag][-1] for x in limits):
            return
        at = places[tag][-1]
        for element in stack[at:]:
            places[element.tag].pop()
        while lines[-1] >= at:
            lines.pop()
        del stack[at:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        own = stack[-1]
        if text and not own.silent:
            if own.boilerplate and own.tag not in BLOCKS and not stack[lines[-1]].boilerplate:
                beside.append(text)
            else:
                parts.append(text)
                size = len(text) - text.count(" ")
                shown += size
                linked += size * own.link
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            pop_to(tag)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "head":  # its own elements are left out each; a body may follow without an end tag
            continue
        if tag in BLOCKS:
            flush()
            pop_to("svg")  # drawings end where text begins
            if tag in ENDS_P:
                pop_to("p", frozenset(("table", "td", "th", "button", "article", "section", "div", "li", "body")))
            if tag in CLOSES:
                pop_to(tag, CLOSES[tag])
        if tag not in VOID and not m[3].endswith("/"):
            push(_element(tag, m[3], count, stack[-1], evidence))
            count += 1
    flush()
    weights, free = evidence.weights()
    return [block._replace(name=weights[named], share=0.0 if block.boilerplate else len(block.text) / free) for block, named in blocks]


def leaning(block: Block, has_content: bool) -> float:
    """The classifier: above 0 for content, below for boilerplate."""
    text, words = block.text, block.text.count(" ") + 1
    score = WORDS * min(words, 30) / 30 + LINKS * block.link_share
    score += min(INSIDE_BOILERPLATE * block.boilerplate, block.name) + ALONE * min(block.share, 1.0)
    if has_content:
        score += INSIDE_CONTENT if block.content else OUTSIDE_CONTENT
    if text[-1] in ".!?…\"”»:" and words > 1:
        score += SENTENCE
    if len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit():
        score += HEADING
    elif words < 4:
        score += SHORT
    if "©" in text or "all rights reserved" in text.lower():
        score += RIGHTS
    return score


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    latest: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT / (1 + abs(block.depth - blocks[i - 1].depth) + (block.parent != blocks[i - 1].parent))
        if block.parent in latest:
            pair = (latest[block.parent], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        latest[block.parent] = i
    return edges


def minimum_cut(leanings: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source's side of a maximum flow, which is found in phases: all shortest paths at once.

    Leanings are what is left of terminal capacities once the flow straight through a node is taken off. A node that
    nothing decides falls to the sink's side. On the long chains that pages are, flow stays near where it begins, so there are few phases,
    each of which passes over the edges once.
    """
    left, tiny = list(leanings), 1e-9
    near: list[list[int]] = [[] for _ in left]  # edges 2k and 2k + 1 are the two directions of one
    ends, capacity = [], []
    for (a, b), c in edges.items():
        near[a].append(len(ends))
        near[b].append(len(ends) + 1)
        ends += [b, a]
        capacity += [c, c]
    while True:
        level, sinks = [-1] * len(left), False
        layer = sources = [i for i, x in enumerate(left) if x > tiny]
        for a in sources:
            level[a] = 0
        while layer and not sinks:
            after = []
            for a in layer:
                for e in near[a]:
                    b = ends[e]
                    if level[b] < 0 and capacity[e] > tiny:
                        level[b] = level[a] + 1
                        sinks = sinks or left[b] < -tiny
                        after.append(b)
            layer = after
        if not sinks:
            return [x >= 0 for x in level]
        tried = [0] * len(left)  # edges of each node that lead nowhere in this phase
        for source in sources:
            path, a = [], source
            while left[source] > tiny:
                if left[a] < -tiny:
                    flow = min([left[source], -left[a], *[capacity[e] for e in path]])
                    left[source] -= flow
                    left[a] += flow
                    for e in path:
                        capacity[e] -= flow
                        capacity[e ^ 1] += flow
                    path, a = [], source
                    continue
                while tried[a] < len(near[a]):
                    e = near[a][tried[a]]
                    if capacity[e] > tiny and level[ends[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(near[a]):
                    path.append(near[a][tried[a]])
                    a = ends[path[-1]]
                elif path:
                    a = ends[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def extract(page: str) -> str:
    """The main text of a page: the blocks on the source's side, joined by spaces."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    has_content = any(b.content and not b.boilerplate and b.name > INSIDE_BOILERPLATE for b in blocks)
    content = minimum_cut([leaning(b, has_content) for b in blocks], smoothness(blocks))
    return " ".join([b.text for b, keep in zip(blocks, content, strict=True) if keep])


def main_text(page: Column) -> Column:
    """The main text of a column of pages; a null page counts as empty and has an empty text."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p or "") for p in batch.to_pylist()], pa.string())

    return texts(page)


def page_texts(pages: DataFrame, *, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id, url, text and its code points (n_chars) of every page. White space is what Unicode calls so.

    One row for each row of pages, repeated ones and null ids too; empty and null pages have an empty text; an empty table gives an
    empty one. Pages of any length are read whole, in time in proportion to their length but for the flow. Only the three columns
    are read, so others can't clash; nothing is shuffled.
    """
    rows = pages.select(F.col(id), F.col(url), main_text(F.col(page)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
