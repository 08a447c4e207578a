"""A forgiving parser of HTML pages into trees of block elements, with features of each node.

Only elements that open a block become nodes; what stands inside them as text, in inline elements
too, is theirs. Scripts, styles, comments and the like go while parsing.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

from crawlvis.functions import markup

# HTML elements by how they are parsed.
RAW = ("script", "style", "template", "iframe", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements of formulas and drawings are inline: their text belongs to the block that they stand in.
FORMULA = "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom merror menclose semantics annotation"
DRAWING = "svg g path circle rect ellipse line polyline polygon text tspan textpath defs use symbol lineargradient radialgradient stop clippath mask pattern marker filter foreignobject desc"
INLINE = frozenset(f"{FORMULA} {DRAWING} canvas object audio video picture map output meter progress a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var center nobr head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Which open elements an opening tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
# What an ended element must not be looked for beyond.
BOUNDS = {"li": ("ul", "ol", "menu", "nav"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("datalist",)}

INSIDE = markup.attributes(r"\Z")
#: A piece of a source: a comment, what is neither tag nor text, or a tag with its slash, name and attributes. None goes back.
PIECE = re.compile(rf"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^\t\n\f\r />]*+)({INSIDE})(>|\Z)")
RAW_END = re.compile(rf"(?i)</({'|'.join(RAW)})(?={markup.APART})")
BODY = re.compile(rf"(?i)<body(?={markup.APART})")
ATTRIBUTE = re.compile(markup.attribute(r"\Z"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　﻿]+")
SEPARATOR = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Attribute words that features count, by what they tell of an element.
ATTRIBUTE_WORDS = {
    "main": "quote pullquote epigraph article articlebody body content entry hentry main maincontent post postcontent primary story text blog page".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc links skip toolbar".split(),
    "edge": "header masthead footer foot footnote colophon copyright topbar bottom logo site legal".split(),
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular more tags tagcloud".split(),
    "advert": "ad ads adv advert advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsoring dfp gpt".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup paywall message disclaimer".split(),
    "reader": "comment comments commentlist reply replies respond disqus discussion review reviews".split(),
    "share": "share sharing social follow facebook twitter like author byline meta".split(),
    "form": "form search searchbox login register input".split(),
}
WORD_KIND = {w: i for i, words in enumerate(ATTRIBUTE_WORDS.values()) for w in words}
TAG_KINDS = {t: i for i, tags in enumerate((("html", "body"), ("article",), ("main",), ("section",), ("div",), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog", "button", "select", "option", "optgroup", "datalist"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th"), ("figure", "figcaption", "details", "summary", "address"))) for t in tags}
ROLES = {"main": "main", "article": "main", "navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "menu": "menu", "menubar": "menu"}
KINDS = list(ATTRIBUTE_WORDS)
N_TAGS = max(TAG_KINDS.values()) + 2


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: tuple[int, ...]  # the kinds that its attributes tell of
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    parts: list = field(default_factory=list)  # own text and, as numbers, child nodes, in order
    linked: int = 0  # characters of own text in links
    label: bool = False  # for training: whether it holds main text


class _Open:
    """What is open: nodes with their tags, and of each tag where the last one stands, so that none is looked for along the way."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = [(0, "html")]
        self.depths: dict[str, list[int]] = {}

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def push(self, node: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((node, tag))

    def cut(self, depth: int) -> None:
        """Ends what stands at ``depth`` and in it."""
        while depth and len(self.stack) > depth:
            self.depths[self.stack.pop()[1]].pop()

    def end(self, tags, bounds=()) -> None:
        """Ends the innermost of ``tags``, if none of ``bounds`` lies in it."""
        depth = self.deepest(tags)
        if depth > self.deepest(bounds):
            self.cut(depth)


def parse(page: str) -> list[Node]:
    """The page's nodes in page order; the first is the root. Never fails, and takes time in proportion to the page.

    What can't be a tag is text. A quote opens a value only behind ``=``. A slash closes no element of code: it goes on to its end
    tag, or, where it has none, to the body or the end of the page, unless its slash may stand for that. A
    button or list of options that a page leaves open ends at the next block.
    """
    small = page.lower()
    left_open = tuple(t for t in ("button", "select") if small.count(f"<{t}") > small.count(f"</{t}"))
    ends: dict[str, list[int]] = {t: [] for t in RAW}
    for m in RAW_END.finditer(page):
        ends[m[1].lower()].append(m.start())
    bodies, last_section = [m.start() for m in BODY.finditer(page)], page.rfind("]]>")
    nodes = [Node("html", -1, 0, ())]
    open_, in_link, at = _Open(), 0, 0

    def text(piece: str) -> None:
        if piece:
            node = nodes[open_.stack[-1][0]]
            piece = entities.unescape(piece) if "&" in piece else piece
            node.parts.append(piece)
            if in_link:
                node.linked += len(piece)

    def after(places: list[int], begin: int) -> int | None:
        i = bisect_left(places, begin)
        return places[i] if i < len(places) else None

    while at < len(page):
        begin = page.find("<", at)
        m = PIECE.match(page, begin) if begin >= 0 else None
        if begin < 0:
            text(page[at:])
            break
        if m is None:
            follows = page.find("<", begin + 1)
            text(page[at : follows if follows >= 0 else len(page)])
            at = follows if follows >= 0 else len(page)
            continue
        text(page[at:begin])
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", begin) and begin < last_section:
                at = page.index("]]>", begin) + 3
                text(page[begin + 9 : at - 3])
            continue
        if not m[4]:
            break  # a tag that the page ends in is none
        name = m[2].lower()
        if name in ends and not m[1]:
            closed = after(ends[name], at)
            if closed is not None:
                at = closed  # its end tag is a piece of its own
            elif not m[3].endswith("/"):
                body = after(bodies, at)
                at = len(page) if body is None else body
        elif name in ends:
            continue
        elif name == "br":
            text(" ")
        elif name == "a":
            in_link = 0 if m[1] else 1
        elif name in INLINE or name in VOID and name != "hr":
            continue
        elif m[1]:
            if name in ("html", "body"):
                continue
            open_.cut(open_.deepest((name,)))
            in_link = 0
        elif name == "html":
            continue
        else:
            in_link = 0
            if name in CLOSES_P:
                if left_open:
                    open_.end(left_open)
                open_.end(("p",), ("td", "th", "li", "div", "section", "article", "body", "blockquote", "table"))
                if name in HEADINGS and open_.stack[-1][1] in HEADINGS:
                    open_.cut(len(open_.stack) - 1)
            if name in ENDS:
                open_.end(ENDS[name], BOUNDS[name])
            if name == "hr":
                nodes[open_.stack[-1][0]].parts.append(None)
                continue
            if name == "body" and open_.depths.get("body"):
                continue
            parent = open_.stack[-1][0]
            node = Node(name, parent, nodes[parent].depth + 1, *_told(m[3]))
            nodes[parent].children.append(len(nodes))
            nodes[parent].parts.append(len(nodes))
            open_.push(len(nodes), name)
            nodes.append(node)
    return nodes


def _told(attributes: str) -> tuple[tuple[int, ...], bool]:
    """The kinds that an element's attributes tell of, and whether they hide it."""
    kinds, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "itemprop"):
            kinds += [WORD_KIND[w] for w in SEPARATOR.split(value) if w in WORD_KIND]
        elif name == "role" and value in ROLES:
            kinds.append(KINDS.index(ROLES[value]))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return tuple(kinds), hidden


#: Names of the features, for inspection.
FEATURES = (
    [f"tag_{i}" for i in range(N_TAGS)] + [f"own_{k}" for k in KINDS] + [f"above_{k}" for k in KINDS] + [f"parent_{k}" for k in KINDS]
    + ["tag_above_" + t for t in ("nav", "header", "footer", "aside", "form", "article", "main")]
    + ["depth", "order", "siblings", "log_chars", "log_words", "share_of_page", "share_of_parent", "link_share", "density", "nodes", "log_sibling_chars", "first", "last", "p_below", "stops", "hidden", "hidden_above", "word_length"]
)
ABOVE_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main")


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node, from its subtree, attributes, ancestors and siblings."""
    n = len(nodes)
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    chars, words, links, size, paragraphs, stops = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        own = "".join(p for p in node.parts if isinstance(p, str))
        chars[i] += len(own)
        words[i] += len(own.split())
        links[i] += node.linked
        stops[i] += own.count(".") + own.count("!") + own.count("?")
        paragraphs[i] += node.tag == "p"
        size[i] += 1
        if node.parent >= 0:
            for a in (chars, words, links, size, paragraphs, stops):
                a[node.parent] += a[i]
    k, at = len(KINDS), N_TAGS
    for i, node in enumerate(nodes):
        row = out[i]
        row[TAG_KINDS.get(node.tag, N_TAGS - 1)] = 1
        for w in node.words:
            row[at + w] += 1
        if node.parent >= 0:
            above = out[node.parent]
            row[at + k : at + 2 * k] = np.minimum(above[at : at + k] + above[at + k : at + 2 * k], 2)
            row[at + 2 * k : at + 3 * k] = above[at : at + k]
            b = at + 3 * k
            row[b : b + len(ABOVE_TAGS)] = above[b : b + len(ABOVE_TAGS)]
            if nodes[node.parent].tag in ABOVE_TAGS:
                row[b + ABOVE_TAGS.index(nodes[node.parent].tag)] = 1
            row[-2] = max(above[-2], above[-3])
    parent = np.array([max(x.parent, 0) for x in nodes])
    siblings = np.array([len(nodes[p].children) for p in parent], dtype=np.float64)
    order = np.zeros(n)
    for node in nodes:
        for j, c in enumerate(node.children):
            order[c] = j
    one = np.maximum(chars, 1)
    b = at + 3 * k + len(ABOVE_TAGS)
    columns = (
        np.array([x.depth for x in nodes]), order / np.maximum(siblings, 1), np.minimum(siblings, 50), np.log1p(chars), np.log1p(words), chars / one[0], chars / one[parent],
        links / one, np.log1p(chars / size), np.log1p(size), np.log1p(np.maximum(chars[parent] - chars, 0)), order == 0, order == siblings - 1, np.log1p(paragraphs), np.minimum(stops / np.maximum(words, 1), 1),
        np.array([x.hidden for x in nodes]), out[:, -2], chars / np.maximum(words, 1),
    )
    for j, c in enumerate(columns):
        out[:, b + j] = c
    return out


def blocks(nodes: list[Node], chosen: np.ndarray) -> str:
    """The text of chosen nodes: white space inside a block as one blank, blocks in page order, one line each."""
    out: list[str] = []
    todo: list[tuple[int, int]] = [(0, 0)]
    run: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    while todo:
        i, at = todo.pop()
        parts = nodes[i].parts
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, str):
                if chosen[i]:
                    run.append(part)
            else:
                close()
                if part is not None and chosen[part]:
                    todo.append((i, at))
                    i, at, parts = part, 0, nodes[part].parts
        close()
    return "\n".join(out)
