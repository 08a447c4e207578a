"""Pages parsed to trees: their text, scripts, nodes and containers by selector.

Arrow-batched; a page is parsed once whatever is asked of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions import markup

# Elements without content; what a tag ends before it opens, and what it doesn't look beyond.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
KEEPS_P = ("table", "td", "th", "caption", "button", "object", "template")
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol div section article aside header footer nav main table tr td th caption blockquote pre figure figcaption dl dt dd br hr".split())
SILENT = frozenset(("script", "style", "noscript", "template"))
SPACE = re.compile(r"[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


#: The pieces of a source and the attributes of a tag, by the patterns that columns are read with.
PIECE, ATTRIBUTE = re.compile(markup.piece(r"\Z")), re.compile(markup.attribute(r"\Z"))
TAG = re.compile(rf"<[a-zA-Z][^\t\n\f\r />]*+({markup.attributes(chr(92) + 'Z')})(?:>|\Z)")
NAME, HEAD = re.compile(r"</?([a-zA-Z][^\t\n\f\r />]*)"), frozenset(markup.HEAD_TAGS.split("|"))
RAW_END = {t: re.compile(rf"(?i)</{t}(?={markup.APART})") for t in markup.RAW_TAGS.split("|")}
REFERRING, IN_HEAD = frozenset(markup.REFERRING_TAGS.split("|")), ("title", "noframes")


class Tree:
    """Nodes of a page in order: tag, parent, last node below, attributes, where they stand in the source, and text by place.

    Takes time in proportion to the source: it is cut into pieces once, and of what is open the last of each name is known.
    """

    def __init__(self, page: str):
        self.page = page
        self.tags, self.parents, self.last, self.attributes, self.spans = ["#root"], [-1], [0], [{}], [[0, len(page)]]
        self.texts: list[str] = []
        self.text_nodes: list[int] = []  # the node that holds each text
        self.events: list[tuple[str, int]] = []  # what opens and closes, and texts by number, in order
        self.held: list[list[int]] = [[0, 0, 0, 0]]  # of each node, the range of its events and of its texts
        self.places = [0]  # of each node, its place among its parent's children of its tag
        self.counts: list[dict[str, int]] = [{}]
        self.open, self.depths = [0], {}
        self.ahead: set[int] = set()  # titles that stand before the body
        self.in_body = False
        self._read()
        while self.open:
            self._end(len(page))

    def _read(self) -> None:
        run: list[str] = []  # text may be cut by brackets that open nothing
        for m in PIECE.finditer(self.page):
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                run.append(piece)
                continue
            if run:
                self._text(html.unescape("".join(run)))
                run.clear()
            name = NAME.match(piece)
            if name is None:
                continue
            tag = name[1].lower()
            if m[1]:
                self._whole(m, tag)
            elif piece[-1] != ">":
                continue  # a tag that the source ends in is none
            elif piece[1] == "/":
                self._close(tag, m.start(), m.end())
            else:
                self._open(tag, piece[name.end() : -1], m.start(), m.end())
        if run:
            self._text(html.unescape("".join(run)))

    def _whole(self, m: re.Match, tag: str) -> None:
        """An element that holds no markup."""
        inside = TAG.match(m[0])
        stop = RAW_END[tag].search(m[0], inside.end())
        end = stop.start() if stop else len(m[0])
        node = self._open(tag, inside[1], m.start(), m.start() + inside.end())
        held = m[0][inside.end() : end]
        if tag in IN_HEAD and not self.in_body:
            self.ahead.add(node)
        if held:
            self._text(html.unescape(held) if tag in REFERRING else held, inner=True)
        self._end(m.end())

    def _text(self, data: str, inner: bool = False) -> None:
        self.in_body = self.in_body or (not inner and bool(data.strip("\t\n\f\r ")))
        self.events.append(("text", len(self.texts)))
        self.texts.append(data)
        self.text_nodes.append(self.open[-1])

    def _end(self, at: int) -> None:
        node = self.open.pop()
        if self.open:
            self.depths[self.tags[node]].pop()
        self.spans[node][1] = at
        self.events.append(("close", node))
        self.held[node][1], self.held[node][3] = len(self.events), len(self.texts)
        self.last[node] = len(self.tags) - 1

    def _deepest(self, names) -> int:
        return max((self.depths[t][-1] for t in names if self.depths.get(t)), default=0)

    def _end_open(self, wanted: tuple[str, ...], bounds: tuple[str, ...], at: int) -> None:
        """Ends the innermost open element of ``wanted``, if none of ``bounds`` lies in it."""
        depth = self._deepest(wanted)
        if depth and depth > self._deepest(bounds):
            while len(self.open) > depth:
                self._end(at)

    def _open(self, tag: str, inside: str, at: int, end: int) -> int:
        self.in_body = self.in_body or tag not in HEAD
        if tag in ("html", "body") and tag in self.depths:  # a page has one of either
            return 0
        if tag in CLOSES:
            self._end_open(*CLOSES[tag], at)
        if tag in ENDS_P:
            self._end_open(("p",), KEEPS_P, at)
        node, parent = len(self.tags), self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        given = [(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or "")) for a in ATTRIBUTE.finditer(inside)]
        self.attributes.append(dict(reversed(given)))
        self.spans.append([at, end])
        self.held.append([len(self.events), 0, len(self.texts), 0])
        self.counts[parent][tag] = self.counts[parent].get(tag, 0) + 1
        self.places.append(self.counts[parent][tag])
        self.counts.append({})
        self.events.append(("open", node))
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(node)
        self.last.append(node)
        if tag in VOID:
            self._end(end)
        return node

    def _close(self, tag: str, at: int, end: int) -> None:
        self.in_body = self.in_body or tag in ("body", "html", "br")
        if tag in ("html", "body"):
            return
        if tag == "br" or tag == "p" and not self.depths.get("p"):
            self._open(tag, "", at, end)
            if tag == "p":
                self._end(end)
            return
        depth = self._deepest((tag,))
        if depth:
            while len(self.open) > depth + 1:
                self._end(at)
            self._end(end)

    def text_of(self, node: int) -> str:
        """All text in the node, code and all."""
        return "".join(self.texts[slice(*self.held[node][2:])])

    def children(self, node: int) -> list[int]:
        found, at = [], node + 1
        while at <= self.last[node]:
            found.append(at)
            at = self.last[at] + 1
        return found

    def find(self, selector: str) -> int | None:
        """The first node of a selector: ``#id``, ``tag``, ``tag.class``, ``tag:nth-of-type(n)``, joined by `` > ``. None if there is none or it can't be read."""
        found = None
        for k, step in enumerate(selector.split(" > ")):
            m = re.fullmatch(r"(?:#([\w-]+)|([a-zA-Z][\w-]*)(?:\.([\w-]+))?(?::nth-of-type\((\d+)\))?)", step.strip())
            if not m:
                return None
            nodes = range(1, len(self.tags)) if k == 0 else sorted({c for i in found for c in self.children(i)})
            if m[1]:
                found = [i for i in nodes if self.attributes[i].get("id") == m[1]]
            else:
                found = [i for i in nodes if self.tags[i] == m[2].lower() and (not m[3] or m[3] in self.attributes[i].get("class", "").split()) and (not m[4] or self.nth(i) == int(m[4]))]
        return found[0] if found else None

    def nth(self, node: int) -> int:
        """The node's place among its parent's children of its tag."""
        return self.places[node]

    def shown(self, node: int, without: frozenset[int] = frozenset()) -> str:
        """Text of the node outside code and the nodes ``without``, one line for each block, white space as single blanks."""
        begin, end = self.held[node][:2]
        parts, passed = [], begin  # events before ``passed`` are passed over
        for at in range(begin, end):
            kind, i = self.events[at]
            if at < passed:
                continue
            if kind == "text":
                parts.append(self.texts[i])
            elif kind == "open" and (self.tags[i] in SILENT or i in without or (i in self.ahead and node != i)):
                passed = self.held[i][1]
            elif self.tags[i] in BLOCKS:
                parts.append("\n")
        lines = (SPACE.sub(" ", line).strip(" ") for line in "".join(parts).split("\n"))
        return "\n".join(line for line in lines if line)

    def raw_text(self) -> str:
        """What a reader of the source sees: text of the body outside code."""
        return self.shown(0)

    def inline_scripts(self) -> str:
        held = [self.text_of(i) for i, tag in enumerate(self.tags) if tag == "script" and "src" not in self.attributes[i]]
        return "\n".join(t for t in held if t.strip())

    def container(self, selector: str) -> dict:
        """What stands at a selector: whether anything does, whether it has neither text nor elements, its words, and its source."""
        node = self.find(selector)
        if node is None:
            return {"present": False, "empty": True, "words": 0, "outer_html": None}
        text = self.text_of(node).strip()
        return {"present": True, "empty": not text and self.last[node] == node, "words": count_words(text), "outer_html": self.page[slice(*self.spans[node])]}


def count_words(text: str) -> int:
    return len(re.findall(r"[^\W_]+", text))


#: Nodes that are handed over together.
NODES_PER_BATCH = 10_000
READ = "struct<raw_text:string,scripts:string,containers:array<struct<selector:string,present:boolean,empty:boolean,words:bigint,outer_html:string>>>"


def read_pages(source: Column, selectors: Column) -> Column:
    """struct<raw_text, scripts, containers> of pages; containers: what each of ``selectors`` holds in the source."""

    @F.pandas_udf(READ)
    def read(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, wanted in pages:
            rows = []
            for page, names in zip(sources, wanted, strict=True):
                tree = Tree(page or "")
                held = [{"selector": name, **tree.container(name)} for name in (names if names is not None else ())]
                rows.append((tree.raw_text(), tree.inline_scripts(), held))
            yield pd.DataFrame(rows, columns=["raw_text", "scripts", "containers"])

    return read(source, selectors)


def node_table(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, node_id, parent_id, tag, nth_of_type, attrs, text: the nodes of each page in document order, with their own text."""
    kind = dict(pages.dtypes)[key]

    names = [key, "node_id", "parent_id", "tag", "nth_of_type", "attrs", "text"]

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for page_id, page in zip(batch[key], batch[source], strict=True):
                tree = Tree(page or "")
                own: list[list[str]] = [[] for _ in tree.tags]
                for node, text in zip(tree.text_nodes, tree.texts, strict=True):
                    own[node].append(text)
                for i in range(1, len(tree.tags)):
                    rows.append((page_id, i, tree.parents[i], tree.tags[i], tree.nth(i), tree.attributes[i], "".join(own[i])))
                    if len(rows) == NODES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows.clear()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return pages.select(key, source).mapInPandas(nodes, f"{key} {kind}, node_id long, parent_id long, tag string, nth_of_type long, attrs map<string,string>, text string")
