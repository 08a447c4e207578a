"""Regions of pages: from tables of rendered nodes, and from the source of pages of which nothing but that is there.

A page's nodes stand in document order, so what is below a node is an interval, and that nothing of a set contains a node or
lies in it is told by running maxima and prefix sums. A page fits one task, and is read without a shuffle where it is one row.

Where no boxes were captured, a node's place and length in the source, in characters, stand for its place and height in
pixels, at the full width. Then weights follow the shares of the source, and whatever the source hides counts as hidden.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.sources.html import BLOCKS, NODES_PER_BATCH, SILENT, SPACE, Tree, count_words
from crawlvis.sources.shared import EACH, spread

# Elements by their part in a page, least heights, and how much is kept.
SEMANTIC = frozenset("header nav footer aside article section table form figure ul ol".split())
CONTAINERS = frozenset("div main section article".split())
SKIPPED = frozenset("script style noscript template link meta br hr".split())
LANDMARKS = frozenset("header nav aside footer".split())
NAMES = {"header": "Header", "nav": "Navigation", "footer": "Footer", "aside": "Sidebar", "article": "Article", "table": "Table", "form": "Form", "figure": "Figure", "ul": "List", "ol": "List"}
HEADINGS, CAPTIONS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("caption figcaption legend".split())
TALL_CONTAINER, TALL_SEMANTIC, MOST_REGIONS, MOST_DESCENTS, FEW_REGIONS = 80, 40, 24, 4, 3
CANVAS_SHARE, IFRAME_SHARE, IMAGE_SHARE = 0.4, 0.5, 0.5
MOST_LINKS, MOST_HIDDEN, MOST_VISITED, HIDDEN_WORDS, NAME_LENGTH, CHAIN = 60, 8, 5000, 30, 60, 8

BOX = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
FLAGS = "struct<has_canvas:boolean,canvas_dominant:boolean,has_iframe:boolean,iframe_dominant:boolean,iframe_src:string,has_table:boolean,img_count:bigint,img_without_alt_count:bigint,image_dominant:boolean>"
LINKS = "array<struct<href:string,is_client_route:boolean>>"
OUT = f"kind string, region_ord long, selector string, name string, text string, box {BOX}, flags {FLAGS}, links {LINKS}"
TEXTS = "array<struct<at:bigint,text:string,seen:boolean,breaks:boolean>>"
#: Pages, and bytes of their sources, that are read and handed over together.
PAGES_TOGETHER, BYTES_TOGETHER = 200, 4 << 20
#: The width of a page without captured boxes.
WIDTH = 1280


class Page:
    """Nodes in document order: tags, parents, the last node below each, attributes, boxes (x, y, width, height), and whether style hides them."""

    def __init__(self, tags: list[str], parents: list[int], last: list[int], attributes: list[dict], boxes: np.ndarray, hidden: np.ndarray):
        self.tags, self.parents, self.last, self.attributes, self.hidden = tags, np.asarray(parents, dtype=np.int64), np.asarray(last, dtype=np.int64), attributes, hidden
        self.x, self.y, self.width, self.height = boxes.T if len(boxes) else np.zeros((4, 0))
        self.area, self.shown = self.width * self.height, (self.width > 0) & (self.height > 0)
        self.node = np.arange(len(tags))
        self.count: dict[str, int] = {}
        for a in attributes:
            if a.get("id"):
                self.count[a["id"]] = self.count.get(a["id"], 0) + 1
        self.body = tags.index("body") if "body" in tags else 0

    def text(self, i: int) -> str:
        """The text that shows of a node, with what is below."""
        raise NotImplementedError

    def hidden_text(self, i: int) -> str:
        return self.text(i).strip()

    def told(self, i: int) -> str:
        """The text that names are taken from: what shows of a node, all that it holds if nothing shows."""
        return (self.text(i) if self.shown[i] else self.hidden_text(i)).strip()

    def filled(self, i: int) -> bool:
        """Whether any text shows of a node that shows itself."""
        return bool(self.text(i).strip())

    def tagged(self, names) -> np.ndarray:
        return np.array([t in names for t in self.tags], dtype=bool)

    def outermost(self, chosen: np.ndarray) -> np.ndarray:
        """Those of ``chosen`` that no other of them contains."""
        reach = np.maximum.accumulate(np.where(chosen, self.last, -1))
        return chosen & (np.concatenate(([-1], reach[:-1])) < self.node)

    def apart(self, others: np.ndarray) -> np.ndarray:
        """Nodes that neither are, nor contain, nor lie in one of ``others``."""
        reach = np.maximum.accumulate(np.where(others, self.last, -1))
        before = np.concatenate(([0], np.cumsum(others)))
        return (reach < self.node) & (before[self.last + 1] == before[:-1])

    def children(self, i: int) -> np.ndarray:
        return np.flatnonzero(self.parents == i)

    def below(self, i: int, names) -> list[int]:
        return [j for j in range(i + 1, int(self.last[i]) + 1) if self.tags[j] in names]

    def candidates(self) -> np.ndarray:
        """Nodes that are tall enough to be a region of their own."""
        able = self.shown & ~self.tagged(SKIPPED)
        semantic, container = self.tagged(SEMANTIC), self.tagged(CONTAINERS)
        good = able & np.where(semantic, self.height >= TALL_SEMANTIC, self.height >= TALL_CONTAINER)
        for i in np.flatnonzero(good & ~semantic & ~container):
            good[i] = self.filled(i)
        return good

    def regions(self) -> list[int]:
        """The elements to report, outermost ones only, in reading order."""
        if not self.tags:
            return []
        main = self.tags.index("main") if "main" in self.tags else self.body
        within = (self.node >= main) & (self.node <= self.last[main]) if main != self.body else np.zeros(len(self.node), dtype=bool)
        landmarks = self.outermost(self.tagged(LANDMARKS) & self.shown & ~within)
        free = self.candidates() & self.apart(landmarks)
        parts = lambda i: [c for c in self.children(i) if free[c]]
        parent_of = set(self.parents.tolist())
        content = parts(main)
        for _ in range(MOST_DESCENTS):
            wide = [c for c in content if c in parent_of and self.area[c] > 0]
            opened = max(wide, key=lambda c: self.area[c]) if wide else None if content else main
            found = parts(opened) if len(content) < FEW_REGIONS and opened is not None else []
            if not found:
                break
            content = [c for c in content if c != opened] + found
        order = list(dict.fromkeys([*np.flatnonzero(landmarks), *content]))
        every = np.zeros(len(self.node), dtype=bool)
        every[order] = True
        outer = self.outermost(every)
        largest = sorted((i for i in order if outer[i]), key=lambda i: -self.area[i])[:MOST_REGIONS]
        return [int(i) for i in sorted(largest, key=lambda i: (self.y[i], self.x[i], order.index(i)))]

    def own_id(self, i: int) -> str | None:
        name = self.attributes[i].get("id", "")
        plain = name[:1].isascii() and name[:1].isalpha() and all(c.isascii() and (c.isalnum() or c in "_-") for c in name)
        return f"#{name}" if plain and self.count[name] == 1 else None

    def selector(self, i: int) -> str:
        """An id that only one element has, or the way down from one or from the body, of a few steps at most."""
        steps: list[str] = []
        while i >= 0 and i != self.body and len(steps) < CHAIN:
            name = self.own_id(i)
            if name:
                return " > ".join([name, *steps])
            same = [j for j in self.children(self.parents[i]) if self.tags[j] == self.tags[i]] if self.parents[i] >= 0 else [i]
            steps.insert(0, f"{self.tags[i]}:nth-of-type({same.index(i) + 1})" if len(same) > 1 else self.tags[i])
            i = self.parents[i]
        return " > ".join(["body", *steps] if i == self.body else steps)

    def name(self, i: int, number: int) -> str:
        label = self.attributes[i].get("aria-label", "").strip()
        if not label and self.attributes[i].get("aria-labelledby"):
            wanted = self.attributes[i]["aria-labelledby"].split()[:1]
            label = next((self.told(j) for j, a in enumerate(self.attributes) if wanted and a.get("id") == wanted[0]), "")
        for names in (HEADINGS, CAPTIONS):
            found = [] if label else self.below(i, names)[:1]
            label = label or (self.told(found[0]) if found else "")
        return label[:NAME_LENGTH] if label else NAMES.get(self.tags[i], f"Section {number}")

    def flags(self, i: int) -> dict:
        whole = max(1.0, self.area[i])
        canvas = max((self.area[c] for c in self.below(i, ("canvas",))), default=0.0)
        frames = self.below(i, ("iframe",))
        frame = max(frames, key=lambda j: self.area[j]) if frames else None
        frame_area = self.area[frame] if frame is not None else 0.0
        images = self.below(i, ("img",))

        def side(j: int, captured: np.ndarray, attribute: str) -> float:
            given = self.attributes[j].get(attribute, "")
            return captured[j] or (float(given) if given.replace(".", "", 1).isdigit() else 0.0)

        painted = sum(side(j, self.width, "width") * side(j, self.height, "height") for j in images)
        return {
            "has_canvas": bool(canvas > 0), "canvas_dominant": bool(canvas / whole > CANVAS_SHARE), "has_iframe": bool(frame_area > 0), "iframe_dominant": bool(frame_area / whole > IFRAME_SHARE),
            "iframe_src": self.attributes[frame].get("src") if frame_area > 0 else None, "has_table": bool(self.below(i, ("table",))), "img_count": len(images),
            "img_without_alt_count": sum(not self.attributes[j].get("alt", "").strip() for j in images), "image_dominant": bool(painted / whole > IMAGE_SHARE),
        }

    def links(self, i: int) -> list[dict]:
        found = [self.attributes[j]["href"] for j in self.below(i, ("a",)) if "href" in self.attributes[j]][:MOST_LINKS]
        return [{"href": h, "is_client_route": h.startswith("#/") or h.lower().startswith("javascript:")} for h in found]

    def hidden_blocks(self) -> list[int]:
        """Elements that style hides and that hold a good deal of text, outermost first."""
        found: list[int] = []
        end = min(int(self.last[self.body]) if self.tags else 0, self.body + MOST_VISITED)
        for i in range(self.body + 1, end + 1):
            if len(found) >= MOST_HIDDEN:
                break
            if self.hidden[i] and self.tags[i] not in SKIPPED and self.tags[i] != "head" and not any(i <= self.last[f] for f in found) and len(self.hidden_text(i).split()) >= HIDDEN_WORDS:
                found.append(i)
        return found

    def box(self, i: int) -> dict:
        return {n: math.floor(v[i] + 0.5) for n, v in (("x", self.x), ("y", self.y), ("width", self.width), ("height", self.height))}

    def rows(self) -> tuple[list[dict], list[dict]]:
        """Regions and hidden blocks, in order."""
        shown = [{"region_ord": n, "selector": self.selector(i), "name": self.name(i, n), "text": " ".join(self.text(i).lower().split()), "box": self.box(i), "flags": self.flags(i), "links": self.links(i)} for n, i in enumerate(self.regions(), 1)]
        return shown, [{"block_ord": n, "selector": self.selector(i), "text": self.hidden_text(i)} for n, i in enumerate(self.hidden_blocks(), 1)]


class RenderedPage(Page):
    """A page of captured nodes: node_id in document order, parent_id, tag, attrs, x, y, width, height, hidden, and either text (as rendered, with what is below) or texts (their own, with places)."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values("node_id")
        at = {n: i for i, n in enumerate(nodes.node_id.tolist())}
        parents = [at.get(p, -1) for p in nodes.parent_id]
        last = list(range(len(parents)))
        for i in range(len(parents) - 1, -1, -1):
            if parents[i] >= 0:
                last[parents[i]] = max(last[parents[i]], last[i])
        boxes = nodes[["x", "y", "width", "height"]].to_numpy(dtype=np.float64)
        super().__init__([t.lower() for t in nodes.tag], parents, last, [dict(a) if a is not None else {} for a in nodes["attrs"]], boxes, nodes.hidden.fillna(False).astype(bool).to_numpy())
        self.whole = [t or "" for t in nodes.text] if "text" in nodes else None
        if self.whole is None:
            self._place([list(t) if t is not None else [] for t in nodes.texts])

    def _place(self, own: list[list]) -> None:
        """Own texts in the page's order, and of each node the range of those in it."""
        self.pieces = sorted(((t["at"], t) for some in own for t in some), key=lambda x: x[0])
        place = {at: n for n, (at, _) in enumerate(self.pieces)}
        self.first = [min((place[t["at"]] for t in some), default=len(place)) for some in own]
        self.end = [max((place[t["at"]] + 1 for t in some), default=0) for some in own]
        for i in range(len(own) - 1, 0, -1):
            if self.parents[i] >= 0:
                self.first[self.parents[i]], self.end[self.parents[i]] = min(self.first[self.parents[i]], self.first[i]), max(self.end[self.parents[i]], self.end[i])
        self.seen_before = np.concatenate(([0], np.cumsum([bool(t["seen"] and t["text"].strip()) for _, t in self.pieces], dtype=np.int64)))

    def filled(self, i: int) -> bool:
        if self.whole is not None:
            return super().filled(i)
        return self.first[i] < self.end[i] and bool(self.seen_before[self.end[i]] > self.seen_before[self.first[i]])

    def text(self, i: int) -> str:
        if self.whole is not None:
            return self.whole[i]
        shown = "".join(("\n" if t["breaks"] else "") + t["text"] for _, t in self.pieces[self.first[i] : self.end[i]] if t["seen"])
        return "\n".join(line for line in (SPACE.sub(" ", x).strip(" ") for x in shown.split("\n")) if line)

    def hidden_text(self, i: int) -> str:
        if self.whole is not None:
            return super().hidden_text(i)
        return "".join(t["text"] for _, t in self.pieces[self.first[i] : self.end[i]]).strip()


class SourcePage(Page):
    """A page of which only the source is there."""

    def __init__(self, tree: Tree):
        self.tree = tree
        spans = np.array(tree.spans, dtype=np.float64)
        boxes = np.column_stack((np.zeros(len(spans)), spans[:, 0], np.full(len(spans), float(WIDTH)), spans[:, 1] - spans[:, 0]))
        styles = [a.get("style", "").replace(" ", "").lower() for a in tree.attributes]
        gone = np.array(["hidden" in a or "display:none" in s for a, s in zip(tree.attributes, styles, strict=True)], dtype=bool)
        end = -1  # of what is gone already
        for i in np.flatnonzero(gone | np.array([t in SILENT or t == "head" for t in tree.tags])):
            if i > end:
                end = tree.last[i]
                boxes[i : end + 1, 2:] = 0
        self.gone = frozenset(np.flatnonzero(gone).tolist())
        super().__init__(tree.tags, tree.parents, tree.last, tree.attributes, boxes, gone | np.array(["visibility:hidden" in s for s in styles], dtype=bool))
        seen = np.array([bool(t.strip()) for t in tree.texts], dtype=bool) & self.shown[tree.text_nodes] if tree.texts else np.zeros(0, dtype=bool)
        self.texts_before = np.concatenate(([0], np.cumsum(seen)))

    def filled(self, i: int) -> bool:
        begin, end = self.tree.held[i][2:]
        return bool(self.texts_before[end] > self.texts_before[begin])

    def text(self, i: int) -> str:
        return self.tree.shown(i, self.gone)

    def own_texts(self) -> list[list[dict]]:
        """Each node's own texts: their place on the page, whether they show, and whether a block begins or ends ahead of them."""
        found: list[list[dict]] = [[] for _ in self.tags]
        breaks = False
        for kind, i in self.tree.events:
            if kind == "text":
                node = self.tree.text_nodes[i]
                found[node].append({"at": i, "text": self.tree.texts[i], "seen": bool(self.shown[node]) and node not in self.tree.ahead, "breaks": breaks})
                breaks = False
            else:
                breaks = breaks or self.tags[i] in BLOCKS
        return found

    def hidden_text(self, i: int) -> str:
        return self.tree.text_of(i).strip()


def segmented(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Regions (kind region) and hidden blocks (kind hidden) of each page of captured nodes: key and the columns of ``RenderedPage``."""
    kind = dict(nodes.dtypes)[key]

    def segment(group: pd.DataFrame) -> pd.DataFrame:
        shown, hidden = RenderedPage(group).rows()
        rows = [{"kind": "region", **r} for r in shown] + [{"kind": "hidden", "region_ord": r.pop("block_ord"), **r} for r in hidden]
        names = ("kind", "region_ord", "selector", "name", "text", "box", "flags", "links")
        return pd.DataFrame([(group[key].iloc[0], *(r.get(n) for n in names)) for r in rows], columns=[key, *names], dtype=object)

    return nodes.groupBy(key).applyInPandas(segment, f"{key} {kind}, {OUT}")


def source_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The nodes of sources as ``segmented`` and ``operators.regions`` take them, with the boxes that stand in for captured ones and their own texts alone."""
    kind = dict(pages.dtypes)[key]
    names = [key, "node_id", "parent_id", "last_id", "tag", "attrs", "x", "y", "width", "height", "hidden", "texts"]

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for page_id, source in zip(batch[key], batch[html], strict=True):
                page = SourcePage(Tree(source or ""))
                columns = (page.parents, page.last, page.tags, page.attributes, page.x, page.y, page.width, page.height, page.hidden, page.own_texts())
                for i, (parent, last, tag, attributes, *box, hidden, own) in enumerate(zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in columns), strict=True)):
                    rows.append((page_id, i, parent, last, tag, attributes, *box, hidden, own))
                    if len(rows) == NODES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows.clear()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return spread(pages.select(key, html), EACH).mapInPandas(nodes, f"{key} {kind}, node_id long, parent_id long, last_id long, tag string, attrs map<string,string>, x double, y double, width double, height double, hidden boolean, texts {TEXTS}")


CONTAINER = "struct<present:boolean,empty:boolean,words:bigint>"
REGIONS = f"array<struct<region_ord:bigint,selector:string,name:string,text:string,word_count:bigint,box:{BOX},flags:{FLAGS},links:{LINKS},container:{CONTAINER},outer_html:string>>"
HIDDEN = "array<struct<block_ord:bigint,selector:string,text:string,word_count:bigint>>"
READ = f"raw_text string, scripts string, regions {REGIONS}, hidden {HIDDEN}"


def with_containers(regions: list[dict], raw: Tree) -> list[dict]:
    """Regions with their words and with what the raw response holds at their selector."""
    out = []
    for r in regions:
        held = raw.container(r["selector"])
        out.append({**r, "word_count": count_words(r["text"]), "outer_html": held.pop("outer_html"), "container": held})
    return out


def few(batches: Iterator[pa.RecordBatch], *sources: int) -> Iterator[pa.RecordBatch]:
    """Batches of few pages, a page at least: what is read of pages takes many times their room in Python."""
    for batch in batches:
        begin = held = 0
        for i, sizes in enumerate(zip(*(pc.binary_length(batch.column(s)).to_pylist() for s in sources), strict=True)):
            size = sum(n or 0 for n in sizes)
            if i > begin and (i - begin == PAGES_TOGETHER or held + size > BYTES_TOGETHER):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def read_pages(pages: DataFrame, *, html: str = "html", raw: str = "raw_html") -> DataFrame:
    """``pages`` and what a parser reads of them, once: raw_text and scripts of the raw response, regions and hidden blocks of the rendered page.

    Each region comes with what the raw response holds at its selector. Null sources are empty pages. A page is one row in
    and one row out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [c for c in pages.columns if c not in ("raw_text", "scripts", "regions", "hidden")]
    rows = spread(pages.select(*columns), EACH)
    schema = rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("raw_text", "string"), ("scripts", "string"), ("regions", REGIONS), ("hidden", HIDDEN))]).schema
    kinds = list(to_arrow_schema(schema))[len(columns) :]
    at = (columns.index(html), columns.index(raw))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, *at):
            found: tuple[list, list, list, list] = ([], [], [], [])
            for rendered, source in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                tree = Tree(source or "")
                shown, hidden = SourcePage(tree if rendered == source else Tree(rendered or "")).rows()
                parts = (tree.raw_text(), tree.inline_scripts(), with_containers(shown, tree), [{**h, "word_count": count_words(h["text"])} for h in hidden])
                for held, part in zip(found, parts, strict=True):
                    held.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(held, k.type) for held, k in zip(found, kinds, strict=True)]], names=[*columns, "raw_text", "scripts", "regions", "hidden"])

    return rows.mapInArrow(read, schema)


def containers(captures: DataFrame, *, raw: str = "raw_html", regions: str = "regions") -> DataFrame:
    """Pages (one row each) whose captured ``regions`` get what the raw response holds at their selectors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in captures.columns if c not in (regions, "raw_text", "scripts")]
    rows = captures.select(*others, regions)
    schema = rows.select(*others, *[F.lit(None).cast(t).alias(n) for n, t in (("raw_text", "string"), ("scripts", "string"), (regions, REGIONS))]).schema
    kinds = list(to_arrow_schema(schema))[-3:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, others.index(raw)):
            found: tuple[list, list, list] = ([], [], [])
            for source, shown in zip(batch.column(others.index(raw)).to_pylist(), batch.column(len(others)).to_pylist(), strict=True):
                tree = Tree(source or "")
                for held, part in zip(found, (tree.raw_text(), tree.inline_scripts(), with_containers(shown or [], tree)), strict=True):
                    held.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.array(held, k.type) for held, k in zip(found, kinds, strict=True)]], names=[*others, "raw_text", "scripts", regions])

    return rows.mapInArrow(read, schema)
