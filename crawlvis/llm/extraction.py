"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

Each node has the log odds that it holds main text. Decoding chooses the set of nodes with the
largest sum of log odds in which no node is chosen whose parent isn't, so an ancestor and a
descendant never contradict each other. The trees are fit here, on pages that ``sample_pages``
writes with their labels: many layouts, with and without telling attributes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm import boosting
from crawlvis.llm.dom import Node, blocks, features, parse

TRAINING_PAGES = 500
#: Marks the elements of sample pages that hold no main text.
MARK = "data-no"


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice(("ka", "re", "to", "lin", "es", "mo", "ta", "un", "der", "is")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 1, 18).capitalize() + r.choice(".....!?") for _ in range(r.randint(low, high)))


def _links(r: random.Random, tag: str = "ul") -> str:
    items = [f'<a href="/{_words(r, 1, 1)}">{_words(r, 1, 3)}</a>' for _ in range(r.randint(2, 12))]
    return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>" if r.random() < 0.7 else r.choice((" | ", " ", " &middot; ")).join(items)


def _element(r: random.Random, tags: str, names: str, inner: str, *, bad: bool = True, named: float = 0.85) -> str:
    tag = r.choice(tags.split())
    attribute = f' {r.choice(("class", "id", "class"))}="{r.choice(names.split())}"' if (tag in ("div", "section", "ul", "p") and r.random() < named) or r.random() < 0.25 else ""
    if r.random() < 0.15:
        inner = f"<div>{inner}</div>"
    return f"<{tag}{attribute}{f' {MARK}=1' * bad}>{inner}</{tag}>"


def _boilerplate(r: random.Random) -> dict[str, str]:
    item = lambda: f"<p>{_sentences(r, 1, 2)}</p>" if r.random() < 0.5 else _sentences(r, 1, 2)
    return {
        "menu": _element(r, "nav nav div ul", "nav menu main-menu navbar site-nav breadcrumbs navigation top-links", _links(r)),
        "header": _element(r, "header header div", "header site-header masthead top-bar logo", r.choice((f"<h1>{_words(r, 1, 4)}</h1>", f"<a href='/'>{_words(r, 1, 3)}</a>", f"<p>{_words(r, 2, 8)}</p>")) + (_links(r) if r.random() < 0.5 else "")),
        "footer": _element(r, "footer footer div", "footer site-footer copyright bottom legal colophon", f"&copy; {_words(r, 1, 3)} &middot; {_sentences(r, 1, 3)}" + (_links(r) if r.random() < 0.4 else "")),
        "side": _element(r, "aside aside div section", "sidebar side-bar related widget right-rail recommended trending", f"<h3>{_words(r, 1, 3)}</h3>" + (_links(r) if r.random() < 0.6 else f"<p>{_sentences(r, 1, 4)}</p>")),
        "advert": _element(r, "div div aside section", "ad ads advert ad-slot banner sponsored promo advertisement ad-container", r.choice((_sentences(r, 1, 2), f"<p>{_sentences(r, 1, 3)}</p>", f"<a href='/x'>{_words(r, 2, 9)}</a>"))),
        "notice": _element(r, "div div section aside dialog p", "cookie-notice cookie-banner consent newsletter subscribe notice gdpr popup alert", item() + ("<button>OK</button>" if r.random() < 0.5 else "")),
        "form": _element(r, "form form div", "search-form login signup contact-form searchbox", f"<form {MARK}=1><label>{_words(r, 1, 3)}</label> <input name=q> {_words(r, 0, 6)}<p {MARK}=1>{_words(r, 0, 9)}</p></form>"),
        "reader": _element(r, "section div div ol", "comments comment-list reader-comments discussion responses disqus reviews", f"<h3>{_words(r, 1, 3)}</h3>" * (r.random() < 0.6) + "".join(_element(r, "div li article", "comment reply comment-body", f"<p>{_sentences(r, 1, 5)}</p>", bad=True) for _ in range(r.randint(1, 6)))),
        "script": f"<noscript {MARK}=1>{r.choice(('Please enable JavaScript.', 'This site needs JavaScript to work.', f'<p>{_sentences(r, 1, 2)}</p>'))}</noscript>",
        "choice": f"<{r.choice(('div', 'p'))}><select {MARK}=1>" + "".join(f"<option {MARK}=1>{_words(r, 1, 2)}</option>" for _ in range(r.randint(2, 6))) + f"</select> <button {MARK}=1>{_words(r, 1, 2)}</button></div>",
        "share": _element(r, "div ul p", "share social-share follow share-buttons byline author meta tags", _links(r)),
    }


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, 2, 9)}</h1>"] if r.random() < 0.8 else []
    junk = _boilerplate(r)
    for _ in range(r.choice((1, 1, 2, 3, 5, 9, 20))):
        kind = r.random()
        if kind < 0.7:
            opening = r.choice(("", "", "<b>", "<em>"))
            closing = r.choice(("</p>", "</p>", "<br>", ""))
            parts.append(f"<p>{opening}{_sentences(r, 1, r.choice((1, 4, 12)))}{closing}")
        elif kind < 0.76:
            parts.append(f"<h{r.randint(2, 4)}>{_words(r, 1, 8)}</h2>")
        elif kind < 0.84:
            parts.append("<ul>" + "".join(f"<li>{_words(r, 1, 14)}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p>{_sentences(r, 1, 4)}</p></blockquote>")
        elif kind < 0.92:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr>" for _ in range(r.randint(2, 6))) + "</table>")
        elif kind < 0.95:
            parts.append(f"<div>{_sentences(r, 1, 6)}</div>")
        elif kind < 0.955:
            parts.append(_element(r, "aside aside div blockquote", "pullquote pull-quote quote", r.choice((_sentences(r, 1, 2), f"<p>{_sentences(r, 1, 2)}</p>")), bad=False, named=1.0) if r.random() < 0.5 else f"<aside class='{r.choice(('pullquote', 'pull-quote', 'quote', 'epigraph'))}'>{_sentences(r, 1, 2)}</aside>")
        elif kind < 0.965:
            parts.append(f"<noscript><p>{_sentences(r, 1, 4)}</p></noscript>" if r.random() < 0.6 else f"<noscript>{_sentences(r, 1, 3)}</noscript>")
        elif kind < 0.98:
            parts.append(f"<p>{_sentences(r, 1, 3)} <a href='/y'>{_words(r, 1, 5)}</a> {_sentences(r, 1, 2)}</p>")
        else:
            parts.append(f"<figure><img src=x><figcaption>{_words(r, 3, 12)}</figcaption></figure>")
        if r.random() < 0.06:
            parts.append(junk[r.choice(("advert", "notice", "side", "share", "form", "menu", "choice"))])
    if r.random() < 0.12:
        parts.append(junk["reader"])
    body = "".join(parts)
    return body if r.random() < 0.93 else _sentences(r, 1, 12)


def sample_page(seed: int) -> str:
    """A page of random layout in which elements without main text carry MARK."""
    r = random.Random(seed)
    b = _boilerplate(r)
    content = _element(r, "article article main div div section", "content article post entry-content main-content story article-body post-body text", _article(r), bad=False, named=0.75)
    if r.random() < 0.3:
        content = _element(r, "main div div", "main page content container wrapper", content + (b["reader"] if r.random() < 0.3 else ""), bad=False, named=0.6)
    before = [b[k] for k in ("notice", "header", "menu", "form", "advert", "side") if r.random() < (0.3, 0.55, 0.7, 0.15, 0.5, 0.15)[("notice", "header", "menu", "form", "advert", "side").index(k)]]
    after = [b[k] for k in ("share", "reader", "side", "advert", "form", "notice", "footer") if r.random() < (0.15, 0.3, 0.4, 0.2, 0.15, 0.15, 0.8)[("share", "reader", "side", "advert", "form", "notice", "footer").index(k)]]
    if r.random() < 0.1:
        before, after = [], []
    r.shuffle(before)
    if r.random() < 0.15:
        before.insert(0, b["script"])
    body = "".join(before) + content + "".join(after)
    if r.random() < 0.25:
        body = f"<div class='{r.choice(('wrapper', 'page', 'container', 'site', 'x1'))}'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled(page: str) -> tuple[str, list[bool]]:
    """The page without marks and, for each node in page order, whether it holds main text."""
    labels: list[bool] = []
    plain = page.replace(f" {MARK}=1", "")
    nodes = parse(page.replace(f" {MARK}=1", ' hidden class-mark="1"'))
    for node in nodes:
        above = labels[node.parent] if node.parent >= 0 else True
        labels.append(above and not node.hidden)
    return plain, labels


@lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES) -> boosting.Forest:
    """The trees, fit on sample pages; the same each time."""
    rows, labels = [], []
    for seed in range(pages):
        page, y = labelled(sample_page(seed))
        rows.append(features(parse(page)))
        labels += y
    return boosting.fit(np.concatenate(rows).astype(np.float64), np.array(labels, dtype=np.float64))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The best set of nodes that holds each chosen one's parent. The root is always open, to look below it."""
    best = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    chosen = best > 0
    chosen[0] = True
    for i in range(1, len(nodes)):
        chosen[i] &= chosen[nodes[i].parent]
    return chosen


def main_texts(pages: list[str], forest: boosting.Forest) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    rows = [features(t) for t in trees]
    odds = forest.score(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        out.append(blocks(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Null html is empty; a page without main text has an empty text. Null ids and urls stay, rows that repeat are
    extracted again, an empty table gives an empty result, other columns are ignored whatever their names.

    Scripts, styles, templates, frames, titles and what is typed into forms go while parsing. Formulas, drawings, captions
    of media and what stands for scripts that don't run are text like any other.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    ids, urls = dict(pages.dtypes)[id_col], dict(pages.dtypes)[url_col]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = main_texts([h or "" for h in some.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, f"page_id {ids}, url {urls}, text string, n_chars long")
