"""Top-k search, HTML extraction and WARC archives against brute force and round trips."""

import hashlib
import math
import random
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crawlvis.llm import extraction, topk, warc
from crawlvis.llm.dom import blocks, parse
from crawlvis.llm.store import new_path


def clamped(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, k):
    good = [(i, [clamped(math.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        own = [w for p, w in good if p == q]
        scores = [(max(clamped(sum(a * b for a, b in zip(v, w, strict=True))) for w in own if len(w) == len(v)), i) for i, v in good if i != q and any(len(w) == len(v) for w in own)]
        out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    r = random.Random(6)
    common = [0.5] * 10
    rows = [(i, common if r.random() < 0.3 else [r.uniform(-1, 1) for _ in range(10)]) for i in range(300)]
    rows += [(400, None), (420, [None] * 10), (440, [float("nan")] * 10), (460, [float("inf")] + [0.0] * 9), (None, common), (40, common), (41, [1.0] * 10), (500, [0.1, 0.2]), (501, [0.3, 0.4])]
    rows += [(41, common), (40, [0.9] * 10), (502, []), (520, []), (503, [1e18] * 10), (504, [-1e18, 1e18] * 5), (505, [3e7] * 10), (560, [2e17] + [0.0] * 9), (580, [5e7, -1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'a' as id")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = topk.quantized(df, 64)
    for k in (1, 20, 1000):
        got = sorted(map(tuple, topk.top_k(vectors.where("id % 20 = 0"), vectors, k).collect()))
        assert got == sorted(brute(exact, k))
    some = [x for x in exact if x[0] != 40]  # also with all in one cell
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 5000)
    vectors = vectors.where("id != 40")
    assert sorted(map(tuple, topk.top_k(vectors.where("id % 20 = 0"), vectors, 7).collect())) == sorted(brute(some, 7))
    assert topk.top_k(vectors.limit(0), vectors, 3).count() == 0 and topk.top_k(vectors, vectors.limit(0), 3).count() == 0


def test_bounds_leave_few_candidates_of_skewed_vectors():
    """Vectors with most of their mass in some dimensions: what share of all pairs is left after each step, and the same answer as without bounds."""
    r = np.random.default_rng(2)
    n, d, k = 4000, 64, 20
    c = np.floor(64 * r.normal(size=(n, d)) * 0.85 ** np.arange(d)).astype(np.int64)[:, r.permutation(d)]
    ids = np.arange(n)
    q = np.flatnonzero(ids % 20 == 0)
    seen = []
    found = topk.search_block(q, c[q], ids, c, k, seen=seen)
    left = {b: np.mean([share for at, share in seen if at == b]) for b in {at for at, _ in seen}}
    assert left[8] < 0.2 and max(left) <= 16  # then every query goes on with its own few
    score = c[q] @ c.T
    score[np.arange(len(q)), q] = -(2**60)
    want = [sorted(zip(-row, ids, strict=True))[:k] for row in score]
    assert list(zip(-found[2], found[1], strict=True)) == [x for row in want for x in row]
    floor = np.array([-row[-1][0] for row in want], dtype=float)
    carried = []
    again = topk.search_block(q, c[q], ids, c, k, floor=floor, seen=carried)
    assert all((a == b).all() for a, b in zip(found, again, strict=True)) and np.mean([x for at, x in carried if at == 8]) <= left[8]


ARTICLE = "<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Title here</h1><p>Some first paragraph of it.</p>{}</article><footer>&copy; x</footer></body></html>"
HAND = (
    ("<html><body><nav><a href=/>Home</a></nav><main><article><h1>Title &amp; more</h1><p>First  paragraph\n here.<p>Second <b>bold</b> one.</article></main><footer>&copy; x</footer>", "Title & more\nFirst paragraph here.\nSecond bold one."),
    ("<body><div class=ad>Buy now</div><article><p>Text of it &lt;tag&gt; here.</p><script>var a='</p>';</script><style>p{}</style><!-- no --></article><div id=comments><p>Nice post!</p></div></body>", "Text of it <tag> here."),
    ("<p>Only a paragraph.", "Only a paragraph."),
    ("", ""),
    (None, ""),
    ("plain text", "plain text"),
    (ARTICLE.format("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> equals mass.</p>"), "Title here\nSome first paragraph of it.\nEnergy E=m equals mass."),
    (ARTICLE.format("<p>A drawing <svg><title>no</title><text>of a house</text><path d=x /></svg> here.</p>"), "Title here\nSome first paragraph of it.\nA drawing of a house here."),
    (ARTICLE.format("<noscript><p>A picture of a cat is here.</p></noscript>"), "Title here\nSome first paragraph of it.\nA picture of a cat is here."),
    (ARTICLE.format("<aside class=pullquote>A quote from the text, enlarged.</aside>"), "Title here\nSome first paragraph of it.\nA quote from the text, enlarged."),
    (ARTICLE.format("<p><video src=x>The film can't be shown.</video> <audio>Nor the sound.</audio> <object>Nor this.</object></p>"), "Title here\nSome first paragraph of it.\nThe film can't be shown. Nor the sound. Nor this."),
    (ARTICLE.format("<button>Like<p>After a button that is left open there is more.</p>"), "Title here\nSome first paragraph of it.\nAfter a button that is left open there is more."),
    (ARTICLE.format("<select><option>one<option>two<p>After a list that is left open there is more.</p>"), "Title here\nSome first paragraph of it.\nAfter a list that is left open there is more."),
    ("<!doctype html><head><meta charset=utf-8><title>T</title><article><h1>Title here</h1><p>A head that is left open, and no body.</p></article>", "Title here\nA head that is left open, and no body."),
    (ARTICLE.format("<p>" + "many words " * 40_000 + "end.</p>"), "Title here\nSome first paragraph of it.\n" + "many words " * 40_000 + "end."),
)


def test_extraction_of_pages_by_hand(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(HAND)] + [(0, "u", HAND[0][0]), (None, None, "<p>No id.")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = extraction.extracted(df).collect()
    assert len(got) == len(HAND) + 2
    assert [(x["url"], x["text"], x["n_chars"]) for x in got if x["page_id"] is None] == [(None, "No id.", 6)]
    for x in (x for x in got if x["page_id"] is not None):
        assert x["text"] == HAND[x["page_id"]][1] and x["n_chars"] == len(x["text"])
    assert extraction.extracted(df.limit(0)).count() == 0


class Article(HTMLParser):
    """The lines of a page's article, by a parser of its own: an element that isn't inline begins a line, br is a blank."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.skipped, self.lines = 0, 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in ("script", "style")
        self.lines += [""] * (tag not in ("b", "i", "em", "a", "br", "span", "strong", "img"))
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skipped -= tag in ("script", "style")
        self.lines += [""] * (tag not in ("b", "i", "em", "a", "span", "strong"))

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.lines[-1] += data


def test_extraction_of_the_tables_pages_equals_their_articles(spark):
    """Pages that no training page was made from, each against its article element read by another parser."""
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("needs the driver's tables")
    pages = spark.read.parquet(str(path))
    got = {x["page_id"]: x["text"] for x in extraction.extracted(pages).collect()}
    for x in pages.collect():
        assert got[x["page_id"]] == "\n".join(t for t in (" ".join(line.split()) for line in Article(x["html"]).lines) if t)


def test_extraction_held_out_accuracy():
    forest, hit, total, wrong = extraction.model(), 0, 0, 0
    for seed in range(50_000, 50_120):
        page, labels = extraction.labelled(extraction.sample_page(seed))
        want = set(blocks(parse(page), np.array(labels)).split("\n"))
        got = set(extraction.main_texts([page], forest)[0].split("\n"))
        hit, total, wrong = hit + len(want & got), total + len(want), wrong + len(got - want)
    assert hit >= 0.95 * total and wrong <= 0.05 * total


def test_decoding_never_contradicts_an_ancestor():
    nodes = parse("<body><div><p>a</p><div><p>b</p></div></div><nav><p>c</p></nav></body>")
    r = np.random.default_rng(0)
    for _ in range(50):
        chosen = extraction.decode(nodes, r.normal(size=len(nodes)))
        assert all(chosen[n.parent] for i, n in enumerate(nodes) if chosen[i] and n.parent >= 0)


@pytest.mark.parametrize("page", ["<", "<<p>>", "</p></div>", "<div" * 50, "<script>", "<a href='", "&#xD800;&bogus;&#0;", "<p>" * 3000 + "x"])
def test_parser_never_fails(page):
    assert isinstance(blocks(parse(page), np.ones(len(parse(page)), dtype=bool)), str)


PAYLOADS = (
    "x" * 1200, "short", "x" * 1200, None, "é" * 700, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 1500, "x" * 1200, "\r\n\r\n", "WARC/1.1\r\n", "é" * 700, "short", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
)


def expected_records(rows):
    full = [(i, (p or "").encode()) for i, p in rows]
    out = []
    for i, p in full:
        top = max((j for j, q in full if q == p and j is not None), default=None)
        revisit = len(p) >= 1000 and top != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out)


@pytest.mark.parametrize(("compression", "split", "few"), [("gzip", "128m", 100), ("none", "700b", 100), ("gzip", "128m", 0)])
def test_archives_round_trip(spark, monkeypatch, compression, split, few):
    monkeypatch.setattr(warc, "FEW_DIGESTS", few)
    rows = list(enumerate(PAYLOADS))
    pages = spark.createDataFrame([(i, "http://x/\n" if i % 2 else None, p) for i, p in rows], "page_id long, url string, html string").selectExpr("*", "'q' as digest", "1 as salt")
    path = new_path(spark, "test-warc")
    warc.write_archives(pages.repartition(2), path, compression=compression, records_per_file=5)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == expected_records(rows)


def test_archives_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    one = spark.createDataFrame([(7, "u", "a" * 2000), (7, "u", "a" * 2000)], empty.schema)
    assert {tuple(x)[3] for x in warc.round_trip(one).collect()} == {"response"}


def test_reachable_by_jumps():
    start = np.array([0, 10, 15, 30, 45])
    assert warc.reachable(start, np.array([10, 30, 99, 60, 50])).tolist() == [True, True, False, True, False]
    assert warc.reachable(start, np.array([0, 30, 30, 45, 60])).tolist() == [True, False, False, False, False]
    n = 1000
    assert warc.reachable(np.arange(n) * 7, np.arange(1, n + 1) * 7).all()
    assert warc.reachable(np.zeros(0, dtype=int), np.zeros(0, dtype=int)).tolist() == []


def test_a_cut_archive_is_an_error():
    head = "WARC-Type: response\r\nContent-Length: 10"
    file = pd.DataFrame([("f", 0, 0, 0, 0, None, None, None, ""), ("f", 0, 1, 47, 43, 10, head, None, head + "\r\n\r\nabcd")], columns=["file", "block", "seq", "size", "head_size", "declared", "head", "digest", "value"])
    with pytest.raises(ValueError, match="cut off"):
        warc._records(file)


def test_lengths_in_payloads_carry_no_text_along(spark):
    """A payload that declares a huge record: only its own record's text goes to verification; rows without an id are responses."""
    lie = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n" + "z" * 1100
    rows = [(0, "a" * 1500), (1, "start " + lie), *((i, f"page {i} " * 200) for i in range(2, 40)), (None, "a" * 1500), (50, "a" * 1500)]
    pages = spark.createDataFrame([(i, None, p) for i, p in rows], "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    warc.write_archives(pages.coalesce(1), path)
    found = warc.candidates(warc.read_text(spark, path)).collect()
    assert sum(len(x["value"] or "") for x in found) < 2 * len(lie) + 1000
    got = [tuple(x) for x in warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = [(i, len(p), hashlib.sha1(p.encode()).hexdigest(), "revisit" if i == 0 else "response", 50 if i == 0 else None) for i, p in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
