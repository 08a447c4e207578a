"""Regions, media, links, texts and hidden blocks in windows against the same read page by page."""

import random

import pytest
from pyspark.sql import functions as F

from crawlvis.operators import regions, segmentation
from crawlvis.operators.segmentation import SourcePage
from crawlvis.sources.html import Tree

TAGS = "div section article main header nav footer aside p b span ul li table tr td h1 h2 form figure canvas iframe img a script style template br".split()


def page(r):
    def element(depth):
        tag = r.choice(TAGS)
        attributes = r.choice(["", ' id="%d"' % r.randint(0, 9), ' hidden', ' style="display:none"', ' style="visibility:hidden"', ' href="#/x"', ' href="/y" alt=" "', ' src="s" alt="t" width="30" height="4.5"', ' aria-label="Name"'])
        inner = "".join(element(depth + 1) if r.random() < 0.6 else r.choice(["text ", "x" * r.randint(1, 90), " ", "&amp; é ", "many words " * 20]) for _ in range(r.randint(0, 4 if depth < 6 else 0)))
        return f"<{tag}{attributes}>" if tag in ("img", "br") else f"<{tag}{attributes}>{inner}" + (f"</{tag}>" if r.random() < 0.9 else "")

    return r.choice(["<html><body>", "", "<title>t</title>"]) + "".join(element(0) for _ in range(r.randint(0, 6)))


@pytest.fixture(scope="module")
def sources():
    r = random.Random(7)
    return {i: page(r) for i in range(250)} | {1000: "", 1001: "just text " * 30, 1002: "<main>" + "<p>" + "x" * 100 + "</p>" * 2 + "</main>"}


@pytest.fixture(scope="module")
def nodes(spark, sources):
    rows = segmentation.source_nodes(spark.createDataFrame([*sources.items(), (1003, None)], "page_id long, html string"))
    return rows.withColumn("extra", F.lit(1)).cache()


@pytest.fixture(scope="module")
def by_page(sources):
    return {i: SourcePage(Tree(source)).rows() for i, source in sources.items()}


def test_regions(nodes, by_page):
    found = regions.regions(nodes)
    rows = found.join(regions.texts(nodes, found), ["page_id", "region_ord"], "left").collect()
    got = sorted((r["page_id"], r["region_ord"], int(r["y"] + 0.5), int(r["height"] + 0.5), r["text"] or "") for r in rows)
    assert got == sorted((i, r["region_ord"], r["box"]["y"], r["box"]["height"], r["text"]) for i, (shown, _) in by_page.items() for r in shown) and len(got) > 200


def test_media_and_links(nodes, by_page):
    found = regions.regions(nodes)
    names = ["has_canvas", "canvas_dominant", "has_iframe", "iframe_dominant", "iframe_src", "has_table", "img_count", "img_without_alt_count", "image_dominant"]
    got = {(r["page_id"], r["region_ord"]): {n: r[n] for n in names} for r in regions.media_flags(nodes, found).collect()}
    assert got == {(i, r["region_ord"]): r["flags"] for i, (shown, _) in by_page.items() for r in shown}
    assert any(f["canvas_dominant"] for f in got.values()) and any(f["has_table"] for f in got.values()) and any(f["iframe_dominant"] for f in got.values())
    links = {}
    for r in sorted(regions.links(nodes, found).collect(), key=lambda r: r["link_ord"]):
        links.setdefault((r["page_id"], r["region_ord"]), []).append({"href": r["href"], "is_client_route": r["is_client_route"]})
    assert links == {(i, r["region_ord"]): r["links"] for i, (shown, _) in by_page.items() for r in shown if r["links"]}


def test_hidden_blocks(nodes, by_page):
    got = sorted((r["page_id"], r["block_ord"], r["text"]) for r in regions.hidden_blocks(nodes).collect())
    assert got == sorted((i, h["block_ord"], h["text"]) for i, (_, hidden) in by_page.items() for h in hidden) and len(got) > 20


def test_segments_of_own_texts(nodes, by_page):
    rows = segmentation.segmented(nodes).collect()
    got = sorted((r["page_id"], r["region_ord"], r["selector"], r["name"], r["text"]) for r in rows if r["kind"] == "region")
    assert got == sorted((i, r["region_ord"], r["selector"], r["name"], r["text"]) for i, (shown, _) in by_page.items() for r in shown)
    assert sorted((r["page_id"], r["region_ord"], r["text"]) for r in rows if r["kind"] == "hidden") == sorted((i, h["block_ord"], h["text"]) for i, (_, hidden) in by_page.items() for h in hidden)
