"""Malformed and hostile pages: no text of the article is lost, no code gets in, and time is in proportion to the page."""

import time

import numpy as np
import pytest

from crawlvis.llm.dom import blocks, features, parse

CASES = (
    ("<article><h1>H</h1><p class=a don't>First paragraph is here.</p><p>Second one. It's a long one.</p><p>Third</p></article>", "H\nFirst paragraph is here.\nSecond one. It's a long one.\nThird"),
    ("<p title='a > b'>x</p>", "x"),
    ("<script src=x />var a=1;</script>ok", "ok"),
    ("<p>a<script>document.write('<body>')</script>b</p>", "ab"),
    ("<script>var s = '</style>';</script>t", "t"),
    ("<title>T<body><p>x", "x"),
    ("<iframe src=x/><p>y", "y"),
    ("a < b <3 <![CDATA[c]]> <!-- d --> e", "a < b <3 c e"),
    ("a<!-->b<!-- x --!>c<!-- never closed", "abc"),
    ("a<p>b <a href='never closed", "a\nb"),
    ("", ""),
)
PAGES = {
    "open tag": "<a " * 330_000, "comments": "<!--" * 250_000, "brackets": "<" * 1_000_000, "sections": "<![CDATA[" * 110_000, "divs": "<div>" * 100_000 + "</b>" * 120_000, "items": "<ul><li>" + "<div>" * 60_000 + "<li></li>" * 40_000,
    "titles": "<title><body>" * 70_000, "ends": "<title></titlex" * 60_000, "buttons": "<button>" * 60_000 + "<p>x" * 60_000, "headings": "<h1>" * 120_000, "quotes": '<p a="' * 160_000,
}


def all_text(page):
    nodes = parse(page)
    return blocks(nodes, np.ones(len(nodes), dtype=bool))


@pytest.mark.parametrize("page,text", CASES)
def test_text_of_malformed_pages(page, text):
    assert all_text(page) == text


@pytest.mark.parametrize("name", PAGES)
def test_a_megabyte_takes_linear_time(name):
    began = time.monotonic()
    nodes = parse(PAGES[name])
    features(nodes), blocks(nodes, np.ones(len(nodes), dtype=bool))
    assert time.monotonic() - began < 10
