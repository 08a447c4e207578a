"""Sources read in columns, against results written by hand, and sources that try to exhaust the reader."""

import time

import pytest
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions.arrays import running_least, running_sums
from crawlvis.operators.segmentation import SourcePage
from crawlvis.sources.html import Tree

CASES = (
    ("<p class=a don't>First.</p><p>It's second.</p>", "First.\nIt's second."),
    ("<div title='a > b'>x</div>", "x"),
    ('<a href="x>y">l</a>k', "lk"),
    ("<p a=\"1\"b='2'c=3/>t", "t"),
    ("<p =x=y>t", "t"),
    ("<p/ / a>t", "t"),
    ("a<!-- b > c", "a"),
    ("a<!-->b", "ab"),
    ("a<!--->b-->c", "ab-->c"),
    ("a<!-- x --!>b", "ab"),
    ("<![CDATA[x]]>y", "y"),
    ("a < b <3 </ c>d", "a < b <3 d"),
    ("<p>unclosed <a href='", "unclosed"),
    ("<title>T</title><p>x<title>in body</title>", "xin body"),
    ("<head><title>T</title></head>hello", "hello"),
    ("<script src=x />var a=1;</script>ok", "ok"),
    ("<style>p{}</style >q", "q"),
    ("<noscript><p>n</p></noscript>m", "m"),
    ("<template>a<template>b</template>c</template>d</template>e", "de"),
    ("<textarea>&lt;i> <b></textarea><iframe>a<b>&amp;</iframe>", "<i> <b>a<b>&amp;"),
    ("&amp;&ampx &notit; &copy2 &#65 &#x41; &#128; &#129; &#0; &#xD800; &#99999999999; &nosuch; &lt;b&gt;", "&&x ¬it; ©2 A A € \x81 � � � &nosuch; <b>"),
    ("x<br/>y<BR>z</br>w", "x\ny\nz\nw"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("", ""),
    (None, ""),
)


def test_text_of_malformed_pages(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i long, html string").select("i", T.raw_text(F.col("html")).alias("t"))
    assert {r["i"]: r["t"] for r in rows.collect()} == {i: t for i, (_, t) in enumerate(CASES)}


def test_scripts_of_malformed_pages(spark):
    page = "<script>a</script><script SRC=x>b</script><script data-src=1>c</script><script> </script><script type='x' src>d</script><textarea><script>e</script></textarea><script>f"
    rows = spark.createDataFrame([(page,), ("<script title='src=1'>g</SCRIPT\n>h",), (None,)], "html string").select(T.inline_scripts(F.col("html")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["a\nc\nf", "g", ""]


HOSTILE = {
    "open tag": "<a " * 330_000, "open quote": '<p a="' * 160_000, "comments": "<!--" * 250_000, "brackets": "<" * 1_000_000, "ampersands": "&" * 1_000_000, "references": "&amp" * 250_000,
    "templates": "<template></template>" * 48_000, "scripts": "<script>" * 125_000, "divs": "<div>" * 100_000 + "</b>" * 120_000, "areas": "<textarea>" + "</a " * 250_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_takes_linear_time(spark, name):
    one = spark.createDataFrame([("<p>",)], "html string").select(F.length(T.raw_text(F.col("html"))), F.length(T.inline_scripts(F.col("html"))))
    one.collect()
    began = time.monotonic()
    spark.createDataFrame([(HOSTILE[name],)], "html string").select(F.length(T.raw_text(F.col("html"))), F.length(T.inline_scripts(F.col("html")))).collect()
    assert time.monotonic() - began < 15


def test_running_values(spark):
    values = [5, -2, 7, 0, -9, 3, 3, -1, 4, 2, 6]
    for n in range(len(values) + 1):
        row = spark.range(1).select(running_sums(F.array(*map(F.lit, values[:n])).cast("array<int>")).alias("s"), running_least(F.array(*map(F.lit, values[:n])).cast("array<int>")).alias("m")).first()
        assert row["s"] == [sum(values[: i + 1]) for i in range(n)] and row["m"] == [min(values[: i + 1]) for i in range(n)]


def test_trees_read_the_same_text():
    for source, text in CASES:
        assert "\r" in (source or "") or Tree(source or "").raw_text() == text
    assert Tree("foo</div>bar").raw_text() == "foobar" and Tree("a</p>b").raw_text() == "a\nb"


DEEP = {
    "spans": "<span>x" * 120_000, "items": "<ul><li>" + "<div>" * 60_000 + "<li></li>" * 40_000, "bodies": "<body>" * 160_000, "paragraphs": "<p>" + "<i>" * 100_000 + "<p>" * 100_000,
    "siblings": "<b></b>" * 140_000, "hidden": "<div hidden>a b c" * 60_000, "attributes": "<p " + "a=1 " * 250_000 + ">", "names": "<p id=a>" * 110_000,
}


@pytest.mark.parametrize("name", [*HOSTILE, *DEEP])
def test_trees_of_a_megabyte_take_linear_time(name):
    began = time.monotonic()
    tree = Tree({**HOSTILE, **DEEP}[name])
    tree.raw_text(), tree.inline_scripts(), SourcePage(tree).rows(), tree.find("body > b:nth-of-type(77) > i")
    assert time.monotonic() - began < 10
