"""Operators on small cases."""

import http.server
import ipaddress
import json
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions import wording as W
from crawlvis.operators import admission, asof, events, history, reporting, responses, scoring
from crawlvis.operators.segmentation import SourcePage, segmented
from crawlvis.plans import scan
from crawlvis.sources.html import Tree
from crawlvis.sources.tables import Settings, append, cli_json, jpeg_dimensions, jpeg_size, parsed_comparison, parsed_result
from crawlvis.sources import web
from crawlvis.sources.web import GuardedHttp, fetch
from crawlvis.streaming import scans as streams


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(("text", "words"), [("It's 4.2M — up 12%!", ["it", "s", "4", "2m", "up", "12"]), ("", []), ("one two, three!", ["one", "two", "three"])])
def test_tokens(spark, text, words):
    assert one(spark, T.tokens(F.col("t")), t=text) == words


def test_shingles_and_distinctive(spark):
    assert len(one(spark, T.shingles(F.array(*[F.lit(f"w{i}") for i in range(8)])), t=1)) == 3
    assert one(spark, T.shingles(F.array(*[F.lit("a")] * 3)), t=1) == []
    words = F.array(*[F.lit(w) for w in "the 42 shoreline which of 2m".split()])
    assert one(spark, T.distinctive(words), t=1) == ["42", "shoreline", "2m"]


@pytest.mark.parametrize(("needles", "hay", "n"), [("a b a c", "a b", 3), ("a b", "", 0), ("", "a", 0), ("a a a b b c", "a c", 4), ("x", "x y", 1)])
def test_matches_count_repeats(spark, needles, hay, n):
    array = lambda s: F.filter(F.split(F.lit(s), " "), lambda x: x != "")
    assert one(spark, T.matched(array(needles), array(hay)), t=1) == n


def regions(spark, rows):
    """rows: words, width, height, verdict."""
    data = [(1, i, w, (0, 0, a, b), s, "fully_visible") for i, (w, a, b, s) in enumerate(rows)]
    return spark.createDataFrame(data, f"scan_id long, region_ord long, word_count long, box {scoring.BOX}, status string, issue_type string")


@pytest.mark.parametrize(("rows", "score"), [
    ([(10, 10, 10, "ok"), (10, 10, 10, "bad")], 50), ([(10, 10, 10, "ok"), (10, 10, 10, "warn"), (10, 10, 10, "bad")], 50),
    ([(100, 10, 10, "ok"), (0, 100, 100, "bad")], 50), ([(10, 50, 50, "ok"), (90, 500, 500, "ok")], 100), ([], 0),
])
def test_scores(spark, rows, score):
    heads = spark.createDataFrame([(1,)], "scan_id long")
    assert scoring.scores(scoring.weighed(regions(spark, rows)), heads).collect()[0]["score"] == score


def test_equal_weights_and_the_cap(spark):
    rows = scoring.weighed(regions(spark, [(0, 0, 0, "ok"), (0, 0, 0, "ok")]))
    assert [r["weight"] for r in rows.collect()] == [0.5, 0.5]
    heads = spark.createDataFrame([(1, True)], "scan_id long, blocked boolean")
    assert scoring.scores(rows, heads).collect()[0]["score"] == 10


def test_hidden_blocks_need_their_text(spark):
    text = "The starter plan costs twelve dollars per month and includes three projects and unlimited scans for all of them"
    page = scoring.with_haystacks(spark.createDataFrame([(1, text, "")], "scan_id long, raw_text string, scripts string"))
    blocks = page.crossJoin(spark.createDataFrame([("#a", text), ("#b", "nothing of this is there at all"), ("#c", " ")], "selector string, text string"))
    got = scoring.hidden_blocks(blocks).collect()
    assert [(r["selector"], r["issue_type"], r["status"], r["weight"]) for r in got] == [("#a", "hidden_but_present", "ok", 0.0)]
    assert got[0]["name"] == "Hidden content (#a)" and got[0]["evidence"].startswith("19 words present")


def test_prompts(spark):
    row = {"url": "https://example.com/dashboard", "stack": "Next.js", "name": "Dashboard", "selector": "#app", "evidence": "412 words rendered · 0 found in initial HTML", "snippet": '<div id="app"></div>', "issue_type": "js_rendered_content"}
    df = spark.createDataFrame([row]).withColumn("signals", F.array(F.lit("Next.js runtime payload")))
    text = df.select(reporting.fix_prompt()).collect()[0][0]
    assert text.startswith("My page renders this region entirely client-side") and "Stack: Next.js (signals: Next.js runtime payload)\n" in text
    assert 'Region: "Dashboard" — selector #app\n' in text and text.endswith("avoid a flash of unstyled content.") and 'curl -A "GPTBot" "https://example.com/dashboard"' in text
    for issue in W.PROMPTS:
        assert "{" not in df.withColumn("issue_type", F.lit(issue)).select(reporting.fix_prompt()).collect()[0][0]
    assert one(spark, reporting.snippet(F.repeat(F.lit("word "), 500), F.lit("#x")), t=1).endswith("…")
    assert "absent from the raw response" in one(spark, reporting.snippet(F.lit(None).cast("string"), F.lit("#x")), t=1)


def test_markdown_is_kept_inert(spark):
    assert one(spark, T.markdown_inline(F.col("t")), t="a\n# `b` [c] | d>") == "a  b c  d"
    assert one(spark, T.fenced(F.col("t")), t="x ```` y").startswith("`````\n")
    assert one(spark, T.escaped(F.col("t")), t='<a href="&">') == "&lt;a href=&quot;&amp;&quot;&gt;"


@pytest.mark.parametrize(("href", "base", "whole"), [
    ("/a", "https://x.com/b/c?d#e", "https://x.com/a"), ("a", "https://x.com/b/c?d", "https://x.com/b/a"), ("../a", "https://x.com/b/c/d", "https://x.com/b/a"), ("#/r", "https://x.com/b#q", "https://x.com/b#/r"),
    ("?q", "https://x.com/b?c", "https://x.com/b?q"), ("//y.com/z", "https://x.com", "https://y.com/z"), ("javascript:void(0)", "https://x.com", "javascript:void(0)"), ("http://", "https://x.com", None), ("", "https://x.com/a", "https://x.com/a"),
])
def test_resolved(spark, href, base, whole):
    assert one(spark, urls.resolved(F.col("h"), F.col("b")), h=href, b=base) == whole


@pytest.mark.parametrize(("age", "hit"), [(599_000, True), (600_000, False), (-5_000, False), (0, True)])
def test_reuse_window(spark, age, hit):
    now = F.timestamp_millis(F.lit(1_700_000_000_000))
    assert one(spark, history.is_recent(F.timestamp_millis(F.lit(1_700_000_000_000 - age)), now), t=1) is hit


def test_changes_of_a_rescan(spark):
    schema = "pair_id long, region_ord long, selector string, name string, status string, issue_type string"
    prev = spark.createDataFrame([(1, 1, "#a", "App", "bad", "x"), (1, 2, "#f", "Footer", "ok", "y"), (1, 3, "#p", "Pricing plans table", "bad", "x"), (1, 4, "#s", "Sidebar", "ok", "y"), (1, 5, ".d", "Twin", "ok", "y"), (1, 6, ".d", "Twin", "bad", "y")], schema)
    next_ = spark.createDataFrame([(1, 1, "#a", "App", "ok", "y"), (1, 2, "#f", "Footer", "warn", "z"), (1, 3, "#q", "Pricing plans", "ok", "y"), (1, 4, "#c", "Comments", "ok", "y"), (1, 5, ".d", "Twin", "ok", "y"), (1, 6, ".d", "Twin", "bad", "y")], schema)
    changes = history.region_changes(prev, next_)
    got = [(r["selector"], r["change"]) for r in changes.orderBy("change_ord").collect()]
    assert got == [("#a", "improved"), ("#f", "regressed"), (".d", "unchanged"), (".d", "unchanged"), ("#q", "improved"), ("#c", "new"), ("#s", "removed")]
    counts = history.change_counts(changes, "pair_id").collect()[0]
    assert (counts["n_improved"], counts["n_regressed"], counts["n_unchanged"], counts["n_new"], counts["n_removed"]) == (2, 1, 2, 1, 1)
    assert {r["selector"]: r["change"] for r in history.regions_with_change(next_, changes).collect()}["#c"] == "new"


def test_limiter():
    stamps: list[int] = []
    assert [admission.admit(stamps, i)[0] for i in range(12)] == [True] * 10 + [False] * 2
    assert admission.admit(stamps, 59_999) == (False, 1) and admission.admit(stamps, 60_000) == (True, 0) and len(stamps) == 10


def test_queue():
    assert admission.simulate([(0, 10), (0, 10), (1, 5), (2, 5), (30, 1)]) == [(0, 10, 0), (0, 10, 0), (10, 15, 1), (10, 15, 2), (30, 31, 0)]
    assert admission.simulate([]) == []


def test_log_is_kept_for_a_while(spark):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    log = spark.createDataFrame([(1, 1, "done", 0), (2, 1, "queued", 0), (3, 1, "error", 400_000)], "scan_id long, seq long, status string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert {r["scan_id"] for r in events.kept_log(log, at(500_000)).collect()} == {2, 3}


def test_phases(spark):
    telemetry = F.struct(F.lit("u").alias("url"), F.lit(200).alias("status_code"), F.lit(9).alias("bytes"), F.lit(True).alias("blocked"), F.lit(3).alias("request_count"), F.lit(2).alias("region_count"))
    assert one(spark, events.phase_line(F.lit("rendering"), telemetry), t=1) == "HTTP 200 · 9 bytes · crawler blocked — using browser view"
    assert one(spark, events.phase_text(F.lit("queued"), F.lit(3)), t=1) == "Waiting — #3 in line"
    assert one(spark, events.skeleton_verdict(F.array(F.lit("ok"), F.lit("bad")), F.lit(3)), t=1) == "bad"
    assert one(spark, events.skeleton_verdict(F.array().cast("array<string>"), F.lit(3)), t=1) == "ok"


def test_body_cap(spark, monkeypatch):
    monkeypatch.setattr(responses, "MAX_BODY_BYTES", 4)
    got = one(spark, responses.capped_body(F.col("b")), b=b"abcdef")
    assert (got["text"], got["bytes"]) == ("abcd", 4)


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc0\x00\x11\x08" + height.to_bytes(2) + width.to_bytes(2) + b"\x03" * 10


def test_jpeg(spark):
    assert jpeg_size(jpeg(1280, 7924)) == (1280, 7924) and jpeg_size(jpeg(640, 480)) == (640, 480) and jpeg_size(b"PNG") is None and jpeg_size(b"") is None
    df = spark.createDataFrame([(jpeg(640, 480),), (b"x",), (None,)], "data binary").select(jpeg_dimensions(F.col("data")).alias("d"))
    assert [(r["d"]["width"], r["d"]["height"]) if r["d"] else None for r in df.collect()][0] == (640, 480)


def test_settings():
    assert Settings.read({}) == Settings() and Settings.read({"REWRITER_API_KEY": ""}).rewriter_key is None
    assert Settings.read({"ALLOW_LOCAL_TARGETS": "true", "SCAN_TIMEOUT_MS": "100"}).scan_timeout_ms == 100
    for wrong in ({"SCAN_TIMEOUT_MS": "soon"}, {"ALLOW_LOCAL_TARGETS": "perhaps"}):
        with pytest.raises(ValueError, match="must be"):
            Settings.read(wrong)


def test_stored_results(spark):
    box = {"x": 0, "y": 0, "width": 1, "height": 1}
    region = {"selector": "#a", "name": "A", "status": "ok", "issueType": "i", "coverage": 1, "evidence": "e", "boundingBox": box, "weight": 1, "wordCount": 3}
    good = {"url": "u", "finalUrl": "u", "scannedAt": "t", "score": 5, "regions": [region], "rawText": "r", "pageHeight": 1, "viewportWidth": 1, "more": 1}
    bad = [{**good, "score": None}, {**good, "regions": [{**region, "status": "odd"}]}, {"url": "u"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in (good, *bad)] + [("{",), (None,)], "blob string")
    assert [r["ok"] for r in df.select(parsed_result(F.col("blob")).isNotNull().alias("ok")).collect()] == [True, False, False, False, False, False]
    compared = {"prevScanId": "p", "prevScore": 1, "nextScore": 2, "scoreDelta": 1, "regions": [{"selector": "s", "change": "new"}]}
    df = spark.createDataFrame([(json.dumps(compared),), ("{}",)], "blob string")
    assert [r["ok"] for r in df.select(parsed_comparison(F.col("blob")).isNotNull().alias("ok")).collect()] == [True, False]
    assert json.loads(one(spark, cli_json(F.struct(F.lit("abc").alias("raw_text"), F.lit(1).alias("score"))), t=1)) == {"score": 1, "raw_text_chars": 3}


def test_appended_rows(spark, tmp_path):
    schema = "scan_id long, version long, status string"
    for rows in ([(1, 1, "queued"), (2, 1, "queued")], [(1, 2, "done")]):
        append(spark.createDataFrame(rows, schema), str(tmp_path / "scans"))
    got = history.latest_rows(spark.read.parquet(str(tmp_path / "scans"))).collect()
    assert {r["scan_id"]: r["status"] for r in got} == {1: "done", 2: "queued"}


def test_trees():
    page = '<html><head><title>T</title></head><body><main><div id="a"><p>one<p>two</div><div class="x y">three</div></main><script>var a = "</p>";</script></body></html>'
    tree = Tree(page)
    assert tree.raw_text() == "one\ntwo\nthree" and tree.inline_scripts() == 'var a = "</p>";'
    assert tree.text_of(tree.find("#a")) == "onetwo" and tree.text_of(tree.find("main > div:nth-of-type(2)")) == "three" and tree.find("div.x") == tree.find("main > div:nth-of-type(2)")
    assert tree.find("#none") is None and tree.find("a[b]") is None
    assert page[slice(*tree.spans[tree.find("#a")])] == '<div id="a"><p>one<p>two</div>'


def test_segmentation(spark):
    columns = "page_id long, node_id long, parent_id long, tag string, attrs map<string,string>, x double, y double, width double, height double, text string, hidden boolean"
    rows = [
        (1, 1, 0, "html", {}, 0, 0, 1280, 2000, "", False), (1, 2, 1, "body", {}, 0, 0, 1280, 2000, "", False), (1, 3, 2, "nav", {}, 0, 0, 1280, 60, "Home", False), (1, 4, 3, "a", {"href": "#/x"}, 0, 0, 10, 10, "Home", False),
        (1, 5, 2, "div", {}, 0, 60, 1280, 1800, "all", False), (1, 6, 5, "section", {"id": "s"}, 0, 60, 1280, 600, "Alpha  Text", False), (1, 7, 6, "h2", {}, 0, 60, 1280, 40, "Alpha", False), (1, 8, 5, "section", {}, 0, 660, 1280, 600, "B", False),
        (1, 9, 8, "canvas", {}, 0, 660, 1280, 500, "", False), (1, 10, 5, "div", {}, 0, 1260, 1280, 300.5, "C", False), (1, 11, 5, "div", {}, 0, 1560, 1280, 10, "low", False), (1, 12, 2, "div", {}, 0, 0, 0, 0, "w " * 31, True),
        (1, 13, 12, "p", {}, 0, 0, 0, 0, "w " * 31, True),
    ]
    got = segmented(spark.createDataFrame([tuple(float(v) if 5 <= i <= 8 else v for i, v in enumerate(r)) for r in rows], columns)).orderBy("kind", "region_ord").collect()
    shown = [(r["selector"], r["name"]) for r in got if r["kind"] == "region"]
    assert shown == [("body > nav", "Navigation"), ("#s", "Alpha"), ("body > div:nth-of-type(1) > section:nth-of-type(2)", "Section 3"), ("body > div:nth-of-type(1) > div:nth-of-type(1)", "Section 4")]
    by = {r["selector"]: r for r in got}
    assert by["#s"]["text"] == "alpha text" and by["body > div:nth-of-type(1) > section:nth-of-type(2)"]["flags"]["canvas_dominant"]
    assert by["body > nav"]["links"][0]["is_client_route"] and by["body > div:nth-of-type(1) > div:nth-of-type(1)"]["box"]["height"] == 301
    assert [r["selector"] for r in got if r["kind"] == "hidden"] == ["body > div:nth-of-type(2)"]


def test_live_fetch_refuses_what_it_must():
    assert fetch("ftp://x/", "a")[-1] == "ssrf_blocked" and fetch("http://127.0.0.1:9/", "a")[-1] == "ssrf_blocked" and fetch("http://no-such-host.invalid/", "a")[-1] == "dns_or_network"
    assert GuardedHttp.name() == "guarded_http"


def test_frames_go_over_the_wire(spark):
    assert one(spark, events.frame(F.struct(F.lit("done").alias("status")), F.lit(4)), t=1) == 'id: 4\ndata: {"status":"done"}\n\n'


def test_greedy_likeness_takes_the_first_of_equals():
    group = pd.DataFrame({"pair_id": 1, "prev_ord": [1, 2, 1], "next_ord": [1, 1, 2], "similarity": [0.7, 0.7, 0.9]})
    assert history._greedy(group)[["prev_ord", "next_ord"]].to_numpy().tolist() == [[1, 1]]


PAGES = {
    "several navs and nested articles": (
        "<html><head><title>T</title></head><body><header id='top'><nav>" + "Home " * 20 + "</nav></header><nav aria-label='Second menu'>" + "Docs " * 20 + "</nav>"
        "<main><article><h2>First story</h2><p>" + "alpha " * 40 + "</p><article><h3>Inner</h3>" + "beta " * 30 + "</article></article><article>" + "gamma " * 50 + "</article><section>" + "delta " * 30 + "</section>"
        "<aside>" + "inside main " * 10 + "</aside></main><footer>© x</footer></body></html>",
        [("#top", "Header"), ("body > nav", "Second menu"), ("body > main > article:nth-of-type(1)", "First story"), ("body > main > article:nth-of-type(2)", "Article"), ("body > main > section", "Section 5"), ("body > main > aside", "Sidebar"), ("body > footer", "Footer")],
    ),
    "one shell around all": (
        "<body><div class='app'><div class='wrap'><section id='a'>" + "one " * 40 + "</section><section>" + "two " * 40 + "</section><div>" + "three " * 30 + "</div><div>low</div></div></div></body>",
        [("#a", "Section 1"), ("body > div > div > section:nth-of-type(2)", "Section 2"), ("body > div > div > div:nth-of-type(1)", "Section 3")],
    ),
    "nothing": ("", []),
    "text alone": ("just words " * 30, []),
    "hidden parts": ("<body><div style='display: none'>" + "secret " * 40 + "</div><div>" + "shown " * 40 + "</div><p hidden>" + "more " * 40 + "</p></body>", [("body > div:nth-of-type(2)", "Section 1")]),
}


@pytest.mark.parametrize("name", PAGES)
def test_source_pages_are_segmented(name):
    page, want = PAGES[name]
    shown, hidden = SourcePage(Tree(page)).rows()
    assert [(r["selector"], r["name"]) for r in shown] == want
    assert [h["selector"] for h in hidden] == (["body > div:nth-of-type(1)", "body > p"] if name == "hidden parts" else [])
    assert all("secret" not in r["text"] for r in shown)
    for r in shown:  # selectors lead back to where they were made
        tree = Tree(page)
        assert tree.spans[tree.find(r["selector"])][0] == r["box"]["y"]


def test_regions_are_capped_by_area_and_follow_the_page():
    page = "<body><main>" + "".join(f"<section>{'w' * (100 + 7 * ((i * 11) % 30))}</section>" for i in range(30)) + "</main></body>"
    shown, _ = SourcePage(Tree(page)).rows()
    assert len(shown) == 24 and [r["box"]["y"] for r in shown] == sorted(r["box"]["y"] for r in shown)
    assert min(r["box"]["height"] for r in shown) > 100 + 7 * 5


def random_page(r, depth=0):
    tags = ("div", "section", "article", "nav", "aside", "header", "footer", "p", "ul", "span", "main", "table")
    inner = "".join(random_page(r, depth + 1) for _ in range(r.choice((0, 1, 2, 3, 4) if depth < 4 else (0,))))
    tag = r.choice(tags)
    return f"<{tag}>{'x y ' * r.choice((0, 5, 30))}{inner}</{tag}>"


def test_choosing_regions_equals_pairwise_tests():
    """The interval tests against comparing every node with every other."""
    r = random.Random(12)
    for _ in range(150):
        page = SourcePage(Tree("<body>" + "".join(random_page(r) for _ in range(r.randrange(6))) + "</body>"))
        n = len(page.tags)
        inside = lambda a, b, page=page: a <= b <= page.last[a]
        chosen = np.array([r.random() < 0.3 for _ in range(n)])
        assert page.outermost(chosen).tolist() == [bool(chosen[i]) and not any(chosen[j] and j != i and inside(j, i) for j in range(n)) for i in range(n)]
        assert page.apart(chosen).tolist() == [not any(chosen[j] and (inside(j, i) or inside(i, j)) for j in range(n)) for i in range(n)]
        found = page.regions()
        assert not any(inside(a, b) for a in found for b in found if a != b) and all(page.shown[i] for i in found)


def test_readers_of_sources(spark):
    cases = [
        ("<p title='a>b'>t</p>", "t"), ("<title>T</title><p>body", "body"), ("<p>caf&eacute; &#233;&#xE9; &#150; &notanentity; &nosuch; &amp;lt; a&b &#0;", "café éé – ¬anentity; &nosuch; &lt; a&b �"),
        ("<head><style>x</style></head><body>a<!-- > --><br>b<noscript>no</noscript>", "a\nb"), ("a<script>var x = '<p>';</script>b", "ab"), ("<div>a</div>tail<", "a\ntail<"), (None, ""), ("", ""),
        ("x" * 200_000 + "<p " + "a='b' " * 2000 + ">y", "x" * 200_000 + "\ny"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i long, html string").select("i", T.raw_text(F.col("html")).alias("t"))
    for row in df.collect():
        assert row["t"] == cases[row["i"]][1]
    for html, text in cases:
        if html and "&#150" not in html:
            assert Tree(html).raw_text() == text


def test_bodies_are_cut_and_read_leniently(spark, monkeypatch):
    cases = [(b"abcd\xc3\xa9", "abcd"), (b"ab", "ab"), (b"\xff\xfea", "��a"), (b"abc\xf0\x9f\x98\x80z", "abc"), ("abcé".encode(), "abcé"), (b"abc\xe2\x82", "abc�"), (None, None), (b"", "")]
    monkeypatch.setattr(responses, "MAX_BODY_BYTES", 5)
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i long, body binary").select("i", responses.capped_body(F.col("body")).alias("r"))
    for row in df.collect():
        assert row["r"]["text"] == cases[row["i"]][1] and row["r"]["bytes"] == (None if cases[row["i"]][0] is None else min(5, len(cases[row["i"]][0])))


def test_a_hostile_script_does_not_stop_a_scan(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<body><p>" + "word " * 40 + "</p></body>", r"<script>var a = 'a\ud83d b \uDC00';</script>")], "scan_id long, url string, html string, raw_html string")
    rows = scan.region_results(scan.rendered_regions(pages)).collect()
    assert [r["issue_type"] for r in rows] == ["js_rendered_content"]


def test_captured_scans_reach_every_class(spark):
    """One scan of captured inputs with a region of each class and a hidden block; expectations are the classes' definitions."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    plain = dict(has_canvas=False, canvas_dominant=False, has_iframe=False, iframe_dominant=False, iframe_src=None, has_table=False, img_count=0, img_without_alt_count=0, image_dominant=False)
    route = [("#/a", True), ("#/b", True)]
    half = words("half", 20)
    regions = [
        ("#frame", words("frame", 20), {**plain, "iframe_dominant": True, "iframe_src": "https://x.example/"}, [], "iframe_embed"), ("#canvas", words("canvas", 20), {**plain, "canvas_dominant": True}, [], "canvas_or_image_data"),
        ("#script", words("script", 20), plain, [], "data_in_script_variable"), ("#late", words("late", 20), plain, [], "js_rendered_content"), ("#menu", words("menu", 20), plain, route, "client_side_routes"),
        ("#seen", words("seen", 20), plain, [], "fully_visible"), ("#half", half, plain, [], "partial_content"), ("#empty", "", plain, [], None),
    ]
    raw = f"<body><div id='frame'></div><div id='menu'>{words('menu', 20)}</div><div id='seen'>{words('seen', 20)}</div><p>{' '.join(half.split()[:14])}</p><div>{words('secret', 40)}</div><script>var d = '{words('script', 20)}'</script></body>"
    schema = f"scan_id long, region_ord long, selector string, name string, text string, box {scoring.BOX}, flags {scoring.FLAGS}, links {scoring.LINKS}"
    captures = spark.createDataFrame([(1, i, s, s, t, (0, i, 100, 100), tuple(f.values()), links) for i, (s, t, f, links, _) in enumerate(regions, 1)], schema)
    pages = spark.createDataFrame([(1, "https://page.example/x", raw), (2, "https://page.example/none", "")], "scan_id long, url string, html string")
    hidden = spark.createDataFrame([(1, 1, "#secret", words("secret", 40)), (1, 2, "#other", words("other", 40)), (1, 3, "#void", " ")], "scan_id long, block_ord long, selector string, text string")
    for status, url, menu in ((200, "https://page.example/x#/a", "client_side_routes"), (200, "https://other.example/a", "client_side_routes")):
        probes = spark.createDataFrame([(1, url, status)], "scan_id long, url string, status long")
        rows = {r["selector"]: r for r in scan.scanned(pages, captures, hidden, probes).collect()}
        want = {s: c for s, _, _, _, c in regions if c} | {"#menu": menu, "#secret": "hidden_but_present"}
        assert {s: r["issue_type"] for s, r in rows.items()} == want
    assert rows["#secret"]["weight"] == 0 and abs(sum(r["weight"] for r in rows.values()) - 1) < 1e-9 and rows["#secret"]["rank"] == len(rows)
    assert "is absent from the raw response" in rows["#canvas"]["evidence"] and "is absent from the raw response" in rows["#late"]["evidence"]
    javascript = captures.withColumn("links", F.when(F.size("links") > 0, F.array(F.struct(F.lit("javascript:go").alias("href"), F.lit(True).alias("is_client_route")), F.struct(F.lit("#/b").alias("href"), F.lit(True).alias("is_client_route")))).otherwise(F.col("links")))
    probes = spark.createDataFrame([(1, "javascript:go", 204)], "scan_id long, url string, status long")
    assert {r["selector"]: r["issue_type"] for r in scan.scanned(pages, javascript, hidden, probes).collect()}["#menu"] == "fully_visible"
    assert scan.scanned(pages, captures.limit(0)).count() == 0
    assert [r["issue_type"] for r in scan.scanned(pages, captures.limit(0), hidden).collect()] == ["hidden_but_present"]


def test_last_before_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(asof, "BUCKET_MS", 7)
    r = random.Random(4)
    rows = [(r.choice(("a", "b", None)), r.randrange(60) if r.random() < 0.95 else None, i, r.randrange(100) if r.random() < 0.4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, n long, v long")
    got = {x["n"]: x["before"] for x in asof.last_before(df, "key", F.col("at"), ("at", "n"), F.col("v"), "before").collect()}
    want = {}
    for key in ("a", "b", None):
        last = None
        for _, at, n, v in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1], x[2])):
            want[n] = last
            last = v if v is not None else last
    assert got == want


def test_a_limiters_log_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(admission, "BUCKET_MS", 90_000)
    monkeypatch.setattr(admission, "ROWS_PER_RUN", 5)
    r = random.Random(6)
    rows, at = [], {"a": 0, "b": 0, None: 0}
    for i in range(400):
        ip = r.choice(("a", "a", "b", None))
        at[ip] += r.choice((0, 500, 3000, 9000, 59_999, 60_000, 400_000)) if r.random() < 0.5 else 1000
        rows.append((i, ip, at[ip]))
    df = spark.createDataFrame(rows, "req_id long, ip string, ms long").select("req_id", "ip", F.timestamp_millis("ms").alias("ts"))
    got = {x["req_id"]: (x["allowed"], x["retry_after"]) for x in admission.rate_limited(df).collect()}
    stamps = {ip: [] for ip in at}
    assert got == {i: admission.admit(stamps[ip], ms) for i, ip, ms in rows}


def test_places_in_line(spark):
    rows = [(i, ("waiting", "running", "done", None)[i * 7 % 4], (i * 37) % 50) for i in range(200)]
    got = {x["scan_id"]: x["position"] for x in admission.queue_positions(spark.createDataFrame(rows, "scan_id long, state string, enqueued_at long")).collect()}
    line = [i for _, i in sorted((at, i) for i, s, at in rows if s == "waiting")]
    assert got == {i: line.index(i) + 1 if s == "waiting" else 0 if s == "running" else None for i, s, _ in rows}


def test_live_fetching_of_a_local_server(spark):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.strip("/").split("?")[0] or 0)
            self.send_response(302 if n else 200)
            self.send_header(*(("Location", f"/{n - 1}") if n else ("Content-Type", "text/html")))
            self.end_headers()
            if not n:
                self.wfile.write(f"<p>{self.headers['Host']} {self.headers['User-Agent']}</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://localhost:{server.server_port}"
    requests = spark.createDataFrame([(f"{base}/{n}", "bot") for n in (0, 2, 5, 6)] + [("ftp://x/", "bot"), ("http://", "bot"), ("nonsense", "bot")], "url string, agent string")
    got = {x["requested_url"]: x for x in web.fetched(requests, allow_local=True).collect()}
    assert [got[f"{base}/{n}"]["error_type"] for n in (0, 2, 5, 6)] == [None, None, None, "dns_or_network"]
    assert got[f"{base}/2"]["redirects"] == [f"{base}/2", f"{base}/1"] and got[f"{base}/2"]["final_url"] == f"{base}/0" and got[f"{base}/2"]["status"] == 200
    assert got[f"{base}/0"]["html"] == f"<p>localhost:{server.server_port} bot</p>" and got["ftp://x/"]["error_type"] == got["nonsense"]["error_type"] == "ssrf_blocked" and got["http://"]["error_type"] == "dns_or_network"
    assert {x["error_type"] for x in web.fetched(requests.limit(1)).collect()} == {"ssrf_blocked"}
    server.shutdown()


def test_addresses_are_judged_alike_on_columns_and_in_fetching(spark):
    from crawlvis.plans import fixtures

    for address, private in (*fixtures.V4, *fixtures.V6):
        if address.strip("[]").count(".") == 3 or ":" in address:
            try:
                parsed = ipaddress.ip_address(address.strip("[]"))
            except ValueError:
                continue
            assert web.is_private(parsed) == private, address


def test_frames_are_written_once_per_client(spark, tmp_path):
    clients = spark.createDataFrame([(1, 7, 0), (2, 7, 2)], "client_id long, scan_id long, last_event_id long")
    sink = streams.frames_sink(clients, str(tmp_path))
    event = lambda *seqs: spark.createDataFrame([(7, s, "done" if s == 4 else "fetching") for s in seqs], "scan_id long, seq long, status string")
    for epoch, seqs in enumerate(((1, 2), (2, 3), (3, 4))):
        sink(event(*seqs), epoch)
    sink(event(3, 4), 2)  # again, after a failure
    got = sorted((x["client_id"], x["seq"]) for x in spark.read.parquet(f"{tmp_path}/epoch=*").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_no_source_stops_the_parser():
    bits = "< </ > <! <![ <![if <![CDATA[ ]]> <!-- --> <? ?> <p> <p a=' \" ' = <script> </script> <style> </style <title> </title> <textarea> & &# &#x &#xD800; &#99999999999; x é \x00 <table> <tr> <td> <li> <ul> </ul> <body> <html> <head> <svg> <br/> /> <nav> <main> <h1> <noscript> <template> <plaintext> <select> <option> <iframe> <!DOCTYPE hidden".split(" ")
    r = random.Random(1)
    for _ in range(2000):
        source = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        tree = Tree(source)
        shown, _ = SourcePage(tree).rows()
        assert isinstance(tree.raw_text() + tree.inline_scripts(), str)
        assert all(0 <= a <= b <= len(source) for a, b in tree.spans)


def test_hostile_sources_do_not_exhaust_the_reader(spark):
    cases = ["<p " + "a='b' " * 20_000 + ">y", "<p " + "a'" * 20_001 + ">y", "<" * 50_000, "<div>" * 20_000 + "y", "<script " + "a='b' " * 20_000 + ">x</script>y", "\\ud83d" * 10_000 + "y"]
    rows = spark.createDataFrame([(x,) for x in cases], "h string").select(T.raw_text(F.col("h")).alias("t"), T.unescaped(T.inline_scripts(F.col("h"))).alias("s")).collect()
    assert [r["t"][-1:] for r in rows] == ["y", "y", "<", "y", "y", "y"]


def test_pairs_by_words_have_the_likeness_of_their_names(spark):
    r = random.Random(3)
    rows = lambda: spark.createDataFrame([(p, i, " ".join(r.choice("Alpha beta GAMMA delta epsilon".split()) for _ in range(r.randint(0, 4)))) for p in range(3) for i in range(12)], "pair_id long, region_ord long, name string")
    prev, next_ = rows(), rows()
    every = prev.alias("a").join(next_.alias("b"), "pair_id").select("pair_id", F.col("a.region_ord"), F.col("b.region_ord"), F.round(history.name_similarity(F.col("a.name"), F.col("b.name")), 9).alias("s")).where("s > 0")
    got = history.name_pairs(prev, next_).withColumn("similarity", F.round("similarity", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
