"""Coverage, classification, weights and scores of page regions.

Regions come as an array column beside the page's text wherever a page is one row (``measured``): a page is compared with
its own text without a shuffle, and its text is not copied to its regions. ``diffed`` does the same to regions as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions import wording as W
from crawlvis.functions.fence import fenced, let
from crawlvis.functions.template import chosen, filled, looked_up

# Limits of the classes, the share of routes and least links that make a menu of routes, and probes per region.
NEARLY_NONE, LITTLE, HALF, NEARLY_ALL = 0.15, 0.3, 0.5, 0.9
ROUTE_SHARE, ROUTE_LINKS, PROBES = 0.5, 2, 3
BLOCKED_CAP = 10

BOX = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
FLAGS = "struct<has_canvas:boolean,canvas_dominant:boolean,has_iframe:boolean,iframe_dominant:boolean,iframe_src:string,has_table:boolean,img_count:bigint,img_without_alt_count:bigint,image_dominant:boolean>"
LINKS = "array<struct<href:string,is_client_route:boolean>>"


def no_box() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in ("x", "y", "width", "height")])


def no_flags() -> Column:
    f, n = F.lit(False), F.lit(0).cast("long")
    return F.struct(f.alias("has_canvas"), f.alias("canvas_dominant"), f.alias("has_iframe"), f.alias("iframe_dominant"), F.lit(None).cast("string").alias("iframe_src"), f.alias("has_table"), n.alias("img_count"), n.alias("img_without_alt_count"), f.alias("image_dominant"))


def coverage_of(words: Column, told: Column, shingles: Column, hay_words: Column, hay_shingles: Column) -> Column:
    """The share of a text's shingles in another text; of its telling words (all its words if none tell) if it is short."""
    by_word = T.fraction(T.matched(told, hay_words), F.size(told))
    by_shingle = T.fraction(T.matched(shingles, hay_shingles), F.size(shingles))
    return F.when(F.size(words) == 0, F.lit(0.0)).when(F.size(words) >= T.SHORT_TOKENS, by_shingle).otherwise(by_word)


def with_haystacks(pages: DataFrame, raw_text: str = "raw_text", scripts: str = "scripts") -> DataFrame:
    """Pages with the distinct words and shingles of their text and of their scripts, made once per page."""
    words = fenced(pages, {"_raw": T.tokens(F.col(raw_text)), "_script": T.tokens(T.script_haystack(F.coalesce(F.col(scripts), F.lit(""))))})
    made = {"_raw_shingles": F.array_distinct(T.shingles(F.col("_raw"))), "_script_shingles": F.array_distinct(T.shingles(F.col("_script"))), "_raw": F.array_distinct("_raw"), "_script": F.array_distinct("_script")}
    return fenced(words, made)


def diffed(regions: DataFrame, text: str = "text") -> DataFrame:
    """Region rows beside their page's haystacks, with coverage and found_in_scripts."""
    rows = fenced(regions, {"_words": T.tokens(F.col(text))})
    needles = T.distinctive(F.col("_words"))
    rows = fenced(rows, {"_shingles": F.when(F.size("_words") >= T.SHORT_TOKENS, T.shingles(F.col("_words"))), "_told": F.when(F.size(needles) == 0, F.col("_words")).otherwise(needles)})
    measured = {
        "coverage": coverage_of(F.col("_words"), F.col("_told"), F.col("_shingles"), F.col("_raw"), F.col("_raw_shingles")),
        "found_in_scripts": coverage_of(F.col("_words"), F.col("_told"), F.col("_shingles"), F.col("_script"), F.col("_script_shingles")),
    }
    return fenced(rows, measured, drop=("_words", "_told", "_shingles", "_raw", "_raw_shingles", "_script", "_script_shingles"))


def _measured(text: Column, raw: Column, raw_shingles: Column, script: Column, script_shingles: Column) -> Column:
    """struct<coverage, found_in_scripts> of a text. What is used more than once is bound once."""

    def of(words: Column, needles: Column) -> Column:
        told = F.when(F.size(needles) == 0, words).otherwise(needles)
        share = lambda n, hay, hay_shingles: coverage_of(words, n["told"], n["shingles"], hay, hay_shingles)
        return let(F.struct(T.shingles(words).alias("shingles"), told.alias("told")), lambda n: F.struct(share(n, raw, raw_shingles).alias("coverage"), share(n, script, script_shingles).alias("found_in_scripts")))

    return let(T.tokens(text), lambda words: let(T.distinctive(words), lambda needles: of(words, needles)))


def measured(pages: DataFrame) -> DataFrame:
    """Pages of raw_text, scripts, and arrays ``regions`` and ``hidden``, with the arrays ``found`` (struct<coverage, found_in_scripts>) and ``hidden_found`` in the same order.

    The words and shingles of a page are made once and looked up from within its arrays; they don't leave the page's row.
    """
    hay = [F.col(c) for c in ("_raw", "_raw_shingles", "_script", "_script_shingles")]
    found = F.transform("regions", lambda r: _measured(r["text"], *hay))
    hidden = F.transform("hidden", lambda r: _measured(r["text"], *hay)["coverage"])
    return fenced(with_haystacks(pages), {"found": found, "hidden_found": hidden}, drop=("raw_text", "scripts", "_raw", "_raw_shingles", "_script", "_script_shingles"))


def region_rows(pages: DataFrame) -> DataFrame:
    """One row for each region, and after them one for each hidden block with words whose text the raw page has, beside the page's other columns.

    pages: as ``measured`` gives them. Hidden blocks have ``is_hidden``, no box, flags, links or container.
    """
    one = lambda r, m: F.struct(*[r[n].alias(n) for n in ("region_ord", "selector", "name", "text", "word_count", "box", "flags", "links", "container", "outer_html")], m["coverage"].alias("coverage"), m["found_in_scripts"].alias("found_in_scripts"), F.lit(False).alias("is_hidden"))
    none = F.lit(None)
    block = lambda h, c: F.struct(
        (F.size("regions") + h["block_ord"]).cast("long").alias("region_ord"), h["selector"].alias("selector"), filled(W.HIDDEN_NAME, selector=h["selector"]).alias("name"), h["text"].alias("text"), h["word_count"].alias("word_count"),
        no_box().alias("box"), no_flags().alias("flags"), F.array().cast(LINKS).alias("links"), none.cast("struct<present:boolean,empty:boolean,words:bigint>").alias("container"), none.cast("string").alias("outer_html"),
        c.alias("coverage"), F.lit(0.0).alias("found_in_scripts"), F.lit(True).alias("is_hidden"),
    )
    present = F.filter(F.arrays_zip(F.col("hidden").alias("h"), F.col("hidden_found").alias("c")), lambda x: (x["h"]["word_count"] > 0) & (x["c"] >= NEARLY_ALL))
    every = F.concat(F.zip_with("regions", "found", one), F.transform(present, lambda x: block(x["h"], x["c"])))
    kept = [c for c in pages.columns if c not in ("regions", "found", "hidden", "hidden_found")]
    return pages.select(*kept, F.explode(every).alias("_r")).select(*kept, "_r.*")


def is_empty_shell() -> Column:
    """Nothing to see: no words, no medium that carries content, no links."""
    f = F.col("flags")
    return (F.col("word_count") == 0) & ~f["canvas_dominant"] & ~f["iframe_dominant"] & ~(f["image_dominant"] & (f["img_without_alt_count"] > 0)) & (F.size("links") == 0)


def routes() -> Column:
    return F.filter("links", lambda link: link["is_client_route"])


def is_route_menu() -> Column:
    return (F.size("links") >= ROUTE_LINKS) & (F.try_divide(F.size(routes()).cast("double"), F.size("links").cast("double")) > ROUTE_SHARE)


def probe_candidates(base: Column) -> Column:
    """The first addresses that a region's routes resolve to; those that don't resolve aren't counted."""
    return F.slice(F.filter(F.transform(routes(), lambda link: urls.resolved(link["href"], base)), lambda u: u.isNotNull()), 1, PROBES)


def issue_type(probe_clears: Column) -> Column:
    """The first issue of the taxonomy that a region has. probe_clears: a probed route serves content of its own."""
    f, cov = F.col("flags"), F.col("coverage")
    return (
        F.when(f["iframe_dominant"] & (cov < NEARLY_NONE), F.lit("iframe_embed"))
        .when((cov < LITTLE) & (f["canvas_dominant"] | (f["image_dominant"] & (f["img_without_alt_count"] > 0))), F.lit("canvas_or_image_data"))
        .when((cov < HALF) & (F.col("found_in_scripts") >= HALF), F.lit("data_in_script_variable"))
        .when(cov < NEARLY_NONE, F.lit("js_rendered_content"))
        .when(F.coalesce(is_route_menu(), F.lit(False)) & ~F.coalesce(probe_clears, F.lit(False)), F.lit("client_side_routes"))
        .when(cov >= NEARLY_ALL, F.lit("fully_visible"))
        .otherwise(F.lit("partial_content"))
    )


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def container_note() -> Column:
    """What the region's container holds in the raw response. container: struct<present, empty, words>."""
    c, s = F.col("container"), F.col("selector")
    absent, empty, holds = W.CONTAINER
    return F.when(~c["present"], filled(absent, selector=s)).when(c["empty"], filled(empty, selector=s)).otherwise(filled(holds, selector=s, raw_words=c["words"]))


def evidence() -> Column:
    f, cov, words = F.col("flags"), F.col("coverage"), F.col("word_count")
    values = {
        "words": words, "coverage": T.percent(cov), "in_scripts": T.percent(F.col("found_in_scripts")), "container": container_note(),
        "iframe_src": F.coalesce(f["iframe_src"], F.lit("no src")), "found": rounded(cov * words), "missing": rounded((1 - cov) * words),
        "carrier": F.when(f["canvas_dominant"], F.lit(W.CARRIER[0])).otherwise(filled(W.CARRIER[1], images=f["img_without_alt_count"])),
        "routes": F.size(routes()), "links": F.size("links"),
    }
    return chosen({issue: filled(text, **values) for issue, text in W.EVIDENCE.items()}, F.col("issue_type"))


def classified(regions: DataFrame, probe_clears: Column | None = None, *, told: bool = True) -> DataFrame:
    """Regions with issue_type, status and, if it is to be ``told``, evidence; empty shells are dropped first; hidden blocks (``is_hidden``) have the last class. Needs word_count, flags, links, container, coverage."""
    is_hidden = F.col("is_hidden") if "is_hidden" in regions.columns else F.lit(False)
    kept = regions.where(is_hidden | ~is_empty_shell())
    named = fenced(kept, {"issue_type": F.when(is_hidden, F.lit("hidden_but_present")).otherwise(issue_type(F.lit(False) if probe_clears is None else probe_clears))})
    return fenced(named, {"status": looked_up(W.VERDICT_OF, F.col("issue_type"))} | ({"evidence": evidence()} if told else {}))


def probe_outcomes_joined(regions: DataFrame, probes: DataFrame, base: str = "url") -> DataFrame:
    """Regions with probe_clears: whether a probe among their first candidates found content of its own.

    probes: scan_id, url, distinct_content. Only regions that come to be probed are joined.
    """
    asked = regions.where(F.coalesce(is_route_menu(), F.lit(False)) & (F.col("coverage") >= NEARLY_NONE)).select("scan_id", "region_ord", F.explode(F.array_distinct(probe_candidates(F.col(base)))).alias("probe_url"))
    hits = asked.join(probes.select("scan_id", F.col("url").alias("probe_url"), "distinct_content"), ["scan_id", "probe_url"])
    clears = hits.groupBy("scan_id", "region_ord").agg(F.bool_or("distinct_content").alias("probe_clears"))
    return regions.join(clears, ["scan_id", "region_ord"], "left").withColumn("probe_clears", F.coalesce("probe_clears", F.lit(False)))


def probed(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """scan_id, url, distinct_content of probes (scan_id, url, status) of pages (scan_id, url): what a route serves of its own.

    A route that differs from the page by its fragment alone is the same document; others must have answered with success.
    """
    document = lambda url: F.substring_index(url, "#", 1)
    rows = probes.select("scan_id", "url", "status").join(pages.select("scan_id", F.col("url").alias("_page")), "scan_id")
    same = document(F.col("url")) == document(F.col("_page"))
    return rows.select("scan_id", "url", F.coalesce(~same & F.col("status").between(200, 299), F.lit(False)).alias("distinct_content"))


def hidden_blocks(blocks: DataFrame) -> DataFrame:
    """Hidden blocks, beside their page's haystacks, as regions of the last class: those with words whose text the raw page has."""
    rows = fenced(blocks, {"word_count": T.word_count(F.col("text"))}).where("word_count > 0")
    found = diffed(rows).where(F.col("coverage") >= NEARLY_ALL).withColumns({"found_in_scripts": F.lit(0.0), "issue_type": F.lit("hidden_but_present"), "status": F.lit("ok"), "weight": F.lit(0.0)})
    return found.withColumns({
        "name": filled(W.HIDDEN_NAME, selector=F.col("selector")), "evidence": filled(W.EVIDENCE["hidden_but_present"], words=F.col("word_count")),
        "box": no_box(), "flags": no_flags(), "links": F.array().cast(LINKS),
    })


def area() -> Column:
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.col("box.width")) * F.greatest(zero, F.col("box.height"))


def weighed(regions: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Region rows with their weight: the larger of their shares of words and area, all weights of a scan adding up to 1.

    Hidden blocks weigh nothing and take no part. Without words and area all regions weigh the same.
    """
    page = Window.partitionBy(scan)
    shown = F.col("issue_type") != "hidden_but_present"
    rows = regions.withColumns({"_area": F.when(shown, area()), "_words": F.when(shown, F.col("word_count"))})
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(page).cast("double")), F.lit(0.0))
    rows = rows.withColumn("_raw", F.when(shown, F.greatest(share("_words"), share("_area"))))
    total, n = F.sum("_raw").over(page), F.count("_raw").over(page)
    weight = F.when(~shown, F.lit(0.0)).when(total == 0, 1.0 / n).otherwise(F.try_divide(F.col("_raw"), total))
    return rows.withColumn("weight", weight).drop("_area", "_words", "_raw")


def scores(regions: DataFrame, scans: DataFrame | None = None, scan: str = "scan_id") -> DataFrame:
    """scan, score from 0 to 100, n_regions. A scan of ``scans`` without regions that show has 0; a blocked one at most 10.

    scans: the scan's key and, optionally, ``blocked``.
    """
    shown = regions.where("issue_type != 'hidden_but_present'")
    value = looked_up(W.VERDICT_VALUE, F.col("status"))
    made = shown.groupBy(scan).agg(rounded(F.round(F.sum(F.col("weight") * value * 100), 9)).alias("score"), F.count("*").alias("n_regions"))
    if scans is None:
        return made
    every = scans.join(made, scan, "left").withColumns({"score": F.coalesce("score", F.lit(0).cast("long")), "n_regions": F.coalesce("n_regions", F.lit(0).cast("long"))})
    if "blocked" not in scans.columns:
        return every
    return every.withColumn("score", F.when(F.col("blocked"), F.least(F.col("score"), F.lit(BLOCKED_CAP))).otherwise(F.col("score")))


def severity() -> Column:
    return looked_up(W.SEVERITY, F.col("status"))


def issue_order(regions: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Regions with rank: those that cost most first, ties by severity, weight and page order."""
    impact = F.round(severity() * F.col("weight"), 12)
    order = Window.partitionBy(scan).orderBy(impact.desc(), severity().desc(), F.round("weight", 12).desc(), "region_ord")
    return regions.withColumn("rank", F.row_number().over(order).cast("long"))


def fixable(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("status").isin("bad", "warn"))


def verdict_counts(regions: DataFrame, *keys: str) -> DataFrame:
    """Regions of each verdict, hidden blocks counting as visible."""
    return regions.groupBy(*keys).agg(*[F.count_if(F.col("status") == v).alias(f"n_{v}") for v in ("ok", "warn", "bad")])


def verdict_shares(regions: DataFrame, *keys: str) -> DataFrame:
    """The share of weight of each verdict, in whole percent. Without weight all are 0."""
    of = lambda v: F.sum(F.when(F.col("status") == v, F.col("weight")).otherwise(0.0))
    total = F.sum("weight")
    share = lambda v: rounded(F.round(of(v) / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100, 9)).alias(f"{v}_percent")
    return regions.groupBy(*keys).agg(*[share(v) for v in ("ok", "warn", "bad")])
