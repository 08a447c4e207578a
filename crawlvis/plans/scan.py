"""Whole scans as one plan: captured pages in, region results, scores and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions.fence import fenced
from crawlvis.operators import pages as P
from crawlvis.operators import reporting, scoring, segmentation

#: Tags of the pages that raw responses are made from.
TAG = r"</?[a-zA-Z!][^>]*>"
ARTICLE = r"(?is)(<article\b[^>]*>)(.*?)(</article\s*>)"


def thinned(html: Column, key: Column) -> Column:
    """A raw response made from a rendered page, in four kinds by the key: whole, content in a script, empty, the first half of the paragraphs.

    Captured pairs of raw and rendered pages aren't among the tables; this gives every class of region something to find.
    """
    inner = F.regexp_extract(html, ARTICLE, 2)
    plain = F.regexp_replace(inner, TAG, " ")
    quoted = F.replace(F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    before, after = F.substring_index(html, "<article>", 1), F.regexp_extract(html, r"(?is)</article\s*>(.*)$", 1)
    wrap = lambda x: F.concat(before, F.lit("<article>"), x, F.lit("</article>"))
    script = F.concat(F.lit('<script>var data = "'), quoted, F.lit('";</script>'))
    parts = F.split(inner, "<p>")
    half = F.array_join(F.slice(parts, F.lit(1), F.ceil(F.size(parts) / 2).cast("int")), "<p>")
    kind = F.pmod(key, F.lit(4))
    return (
        F.when(kind == 1, F.concat(wrap(F.lit("")), script, after))
        .when(kind == 2, F.concat(wrap(F.lit("")), after))
        .when(kind == 3, F.concat(wrap(half), after))
        .otherwise(html)
    )


def raw_and_rendered(pages: DataFrame) -> DataFrame:
    """scan_id, url, html (as rendered) and raw_html of the table of pages."""
    return fenced(pages.select(F.col("page_id").alias("scan_id"), "url", "html"), {"raw_html": thinned(F.col("html"), F.col("scan_id"))})


def rendered_regions(pages: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Regions and hidden blocks, as rows with coverage, of pages (scan_id, url, html, raw_html) of which the rendered source is all there is.

    A page's trees are built once, its text compared with its regions in its own row; no shuffle. keep: further columns of the pages.
    """
    read = segmentation.read_pages(pages.select("scan_id", "url", "html", "raw_html", *keep)).drop("html", "raw_html")
    return scoring.region_rows(scoring.measured(read))


def captured_regions(pages_raw: DataFrame, region_captures: DataFrame, hidden_blocks: DataFrame | None = None) -> DataFrame:
    """Regions and hidden blocks, as rows with coverage, of captured scans.

    pages_raw: scan_id, url, html (the raw response that is analyzed, one a scan). region_captures: scan_id, region_ord,
    selector, name, text, box, flags, links. hidden_blocks: scan_id, block_ord, selector, text. A scan's captures, which
    segmentation bounds, are gathered to its page; a scan without captures and hidden blocks has no rows.
    """
    row = F.struct(*[F.col(c).alias(c) for c in ("region_ord", "selector", "name", "text", "box", "flags", "links")])
    shown = region_captures.groupBy("scan_id").agg(F.collect_list(row).alias("regions"))
    pages = pages_raw.select("scan_id", "url", F.col("html").alias("raw_html")).join(shown, "scan_id", "left")
    pages = pages.withColumn("regions", F.coalesce("regions", F.array().cast(shown.schema["regions"].dataType)))
    pages = pages.withColumn("regions", F.array_sort("regions", lambda a, b: F.signum(a["region_ord"] - b["region_ord"]).cast("int")))
    if hidden_blocks is None:
        pages = pages.withColumn("hidden", F.lit(None).cast(segmentation.HIDDEN))
    else:
        block = F.struct(F.col("block_ord").cast("long").alias("block_ord"), "selector", "text", T.word_count(F.col("text")).alias("word_count"))
        pages = pages.join(hidden_blocks.groupBy("scan_id").agg(F.sort_array(F.collect_list(block)).alias("hidden")), "scan_id", "left")
    pages = pages.withColumn("hidden", F.coalesce("hidden", F.array().cast(segmentation.HIDDEN)))
    return scoring.region_rows(scoring.measured(segmentation.containers(pages).drop("raw_html")))


def scanned(pages_raw: DataFrame, region_captures: DataFrame, hidden_blocks: DataFrame | None = None, probe_outcomes: DataFrame | None = None, *, told: bool = True) -> DataFrame:
    """A whole scan of captured inputs: regions and hidden blocks with class, verdict, evidence, weight and rank.

    probe_outcomes: scan_id, url, status of the routes that were asked for.
    """
    regions, clears = captured_regions(pages_raw, region_captures, hidden_blocks), None
    if probe_outcomes is not None:
        regions = scoring.probe_outcomes_joined(regions, scoring.probed(probe_outcomes, pages_raw))
        clears = F.col("probe_clears")
    return scoring.issue_order(scoring.weighed(scoring.classified(regions, clears, told=told)))


def region_results(regions: DataFrame, *, told: bool = True) -> DataFrame:
    """Region rows with coverage → regions with class, evidence (if ``told``), weight and rank."""
    return scoring.issue_order(scoring.weighed(scoring.classified(regions, told=told)))


def fingerprinted(pages: DataFrame) -> DataFrame:
    """Pages with the struct ``stack_found`` of their raw response: stack and signals."""
    return fenced(pages, {"stack_found": P.fingerprint(F.col("raw_html"))})


def with_prompts(regions: DataFrame) -> DataFrame:
    """Regions with their fix prompt. Needs outer_html, url and stack_found beside the region."""
    rows = fenced(regions, {"stack": F.col("stack_found.stack"), "signals": F.col("stack_found.signals"), "snippet": reporting.snippet(F.when(F.col("container.present"), F.col("outer_html")), F.col("selector"))}, drop=("stack_found",))
    prompt = F.when(F.col("issue_type") != "fully_visible", reporting.fix_prompt())
    return rows.withColumn("fix_prompt", prompt).drop("outer_html")


def scan_documents(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per scan with all that a fix plan or report needs. pages: scan_id, url, raw_html. regions: with prompts and ranks."""
    checks = P.checks(F.col("raw_html"), F.col("url"))
    heads = pages.select(
        "scan_id", "url", *[c.alias(n) for n, c in checks.items()], F.lit(False).alias("robots_present"), F.array().cast("array<struct<crawler:string,allowed:boolean>>").alias("robots_grid"),
        F.struct(F.lit(False).alias("present"), F.lit(None).cast("boolean").alias("links_to_path")).alias("llms"), F.timestamp_millis(F.col("scan_id").cast("long") * 3_600_000 + F.lit(1_700_000_000_000)).alias("scanned_at"),
        F.lit(None).cast("string").alias("blocked_evidence"), F.lit(None).cast("string").alias("blocked_prompt"), F.lit(None).cast("long").alias("prev_score"), F.lit(None).cast("long").alias("score_delta"),
    )
    scored = scoring.scores(regions, heads.select("scan_id")).select("scan_id", "score")
    return reporting.with_regions(heads.join(scored, "scan_id"), regions)


def host(url: Column) -> Column:
    return urls.host_of(url)
