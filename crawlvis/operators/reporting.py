"""Fix prompts, fix plans and reports as text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions import wording as W
from crawlvis.functions.template import chosen, filled, looked_up
from crawlvis.operators import scoring

# The length of a quoted snippet.
SNIPPET = 600
TITLE = "Crawler visibility"


def snippet(outer_html: Column, selector: Column) -> Column:
    """A region's raw source on one line, cut at the cap; a note where the raw response lacks it."""
    line = T.one_line(outer_html)
    cut = F.when(F.length(line) > SNIPPET, F.concat(F.substring(line, 1, SNIPPET), F.lit("…"))).otherwise(line)
    return F.coalesce(cut, filled(W.SNIPPET_ABSENT, selector=selector))


def fix_prompt(enhance: Callable[[Column], Column] = lambda prompt: prompt) -> Column:
    """The prompt of a region's issue. Needs url, stack, signals, name, selector, evidence, snippet, issue_type.

    enhance: what to make of the finished text; nothing by default.
    """
    c = F.col
    signals = F.when(F.size("signals") > 0, F.concat(F.lit(" (signals: "), F.array_join("signals", ", "), F.lit(")"))).otherwise(F.lit(""))
    values = {"url": c("url"), "stack": c("stack"), "signals": signals, "name": c("name"), "selector": c("selector"), "evidence": c("evidence"), "snippet": c("snippet")}

    def prompt(issue: str) -> Column:
        opening, body, what, end = W.PROMPTS[issue]
        text = W.PROMPT_HEADER.replace("{opening}", opening) + "\n\n" + body
        if what:
            text += "\n" + W.PROMPT_VERIFY.replace("{what}", what)
        return filled(text + (f"\n\n{end}" if end else ""), **values)

    return enhance(chosen({issue: prompt(issue) for issue in W.PROMPTS}, c("issue_type")))


def http_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def check_lines() -> Column:
    """Lines of the page-level checks. Needs robots_present, robots_grid, llms, and the checks' columns."""
    c = F.col
    told = lambda x, yes, no: F.when(x, F.lit(yes)).otherwise(F.lit(no))
    cells = F.transform("robots_grid", lambda e: F.concat(F.lit("  - "), e["crawler"], F.lit(": "), told(e["allowed"], "allowed", "disallowed")))
    llms = F.when(c("llms.present"), F.concat(F.lit("present"), told(F.coalesce(c("llms.links_to_path"), F.lit(False)), ", links to this page", ""))).otherwise(F.lit("not found"))
    return F.concat(
        F.array(F.concat(F.lit("- robots.txt: "), told(c("robots_present"), "present", "not found"))),
        F.when(c("robots_present"), cells).otherwise(F.array().cast("array<string>")),
        F.array(
            F.concat(F.lit("- llms.txt: "), llms),
            F.concat(F.lit("- JSON-LD structured data: "), told(c("has_json_ld"), "present", "none found")),
            F.concat(F.lit("- <title>: "), told(c("has_title"), "present", "missing")),
            F.concat(F.lit("- meta description: "), told(c("has_meta_description"), "present", "missing")),
            F.concat(F.lit("- sitemap reference: "), told(c("has_sitemap_reference"), "present", "none found")),
            F.concat(F.lit("- URL requires JS routing: "), told(c("requires_js_routing"), "yes (#/ route)", "no")),
        ),
    )


def with_regions(scans: DataFrame, regions: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Scans with ``regions``: their region rows as an array in order of rank, empty where there are none. Needs issue_order's rank."""
    fields = ("rank", "selector", "name", "status", "issue_type", "weight", "evidence", "fix_prompt")
    grouped = regions.groupBy(scan).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("regions"))
    rows = scans.join(grouped, scan, "left")
    return rows.withColumn("regions", F.coalesce("regions", F.array().cast(grouped.schema["regions"].dataType)))


def fixes(regions: Column) -> Column:
    """What is worth fixing, by what it costs the score, ties by rank."""
    worth = F.filter(regions, lambda r: r["status"].isin("bad", "warn"))
    cost = lambda r: F.round(r["weight"] * F.when(r["status"] == "bad", 1.0).otherwise(0.5), 12)
    return F.transform(F.array_sort(F.transform(worth, lambda r: F.struct((-cost(r)).alias("cost"), r["rank"].alias("rank"), r.alias("r")))), lambda x: x["r"])


def fix_plan() -> Column:
    """The plan in Markdown. Needs url, scanned_at, score, regions, blocked_evidence, blocked_prompt and the checks' columns."""
    c = F.col
    listed = fixes(c("regions"))
    entry = lambda r, i: F.concat(
        F.lit("### "), (i + 1).cast("string"), F.lit(". "), T.markdown_inline(r["name"]), F.lit(" — "), F.replace(r["issue_type"], F.lit("_"), F.lit(" ")),
        F.when(r["status"] == "bad", F.lit(" (invisible)")).otherwise(F.lit(" (partial)")),
        F.lit("\n\nSelector: `"), F.replace(r["selector"], F.lit("`"), F.lit("")), F.lit("`\nEvidence: "), T.markdown_inline(r["evidence"]),
        F.lit("\n\n"), T.fenced(F.coalesce(r["fix_prompt"], F.lit("(no prompt generated)"))), F.lit("\n"),
    )
    blocked = F.when(c("blocked_evidence").isNotNull(), F.concat(F.lit("## Fix this first: AI crawlers are blocked at the door\n\n"), T.markdown_inline(c("blocked_evidence")), F.lit("\n\n"), T.fenced(c("blocked_prompt")), F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.when(F.size(listed) == 0, F.lit("## Region fixes\n\nNothing to fix — every region is visible to crawlers.\n")).otherwise(
        F.concat(F.lit("## Region fixes ("), F.size(listed).cast("string"), F.lit(", ordered by score impact)\n\n"), F.array_join(F.transform(listed, entry), "\n"), F.lit("\n"))
    )
    return F.concat(
        F.lit(f"# {TITLE} fix plan — "), c("url"), F.lit("\n\nScanned: "), http_date(c("scanned_at")), F.lit(" · Visibility score: **"), c("score").cast("string"),
        F.lit("/100** · "), F.size("regions").cast("string"), F.lit(" regions analyzed\n\n"), blocked,
        F.lit("## Page-level checks\n\n"), F.array_join(check_lines(), "\n"), F.lit("\n\n"), body, F.lit(f"---\n\n> {W.CAVEAT}\n"),
    )


def html_report() -> Column:
    """A report that needs no other file. Needs what fix_plan needs, and prev_score and score_delta (null without a previous scan)."""
    c = F.col
    esc = T.escaped
    count = lambda v: F.size(F.filter("regions", lambda r: r["status"] == v)).cast("string")
    prompt = lambda p: F.concat(F.lit("<details><summary>Fix prompt</summary><pre>"), esc(p), F.lit("</pre></details>"))
    region = lambda r: F.concat(
        F.lit('<section class="region '), r["status"], F.lit('"><header><span class="tag">'), looked_up(W.VERDICT_LABEL, r["status"]), F.lit("</span> <h3>"), esc(r["name"]),
        F.lit("</h3> <code>"), esc(r["selector"]), F.lit('</code></header><p class="evidence">'), esc(r["evidence"]), F.lit("</p>"),
        F.when(F.coalesce(r["fix_prompt"], F.lit("")) != "", prompt(r["fix_prompt"])).otherwise(F.lit("")), F.lit("</section>"),
    )
    sign = F.when(c("score_delta") >= 0, F.lit("+")).otherwise(F.lit(""))
    compared = F.when(c("score_delta").isNotNull(), F.concat(F.lit("<p>"), c("prev_score").cast("string"), F.lit(" → "), c("score").cast("string"), F.lit(" ("), sign, c("score_delta").cast("string"), F.lit(" vs previous scan)</p>"))).otherwise(F.lit(""))
    blocked = F.when(c("blocked_evidence").isNotNull(), F.concat(F.lit("<h3>AI crawlers are blocked at the door — fix this first</h3><p>"), esc(c("blocked_evidence")), F.lit("</p>"), prompt(c("blocked_prompt")))).otherwise(F.lit(""))
    items = F.array_join(F.transform(check_lines(), lambda line: F.concat(F.lit("<li>"), esc(F.regexp_replace(line, r"^-\s*", "")), F.lit("</li>"))), "\n")
    return F.concat(
        F.lit(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{TITLE} report — '), esc(c("url")), F.lit("</title></head><body><main>\n"),
        F.lit(f"<h1>{TITLE} report</h1><p>"), esc(c("url")), F.lit(" · "), http_date(c("scanned_at")), F.lit('</p><div class="score">'), c("score").cast("string"), F.lit("/100</div>"), compared,
        F.lit("<p>"), count("ok"), F.lit(" visible · "), count("warn"), F.lit(" partial · "), count("bad"), F.lit(" invisible</p>\n"), blocked,
        F.lit("<h3>Regions</h3>\n"), F.array_join(F.transform("regions", region), "\n"), F.lit("\n<h3>Page-level checks</h3><ul>"), items, F.lit("</ul>\n<p>"), esc(F.lit(W.CAVEAT)), F.lit("</p></main></body></html>"),
    )


def attachment_name(url: Column, finished_at: Column, created_at: Column, ending: str) -> Column:
    """A file name from the page's host and the day of the scan."""
    return F.concat(F.lit("visibility-"), F.when(F.rlike(url, F.lit(urls.PARTS)), urls.file_host(url)).otherwise(F.lit("page")), F.lit("-"), F.date_format(F.coalesce(finished_at, created_at), "yyyy-MM-dd"), F.lit(ending))


def labelled(regions: DataFrame) -> DataFrame:
    """Regions with the wording that a reader sees: verdict_label, issue_label, why, how, and weight in whole percent."""
    issue = F.col("issue_type")
    return regions.withColumns({
        "verdict_label": looked_up(W.VERDICT_LABEL, F.col("status")), "issue_label": looked_up(W.ISSUE_LABEL, issue), "why": looked_up(W.WHY_IT_MATTERS, issue),
        "how": looked_up(W.HOW_TO_FIX, issue), "weight_percent": scoring.rounded(F.round(F.col("weight") * 100, 9)),
    })


def error_copy(error_type: Column) -> Column:
    """struct<title, what, next> for an error type, the general one where it has none of its own."""
    made = {k: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("title", "what", "next"), strict=True)]) for k, v in W.ERROR_COPY.items()}
    return F.coalesce(chosen({k: v for k, v in made.items() if k}, error_type), made[None])


def drawable(regions: DataFrame, page_height: Column, page_width: Column | None = None) -> DataFrame:
    """Regions that can be drawn, with left, top, width and height in percent of the page, in order of box.y and box.x.

    On a map (no ``page_width``) the page is 1280 wide and 800 to 8000 high, a region's top must lie 24 above its end and it
    is drawn at least 24 high; on a screenshot, of the given size, neither holds.
    """
    b, shot = F.col("box"), page_width is not None
    high = (page_height if shot else F.least(F.greatest(page_height, F.lit(800)), F.lit(8000))).cast("double")
    wide = (page_width if shot else F.lit(1280)).cast("double")
    kept = regions.withColumns({"_h": high, "_w": wide}).where((b["width"] > 0) & (b["height"] > 0) & (b["y"] < F.col("_h") - (0 if shot else 24)))
    h, w = F.col("_h"), F.col("_w")
    tall = F.least(b["height"].cast("double"), h - b["y"])
    share = lambda v, of: F.round(v / of * 100, 6)
    return kept.withColumns({
        "left_percent": share(b["x"], w), "top_percent": share(b["y"], h), "width_percent": share(F.least(b["width"].cast("double"), w - b["x"]), w),
        "height_percent": share(tall if shot else F.greatest(tall, F.lit(24.0)), h),
    }).drop("_h", "_w")
