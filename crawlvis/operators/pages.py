"""What a page's source tells of it: its stack and page-level checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions import urls

# Markers of stacks, in the order in which the first names the stack.
MARKERS = (
    ("WordPress", r"(?i)wp-content/|wp-includes/", "wp-content asset paths"),
    ("WordPress", r"(?i)<meta[^>]+generator[^>]+wordpress", "WordPress generator meta"),
    ("Next.js", r"__NEXT_DATA__|self\.__next_f|/_next/static/", "Next.js runtime payload"),
    ("Nuxt", r"__NUXT__|/_nuxt/", "Nuxt runtime payload"),
    ("Gatsby", r"(?i)___gatsby|gatsby-chunk", "Gatsby root container"),
    ("SvelteKit", r"(?i)sveltekit|data-sveltekit", "SvelteKit attributes"),
    ("Angular", r"(?i)<[^>]+ng-version=", "ng-version attribute"),
    ("Vue", r"(?i)<[^>]+data-v-[0-9a-f]{6,}|vue(?:\.runtime)?(?:\.min)?\.js", "Vue scoped-style attributes"),
    ("React", r"(?i)data-reactroot|data-reactid|react(?:-dom)?(?:\.production)?(?:\.min)?\.js", "React root markers"),
)
EMPTY_ROOT = r"(?i)<div[^>]+id=[\"'](root|app)[\"'][^>]*>\s*</div>"
CLIENT_APP, EMPTY_ROOT_SIGNAL, UNKNOWN = "client-rendered JS app", "empty #root/#app container in raw HTML", "plain HTML / unknown"
# Patterns of the page-level checks.
JSON_LD = r"(?i)<script[^>]+type=[\"']application/ld\+json[\"']"
TITLE = r"(?i)<title[^>]*>\s*[^<\s]"
DESCRIPTION = r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"'][^\"']+[\"']|<meta[^>]+content=[\"'][^\"']+[\"'][^>]+name=[\"']description[\"']"
SITEMAP = r"(?i)<link[^>]+rel=[\"']sitemap[\"']"


def fingerprint(html: Column) -> Column:
    """struct<stack, signals> of a page's source."""
    has = lambda pattern: F.coalesce(F.rlike(html, F.lit(pattern)), F.lit(False))
    hits = F.array_compact(F.array(*[F.when(has(p), F.struct(F.lit(s).alias("stack"), F.lit(g).alias("signal"))) for s, p, g in MARKERS]))
    bare = (F.size(hits) == 0) & has(EMPTY_ROOT)
    stack = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["stack"]).when(bare, F.lit(CLIENT_APP)).otherwise(F.lit(UNKNOWN))
    signals = F.when(bare, F.array(F.lit(EMPTY_ROOT_SIGNAL))).otherwise(F.array_distinct(F.transform(hits, lambda h: h["signal"])))
    return F.struct(stack.alias("stack"), signals.alias("signals"))


def checks(html: Column, typed_url: Column, sitemaps: Column | None = None) -> dict[str, Column]:
    """The page-level checks of a source and of the URL as it was typed."""
    has = lambda pattern: F.coalesce(F.rlike(html, F.lit(pattern)), F.lit(False))
    listed = F.lit(False) if sitemaps is None else F.coalesce(F.size(sitemaps) > 0, F.lit(False))
    return {
        "has_json_ld": has(JSON_LD), "has_title": has(TITLE), "has_meta_description": has(DESCRIPTION),
        "has_sitemap_reference": listed | has(SITEMAP), "requires_js_routing": urls.requires_js_routing(typed_url),
    }


def llms_check(content: Column, final_url: Column) -> Column:
    """struct<present, links_to_path> of llms.txt; links_to_path is null where the file is absent."""
    path = urls.pathname(final_url)
    links = F.contains(content, final_url) | ((path != "/") & F.contains(content, path))
    return F.struct(content.isNotNull().alias("present"), F.when(content.isNotNull(), links).alias("links_to_path"))
