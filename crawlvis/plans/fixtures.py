"""Small tables of cases, with the results that they must have.

Fixed values: inputs and expected results of decision tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# input, normal form (None: can't be parsed), whether it routes by script
URL_CASES = (
    ("https://EXAMPLE.com/Path", "https://example.com/Path", False),
    ("example.com/page", "https://example.com/page", False),
    ("https://example.com:443/a", "https://example.com/a", False),
    ("http://example.com:80/a", "http://example.com/a", False),
    ("http://localhost:3000/a", "http://localhost:3000/a", False),
    ("localhost:3000/a", "https://localhost:3000/a", False),
    ("example.com:8080", "https://example.com:8080/", False),
    ("ftp://example.com/file", "ftp://example.com/file", False),
    ("https://example.com/docs/", "https://example.com/docs", False),
    ("https://example.com/", "https://example.com/", False),
    ("https://example.com/p?utm_source=x&b=2&a=1&fbclid=abc&gclid=1#section", "https://example.com/p?a=1&b=2", False),
    ("https://example.com/#/route", "https://example.com/", True),
    ("ht tp://nope", None, False),
    ("https://Me:Pw@example.com/a", "https://Me:Pw@example.com/a", False),
    ("https://example.com:0443/a", "https://example.com/a", False),
    ("http://example.com:08080/a", "http://example.com:8080/a", False),
    ("https://example.com/a/./b/../c", "https://example.com/a/c", False),
    ("https://example.com/../a/..", "https://example.com/", False),
    ("https://example.com/a/%2E%2e/b/.", "https://example.com/b", False),
    ("https://example.com/a..b/.c/...", "https://example.com/a..b/.c/...", False),
    ("https://example.com/a b/é", "https://example.com/a%20b/%C3%A9", False),
    ("https://example.com/?q=a%20b&é=1", "https://example.com/?%C3%A9=1&q=a+b", False),
    ("https://example.com/?b=100%&a=x+y&c", "https://example.com/?a=x+y&b=100%25&c=", False),
    ("https://example.com/?z=1&utm%5Fsource=x&y=~", "https://example.com/?y=%7E&z=1", False),
    ("  https://example.com/a\n  ", "https://example.com/a", False),
    ("https:\\\\example.com\\a", "https://https//example.com/a", False),
    ("https://example.com/a//", "https://example.com/a", False),
)
ESCAPED = (
    (r"say \"hi\" \u0026 wave\n", 'say "hi" & wave\n'),
    (r"a\/b", "a/b"),
    (r"it\u2019s \ud83d\ude00", "it’s 😀"),
    (r"tab\there", "tab here"),
    (r"a\ud83d b \ude00\ud83d\ud83d\ude00\ude00 c\uD83D", "a\ufffd b \ufffd\ufffd😀\ufffd c\ufffd"),
    (r"\u00e9\\u0041 \u12", "é\\A \\u12"),
    ("plain", "plain"),
)
V4 = tuple((a, True) for a in ("127.0.0.1", "127.255.255.255", "10.0.0.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "169.254.169.254", "0.0.0.0")) + tuple((a, False) for a in ("172.32.0.1", "8.8.8.8", "93.184.216.34", "1.2.3", "1.2.3.256"))
V6 = tuple((a, True) for a in ("::1", "::", "fc00::1", "fd12:3456::1", "fe80::1", "::ffff:10.0.0.1", "::ffff:a00:1", "::ffff:7f00:1", "0:0:0:0:0:ffff:192.168.0.1", "::c0a8:1", "64:ff9b::10.0.0.1", "[::1]")) + tuple((a, False) for a in ("::ffff:8.8.8.8", "2606:2800:220:1::1", "::ffff:808:808", "1:2:3", "::g"))
HOSTS = (("localhost", "ssrf_blocked"), ("app.localhost", "ssrf_blocked"), ("127.0.0.1", "ssrf_blocked"), ("[::1]", "ssrf_blocked"), ("8.8.8.8", None), ("example.com", None), ("Example.com", None), ("internal.example.com", "ssrf_blocked"), ("nowhere.example.com", "dns_or_network"))
DNS = (("example.com", "93.184.216.34", 4), ("internal.example.com", "93.184.216.34", 4), ("internal.example.com", "10.1.2.3", 4))
STACKS = (
    ('<link rel="stylesheet" href="/wp-content/themes/x/style.css">', "WordPress", "wp-content asset paths"),
    ('<meta name="generator" content="WordPress 6.5">', "WordPress", "WordPress generator meta"),
    ('<script id="__NEXT_DATA__" type="application/json">{}</script>', "Next.js", "Next.js runtime payload"),
    ('<script>self.__next_f.push([1,"x"])</script>', "Next.js", "Next.js runtime payload"),
    ("<script>window.__NUXT__={}</script>", "Nuxt", "Nuxt runtime payload"),
    ('<div id="___gatsby"></div>', "Gatsby", "Gatsby root container"),
    ('<app-root ng-version="17.3.0"></app-root>', "Angular", "ng-version attribute"),
    ('<div data-v-7ba5bd90 class="card"></div>', "Vue", "Vue scoped-style attributes"),
    ('<div data-reactroot=""></div>', "React", "React root markers"),
    ("<script>{ __sveltekit_1a2b3c: true }</script>", "SvelteKit", "SvelteKit attributes"),
    ('<div data-reactroot=""></div><script id="__NEXT_DATA__"></script>', "Next.js", "Next.js runtime payload|React root markers"),
    ('<html><body><div id="root"></div></body></html>', "client-rendered JS app", "empty #root/#app container in raw HTML"),
    ("<html><body><p>hi</p></body></html>", "plain HTML / unknown", ""),
)
ROBOTS = (
    ("host0", "\n# global rules\nUser-agent: *\nDisallow: /admin/\nAllow: /admin/help\n\nUser-agent: GPTBot\nDisallow: /\n\nUser-agent: ClaudeBot\nUser-agent: PerplexityBot\nDisallow: /private/\n\nSitemap: https://example.com/sitemap.xml\n"),
    ("host1", "User-agent: *\nDisallow: /en/\nAllow: /en/7\nDisallow: /*/2$\nCrawl-delay: 5\n"),
    ("host2", "User-agent: bot\nDisallow: /fr\nDisallow:\nUser-agent: google\nDisallow: /de/*4\n"),
)
# host, line number, group, kind, value
ROBOTS_LINES = (
    ("host0", 0, 1, "agent", "*"), ("host0", 1, 1, "disallow", "/admin/"), ("host0", 2, 1, "allow", "/admin/help"), ("host0", 3, 2, "agent", "gptbot"), ("host0", 4, 2, "disallow", "/"),
    ("host0", 5, 3, "agent", "claudebot"), ("host0", 6, 3, "agent", "perplexitybot"), ("host0", 7, 3, "disallow", "/private/"), ("host0", 8, None, "sitemap", "https://example.com/sitemap.xml"),
    ("host1", 0, 1, "agent", "*"), ("host1", 1, 1, "disallow", "/en/"), ("host1", 2, 1, "allow", "/en/7"), ("host1", 3, 1, "disallow", "/*/2$"),
    ("host2", 0, 1, "agent", "bot"), ("host2", 1, 1, "disallow", "/fr"), ("host2", 2, 1, "disallow", ""), ("host2", 3, 2, "agent", "google"), ("host2", 4, 2, "disallow", "/de/*4"),
)
# scan, status, content type, body, url, present, links to path
LLMS = (
    (1, 200, "text/plain", "- /docs/intro", "https://example.com/docs/intro", True, True),
    (2, 200, "text/plain", "- /other", "https://example.com/docs/intro", True, False),
    (3, 200, "text/html", "<html>", "https://example.com/", False, None),
    (4, 404, "text/plain", "none", "https://example.com/", False, None),
    (5, 200, None, "see https://example.com/ now", "https://example.com/", True, True),
    (6, 200, None, "<!doctype html><p>", "https://example.com/", False, None),
)
# scan, final url, content type, html, redirects, error type, error message
RESPONSES = (
    (1, "https://example.com/a", "text/html; charset=utf-8", "<p>fine</p>", [], None, None),
    (2, "https://example.com/a.pdf", "application/pdf", "%PDF-1.7", [], "unsupported_content_type", "This URL serves application/pdf, not an HTML page."),
    (3, "https://example.com/a", "text/html", "%PDF-1.7", [], "unsupported_content_type", "This URL serves application/pdf, not an HTML page."),
    (4, "https://example.com/a", "application/json;x=1", "{}", [], "unsupported_content_type", "This URL serves application/json, not an HTML page."),
    (5, "https://example.com/a", None, " <!DOCTYPE html><p>x", [], None, None),
    (6, "https://example.com/a", None, "hello", [], "unsupported_content_type", "This URL serves unknown, not an HTML page."),
    (7, "https://example.com/login", "text/html", "<p>x</p>", ["https://example.com/a"], "login_redirect", "This page requires signing in — the crawler was sent to /login."),
    (8, "https://example.com/login", "text/html", "<p>x</p>", [], None, None),
    (9, "https://example.com/a", "text/html", '<form><input name="p" type="password"></form>', [], "login_redirect", "This page requires signing in — the crawler was sent to /a."),
    (10, "https://example.com/blog/login-tips", "text/html", "<p>x</p>", ["https://example.com/b"], None, None),
    (11, "https://example.com/sso/start", "text/html", "<p>x</p>", ["https://example.com/b"], "login_redirect", "This page requires signing in — the crawler was sent to /sso/start."),
)
# scan, hop, url, status, location, private, elapsed
HOPS = (
    (1, 0, "https://a.example/", 301, "/b", False, 10), (1, 1, "https://a.example/b", 200, None, False, 20),
    (2, 0, "https://a.example/", 302, "http://10.0.0.1/", False, 10), (2, 1, "http://10.0.0.1/", None, None, True, 20),
    (3, 0, "https://a.example/", 302, "ftp://a.example/", False, 10), (3, 1, "ftp://a.example/", None, None, False, 20),
    *((4, i, f"https://a.example/{i}", 302, f"/{i + 1}", False, 10 * i) for i in range(6)),
    (5, 0, "https://a.example/", 200, None, False, 15001),
    (6, 0, "https://a.example/", 301, None, False, 10),
    *((7, i, f"https://a.example/{i}", 302 if i < 5 else 200, f"/{i + 1}", False, 10 * i) for i in range(6)),
)
# scan, final url, redirects, error type
FOLLOWED = (
    (1, "https://a.example/b", 1, None), (2, "http://10.0.0.1/", 1, "ssrf_blocked"), (3, "ftp://a.example/", 1, "ssrf_blocked"), (4, "https://a.example/5", 5, "dns_or_network"),
    (5, "https://a.example/", 0, "timeout"), (6, "https://a.example/", 0, None), (7, "https://a.example/5", 5, None),
)
NO_FLAGS = (False, False, False, False, None, False, 0, 0, False)
IFRAME = (False, False, True, True, "https://maps.example.com/embed", False, 0, 0, False)
CANVAS = (True, True, False, False, None, False, 0, 0, False)
IMAGES = (False, False, False, False, None, False, 3, 2, True)
ROUTES = [("#/guides", True), ("#/api", True), ("#/tutorials", True), ("/changelog", False)]
# scan, region, words, flags, links, coverage, in scripts, container; then issue, verdict and evidence (None: dropped as an empty shell)
CLASSIFIED = (
    (1, 1, 13, IFRAME, [], 0.0, 0.0, (True, False, 4), "iframe_embed", "bad", "region is dominated by an iframe (https://maps.example.com/embed) · 13 words rendered · 0% found in initial HTML — crawlers do not descend into embedded frames"),
    (1, 2, 12, CANVAS, [], 0.1, 0.9, (True, True, 0), "canvas_or_image_data", "bad", "content is carried by a <canvas> element · 12 words rendered · 10% found in initial HTML · container #r2 is empty in the raw response"),
    (1, 3, 12, IMAGES, [], 0.29, 0.0, (False, True, 0), "canvas_or_image_data", "bad", "content is carried by 2 image(s) without alt text · 12 words rendered · 29% found in initial HTML · container #r3 is absent from the raw response"),
    (1, 4, 21, NO_FLAGS, [], 0.0, 11 / 16, (True, True, 0), "data_in_script_variable", "warn", "69% of this region's text sits inside an inline <script> variable but only 0% appears as readable HTML · 21 words rendered · some crawlers read script payloads, most don't index them as content"),
    (1, 5, 26, NO_FLAGS, [], 0.0, 0.0, (True, True, 0), "js_rendered_content", "bad", "26 words rendered · 0 found in initial HTML · container #r5 is empty in the raw response"),
    (1, 6, 18, NO_FLAGS, ROUTES, 1.0, 0.0, (True, False, 18), "client_side_routes", "warn", "3 of 4 links are JS routes (#/… or javascript:) that serve no distinct content to a crawler · 100% of the region's own text is in the initial HTML"),
    (2, 1, 18, NO_FLAGS, ROUTES[:3], 1.0, 0.0, (True, False, 18), "fully_visible", "ok", "18 words rendered · 100% present in the initial HTML response — crawlers see what users see"),
    (2, 2, 40, NO_FLAGS, [], 0.4, 0.0, (True, False, 9), "partial_content", "warn", "40 words rendered · only 40% found in initial HTML · about 24 words appear only after JavaScript runs"),
    (2, 3, 0, NO_FLAGS, [], 0.0, 0.0, (True, True, 0), None, None, None),
    (2, 4, 10, NO_FLAGS, ROUTES, 0.1, 0.0, (True, False, 9), "js_rendered_content", "bad", "10 words rendered · 1 found in initial HTML · container #r4 holds 9 words in the raw response"),
)
PROBES = ((1, "https://example.com/#/guides", False), (2, "https://example.com/#/guides", True))
ERROR_TYPES = ("unsupported_content_type", "timeout", "login_redirect", "dns_or_network", "render_failed", "ssrf_blocked", "invalid_url", None)


def url_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in URL_CASES], "input string")


def escaped_scripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in ESCAPED], "script string")


def v4_addresses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in V4], "address string")


def v6_addresses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in V6], "address string")


def hosts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in HOSTS], "host string")


def dns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DNS, "host string, address string, family int")


def stacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c[0],) for c in STACKS], "html string")


def robots_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS, "host string, content string")


def llms_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:5] for c in LLMS], "scan_id long, status int, content_type string, body string, url string")


def responses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([c[:5] for c in RESPONSES], "scan_id long, final_url string, content_type string, html string, redirects array<string>")


def hops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOPS, "scan_id long, hop int, url string, status int, location string, private boolean, elapsed_ms long")


def classifier_cases(spark: SparkSession) -> DataFrame:
    from crawlvis.operators.scoring import FLAGS, LINKS

    rows = [(c[0], c[1], f"#r{c[1]}", "https://example.com/", *c[2:8]) for c in CLASSIFIED]
    return spark.createDataFrame(rows, f"scan_id long, region_ord long, selector string, url string, word_count long, flags {FLAGS}, links {LINKS}, coverage double, found_in_scripts double, container struct<present:boolean,empty:boolean,words:bigint>")


def probe_outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, "scan_id long, url string, distinct_content boolean")


def error_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in ERROR_TYPES], "error_type string")
