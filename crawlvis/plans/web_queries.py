"""Queries over malformed sources, addresses and the files beside pages, all made from the table of pages; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.operators import history, pages, reporting, responses, robots
from crawlvis.plans import oracle
from crawlvis.plans.oracle import NL, q
from crawlvis.sources.shared import EACH, spread
from crawlvis.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _picked(key: str, values) -> F.Column:
    """One of the values, by the key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _case(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


# What malformed sources end in, the text that a reader makes of it, and the scripts it holds.
MALFORMED = (
    ("<p class=a don't>First part.</p><p>It's second.</p>", "First part.\nIt's second.", ""),
    ("<div title='a > b' data-x=\"c > d\">Kept text</div>", "Kept text", ""),
    ("<p>Before</p><!-- never closed <p>gone</p>", "Before", ""),
    ("<script src=x />var a = 1;</script><p>After it</p>", "After it", ""),
    ("<p>Fish &amp chips &notin; &copy2024 &#8364;5</p>", "Fish & chips ∉ ©2024 €5", ""),
    ("<template><p>gone<template>too</template></p></template>End</template> mark", "End mark", ""),
    ('<p>Half <a href="/x>never closed', "Half", ""),
    ('<script data-src=1>var b = "</b>";</script><textarea><p>typed</textarea>', "<p>typed", 'var b = "</b>";'),
)


@query
def malformed_pages(spark, sf_dir):
    """Pages whose crawler got a source with malformed parts, beside a browser that got none: text, scripts and block."""
    rows = spread(table(spark, sf_dir, "pages"), EACH).select(F.col("page_id").alias("scan_id"), F.col("url").alias("requested_url"), "html")
    broken = F.concat("html", _picked("scan_id", [m[0] for m in MALFORMED]))
    side = lambda role, html: rows.select("scan_id", F.lit(role).alias("ua_role"), "requested_url", F.lit(200).alias("status"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html"))
    found = responses.bot_blocks(responses.paired(side("crawler", broken).unionByName(side("control", F.col("html")))))
    return found.select("scan_id", F.md5("raw_text").alias("text_md5"), T.word_count(F.col("raw_text")).alias("n_words"), T.inline_scripts(F.col("raw_html")).alias("scripts"), "blocked_reason")


_joined = lambda a, b: f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} ELSE {a} || {NL} || {b} END"
SQL["malformed_pages"] = f"""WITH p AS (SELECT page_id, {oracle.raw_text('html')} AS t, {oracle.scripts('html')} AS s, {_case('page_id', [m[1] for m in MALFORMED])} AS x, {_case('page_id', [m[2] for m in MALFORMED])} AS y FROM pages),
w AS (SELECT page_id, {_joined('t', 'x')} AS whole, {_joined('s', 'y')} AS scripts FROM p)
SELECT page_id AS scan_id, md5(whole) AS text_md5, CAST(len({oracle.toks('whole')}) AS BIGINT) AS n_words, scripts, CAST(NULL AS VARCHAR) AS blocked_reason FROM w"""

# Spellings of a page's address, of which the last parts are filled in, and their keys; None: no address.
SPELLINGS = (
    ("HTTP://Www.Example.COM:80/p/{n}/?b=1&B=2&a_1=x&a1=y#top", "http://www.example.com/p/{n}?a_1=x&a1=y&b=1&B=2"),
    ("http://0x7f.1/p/{n}", "http://127.0.0.1/p/{n}"),
    ("https://192.168.0.1.:443/p/{n}?utm_source=x", "https://192.168.0.1/p/{n}"),
    ("bücher.example/p/{n}?é=1&f=2&e=3", "https://xn--bcher-kva.example/p/{n}?e=3&%C3%A9=1&f=2"),
    ("javascript:alert({n})", None),
    ("http://a:b:c/{n}", None),
    ("http://a.example:99999/{n}", None),
    ("https://[2001:DB8:0:0:1:0:0:1]:8443/p/../{n}", "https://[2001:db8::1:0:0:1]:8443/{n}"),
    ("https://例え.テスト\\p\\{n}?x\\y", "https://xn--r8jz45g.xn--zckzah/p/{n}?x%5Cy="),
    ("http://1.2.3.4.5/{n}", None),
    ("ftp://me@FTP.Example.com:21/{n}//", "ftp://me@ftp.example.com/{n}"),
    ("data:text/{n}", None),
)


@query
def url_spellings(spark, sf_dir):
    spelled = F.replace(_picked("page_id", [s for s, _ in SPELLINGS]), F.lit("{n}"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", spelled.alias("u")).select("page_id", urls.normalized(F.col("u")).alias("normalized_url"), urls.is_valid(F.col("u")).alias("valid"))


SQL["url_spellings"] = f"SELECT page_id, replace({_case('page_id', [k for _, k in SPELLINGS])}, '{{n}}', CAST(page_id AS VARCHAR)) AS normalized_url, {_case('page_id', [k for _, k in SPELLINGS])} IS NOT NULL AS valid FROM pages"

# Hosts beside those of pages, by a number; what names resolve to; and how each is judged.
HOSTS = (
    ("{h}", ("93.184.{n}.34",), None), ("internal.{h}", ("93.184.216.34", "10.1.{n}.3"), "ssrf_blocked"), ("gone.{h}", (), "dns_or_network"), ("0x7f.{n}", (), "ssrf_blocked"), ("8.8.8.{n}", (), None), ("192.168.{n}.", (), "ssrf_blocked"),
    ("[::ffff:a00:{n}]", (), "ssrf_blocked"), ("[2606:4700::{n}]", (), None), ("app{n}.localhost", (), "ssrf_blocked"), ("{h}.", ("fe80::{n}",), "ssrf_blocked"), ("a b{n}", (), "dns_or_network"), ("[fc00::{n}]", (), "ssrf_blocked"), ("1.2.3.4.{n}", (), "dns_or_network"), ("six.{h}", ("2606:4700::{n}",), None),
)


def _hosts(spark, sf_dir):
    n = F.pmod(F.col("page_id"), F.lit(200)) + 1
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("."), urls.host_of(F.col("url"))).alias("h"), n.cast("string").alias("n"))
    filled = lambda x: F.replace(F.replace(x, F.lit("{h}"), F.col("h")), F.lit("{n}"), F.col("n"))
    answers = F.element_at(F.array(*[F.array(*[F.lit(a) for a in found]).cast("array<string>") for _, found, _ in HOSTS]), (F.pmod(F.col("page_id"), F.lit(len(HOSTS))) + 1).cast("int"))
    return rows.select("page_id", filled(_picked("page_id", [h for h, _, _ in HOSTS])).alias("host"), F.transform(answers, filled).alias("answers"))


@query
def page_hosts(spark, sf_dir):
    """Hosts of addresses to fetch, and whether they may be: each name's addresses are a table."""
    rows = _hosts(spark, sf_dir)
    dns = rows.select("host", F.explode("answers").alias("address")).select("host", "address", F.when(F.contains("address", F.lit(":")), 6).otherwise(4).alias("family"))
    judged = responses.host_verdicts(rows.select("host").distinct(), dns)
    return rows.join(judged, "host").select("page_id", "error_type")


SQL["page_hosts"] = f"SELECT page_id, {_case('page_id', [e for _, _, e in HOSTS])} AS error_type FROM pages"

# Responses by a number: path, content type, start of the body, whether redirected; and their error.
SERVED = (
    ("/a", "text/html; charset=utf-8", "<p>fine</p>", False, None), ("/a.pdf", "application/pdf", "%PDF-1.7", False, "unsupported_content_type"), ("/a", "text/html", "%PDF-1.7", False, "unsupported_content_type"),
    ("/a", None, " <!DOCTYPE html><p>x", False, None), ("/a", None, "hello", False, "unsupported_content_type"), ("/login", "text/html", "", True, "login_redirect"), ("/login", "text/html", "", False, None),
    ("/sso/start", "application/xhtml+xml", "", True, "login_redirect"), ("/blog/login-tips", "text/html", "", True, None), ("/data", "application/json;x=1", "{}", False, "unsupported_content_type"),
)
_LABELS = {"application/pdf": "application/pdf", "text/html": "application/pdf", None: "unknown", "application/json;x=1": "application/json"}


def _served(page_id: str, spark, sf_dir):
    rows = spread(table(spark, sf_dir, "pages"), EACH).select(F.col(page_id).alias("scan_id"), urls.host_of(F.col("url")).alias("h"), "html")
    pick = lambda i: _picked("scan_id", [s[i] for s in SERVED])
    body = F.concat(pick(2), F.when(pick(2).isin("%PDF-1.7", "hello", "{}"), F.lit("")).otherwise(F.col("html")))
    moved = F.when(pick(3), F.array(F.concat(F.lit("https://"), F.col("h"), F.lit("/start")))).otherwise(F.array().cast("array<string>"))
    return rows.select("scan_id", F.concat(F.lit("https://"), F.col("h"), pick(0)).alias("final_url"), pick(1).alias("content_type"), body.alias("html"), moved.alias("redirects"))


@query
def page_errors(spark, sf_dir):
    """Responses that are no page, or ask for a login, with what is shown of them."""
    rows = _served("page_id", spark, sf_dir).withColumn("error_type", responses.typed_error())
    told = rows.select("scan_id", "error_type", responses.error_message().alias("error_message"), reporting.error_copy(F.col("error_type")).alias("c"))
    return told.select("scan_id", "error_type", "error_message", F.when(F.col("error_type").isNotNull(), F.col("c.title")).alias("title"), F.when(F.col("error_type").isNotNull(), F.col("c.next")).alias("next"))


def _message(path, kind, error):
    if error == "unsupported_content_type":
        return f"This URL serves {_LABELS[kind]}, not an HTML page."
    return f"This page requires signing in — the crawler was sent to {path}." if error else None


def _page_errors_sql() -> str:
    from crawlvis.functions import wording as W

    screen = lambda i: [W.ERROR_COPY[e][i] if e else None for *_, e in SERVED]
    return (
        f"SELECT page_id AS scan_id, {_case('page_id', [s[4] for s in SERVED])} AS error_type, {_case('page_id', [_message(s[0], s[1], s[4]) for s in SERVED])} AS error_message, "
        f"{_case('page_id', screen(0))} AS title, {_case('page_id', screen(2))} AS next FROM pages"
    )


SQL["page_errors"] = _page_errors_sql()


@query
def page_redirects(spark, sf_dir):
    """Chains of up to seven hops from every page, some to a private host, another scheme, or too slow."""
    n = F.pmod(F.col("page_id"), F.lit(9))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("scan_id"), n.alias("n"), F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("o"), F.explode(F.sequence(F.lit(0), F.least(n, F.lit(6)))).alias("hop"))
    last = F.col("hop") == F.least(F.col("n"), F.lit(6))
    odd = F.when(last & (F.col("n") == 2), F.lit("http://10.0.0.1/")).when(last & (F.col("n") == 3), F.lit("ftp://files.example/"))
    url = F.coalesce(odd, F.concat("o", F.lit("/hop/"), F.col("hop").cast("string")))
    slow = F.when(F.col("n") == 4, F.col("hop") * 4000).otherwise(F.col("hop") * 10)
    return responses.followed(rows.select("scan_id", F.col("hop").cast("long").alias("hop"), url.alias("url"), F.when(last & (F.col("n") != 7), 200).otherwise(302).alias("status"), F.when(~last | (F.col("n") == 7), F.lit("/next")).alias("location"), (last & (F.col("n") == 2)).alias("private"), slow.cast("long").alias("elapsed_ms")))


SQL["page_redirects"] = """WITH p AS (SELECT page_id AS scan_id, page_id % 9 AS n, least(page_id % 9, 6) AS k, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o FROM pages)
SELECT scan_id, CASE n WHEN 2 THEN 'http://10.0.0.1/' WHEN 3 THEN 'ftp://files.example/' ELSE o || '/hop/' || k END AS final_url, k AS n_redirects,
  CASE WHEN n IN (2, 3) THEN 'ssrf_blocked' WHEN n = 4 THEN 'timeout' WHEN n >= 6 THEN 'dns_or_network' END AS error_type FROM p"""


def _sites(spark, sf_dir):
    """Pages by host, with path and language folder."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html", urls.host_of(F.col("url")).alias("host"), urls.pathname(F.col("url")).alias("path"))
    return rows.withColumn("lang", F.regexp_extract("path", "^/([^/]+)", 1))


def _robots_files(sites: DataFrame) -> DataFrame:
    """A robots file for each host: rules for the folders that its pages are in, and two groups for crawlers by name."""
    langs = F.array_sort(F.collect_set("lang"))  # folders are languages, of which there are few
    rules = F.array_join(F.transform("langs", lambda x: F.concat(F.lit("Disallow: /"), x, F.lit("/\nAllow: /"), x, F.lit("/1\nDisallow: /"), x, F.lit("/*5$\nAllow: /*/2*5$"))), "\n")
    content = F.concat(F.lit("# rules\nUser-agent: *\n"), rules, F.lit("\n\nUser-agent: GPTBot\nDisallow: /*7\nAllow: /*77$\nAllow: /*.html\n\nUser-agent: claude\nDisallow: /\nAllow: /"), F.get("langs", F.lit(0)), F.lit("/\n\nSitemap: https://"), F.col("host"), F.lit("/sitemap.xml"))
    files = sites.groupBy("host").agg(langs.alias("langs"), F.min("page_id").alias("first"))
    # Some hosts serve their page for a file that isn't there, some nothing, some an empty file.
    status = F.when(F.col("first") % 5 == 1, 404).otherwise(200)
    kind = F.when(F.col("first") % 5 == 2, F.lit("text/html; charset=utf-8")).otherwise(F.lit("text/plain"))
    body = F.when(F.col("first") % 5 == 3, F.lit("")).otherwise(content)
    return files.select("host", responses.usable_text_file(status, kind, body).alias("content"))


@query
def site_robots(spark, sf_dir):
    """Every page against its host's robots file, and whether the file or the page names a sitemap."""
    sites = _sites(spark, sf_dir)
    rows = robots.grid(sites.select("page_id", "url", "html", "host", "path"), _robots_files(sites))
    listed = pages.checks(F.col("html"), F.col("url"), F.col("sitemaps"))["has_sitemap_reference"]
    cells = rows.select("page_id", "robots_present", listed.alias("has_sitemap_reference"), F.explode("robots_grid").alias("c"))
    return cells.select("page_id", "robots_present", "has_sitemap_reference", "c.crawler", "c.allowed")


def _site_sql() -> str:
    return f"""
s AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages),
l AS (SELECT *, regexp_extract(path, '^/([^/]+)', 1) AS lang FROM s),
h AS (SELECT host, list_sort(list_distinct(list(lang))) AS langs, min(page_id) % 5 AS kind FROM l GROUP BY host)"""


SQL["site_robots"] = f"""WITH {_site_sql()},
c(crawler, grp) AS (VALUES ('GPTBot', 2), ('ClaudeBot', 3), ('PerplexityBot', 1), ('Google-Extended', 1), ('CCBot', 1)),
r AS (
  SELECT host, 1 AS grp, unnest([{{'p': '/' || x || '/', 'a': false}}, {{'p': '/' || x || '/1', 'a': true}}, {{'p': '/' || x || '/*5$', 'a': false}}, {{'p': '/*/2*5$', 'a': true}}]) AS u FROM (SELECT host, unnest(langs) AS x FROM h WHERE kind IN (0, 4))
  UNION ALL SELECT host, 2, unnest([{{'p': '/*7', 'a': false}}, {{'p': '/*77$', 'a': true}}, {{'p': '/*.html', 'a': true}}]) FROM h WHERE kind IN (0, 4)
  UNION ALL SELECT host, 3, unnest([{{'p': '/', 'a': false}}, {{'p': '/' || langs[1] || '/', 'a': true}}]) FROM h WHERE kind IN (0, 4)
),
m AS (
  SELECT page_id, grp, arg_max(u.a, length(u.p) * 2 + CASE WHEN u.a THEN 1 ELSE 0 END) AS allow FROM l JOIN r USING (host)
  WHERE regexp_matches(path, '^' || replace(replace(u.p, '.', '[.]'), '*', '.*')) GROUP BY ALL
)
SELECT page_id, kind NOT IN (1, 2) AS robots_present, kind IN (0, 4) OR coalesce(regexp_matches(html, {q(oracle.SITEMAP)}), FALSE) AS has_sitemap_reference, crawler, coalesce(allow, TRUE) AS allowed
FROM l JOIN h USING (host) CROSS JOIN c LEFT JOIN m USING (page_id, grp)"""


@query
def site_llms(spark, sf_dir):
    """Whether a host's llms.txt is there and names the page: it lists the paths of two languages."""
    sites = _sites(spark, sf_dir)
    wanted = F.array_sort(F.collect_set(F.when(F.col("lang").isin("en", "de"), F.concat(F.lit("- /"), F.col("lang"), F.lit("/1")))))
    files = sites.groupBy("host").agg(F.array_join(wanted, "\n").alias("body"), F.min("page_id").alias("first"))
    body = F.when(F.col("first") % 5 == 2, F.lit("<!doctype html><p>")).otherwise(F.col("body"))
    files = files.select("host", responses.usable_text_file(F.when(F.col("first") % 5 == 1, 404).otherwise(200), F.lit(None).cast("string"), body).alias("content"))
    rows = sites.select("page_id", "url", "host").join(files, "host").withColumn("c", pages.llms_check(F.col("content"), F.col("url")))
    return rows.select("page_id", "c.present", "c.links_to_path")


SQL["site_llms"] = f"""WITH {_site_sql()},
b AS (SELECT host, kind, array_to_string(list_sort(list_transform(list_filter(langs, lambda x: x IN ('en', 'de')), lambda x: '- /' || x || '/1')), {NL}) AS body FROM h)
SELECT page_id, kind NOT IN (1, 2) AS present, CASE WHEN kind NOT IN (1, 2) THEN contains(body, url) OR (path <> '/' AND contains(body, path)) END AS links_to_path FROM l JOIN b USING (host)"""


@query
def page_requests(spark, sf_dir):
    """Rows to insert for requests of pages' addresses in several spellings, some of which are none."""
    spelled = F.replace(_picked("page_id", [s for s, _ in SPELLINGS]), F.lit("{n}"), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("req_id"), F.concat(F.lit(" \n"), spelled, F.lit("\t")).alias("url"), F.timestamp_millis(F.col("page_id") * 1000).alias("ts"))
    return history.new_scans(rows).select("scan_id", F.md5("input_url").alias("input_md5"), "normalized_url", "status", "error_type", F.unix_millis("created_at").alias("created_ms"))


_spelled, _key = _case("page_id", [s for s, _ in SPELLINGS]), _case("page_id", [k for _, k in SPELLINGS])
SQL["page_requests"] = f"""SELECT page_id AS scan_id, md5(replace({_spelled}, '{{n}}', CAST(page_id AS VARCHAR))) AS input_md5, replace({_key}, '{{n}}', CAST(page_id AS VARCHAR)) AS normalized_url,
  CASE WHEN {_key} IS NULL THEN 'error' ELSE 'queued' END AS status, CASE WHEN {_key} IS NULL THEN 'invalid_url' END AS error_type, page_id * 1000 AS created_ms FROM pages"""
