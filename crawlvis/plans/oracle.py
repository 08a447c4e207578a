"""SQL for each query that SQL can express, written for DuckDB. Constants are written out here once more, so that a wrong one shows; wording is shared."""

from __future__ import annotations

from crawlvis.functions import wording as W
from crawlvis.plans import fixtures as X

# White space, common words, and limits of classes.
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
COMMON = "about above after again their there these thing think those through under until where which while would could should other every first because between being before during since still without".split()
NEARLY_NONE, NEARLY_ALL = 0.15, 0.9
# The patterns of sources of the tables' pages, whose attributes hold no bracket and whose references are few.
COMMENT, SILENT = "(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script *>|<style[^>]*>.*?</style *>|<noscript[^>]*>.*?</noscript *>|<template[^>]*>.*?</template *>|<head[^>]*>.*?</head *>|<title[^>]*>.*?</title *>"
BLOCK = "(?i)</?(p|h[1-6]|li|ul|ol|div|section|article|aside|header|footer|nav|main|table|tr|td|th|caption|blockquote|pre|figure|figcaption|dl|dt|dd|br|hr)( [^>]*)?>"
TAG, SCRIPT = "</?[a-zA-Z!][^>]*>", "(?is)<script([^>]*)>(.*?)</script *>"
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# Crawlers, phases, progress, tracking parameters, and what tells of a challenge.
CRAWLERS = ("GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "CCBot")
IN_FLIGHT = ("queued", "fetching", "rendering", "diffing", "classifying")
PROGRESS = {"queued": 0.0, "fetching": 0.2, "rendering": 0.45, "diffing": 0.7, "classifying": 0.9, "done": 1.0, "error": 1.0}
TRACKING = "(?i)^(utm_[a-z0-9_]+|gclid|fbclid|msclkid|mc_cid|mc_eid)$"
CHALLENGE = "(?i)just a moment|checking your browser|verify you are human|cf-chl|cf_chl|challenge-platform|attention required|ddos protection|hcaptcha|captcha|enable javascript and cookies to continue"
# Markers of stacks, and page-level checks.
MARKERS = (
    ("WordPress", "(?i)wp-content/|wp-includes/", "wp-content asset paths"), ("WordPress", "(?i)<meta[^>]+generator[^>]+wordpress", "WordPress generator meta"), ("Next.js", "__NEXT_DATA__|self[.]__next_f|/_next/static/", "Next.js runtime payload"),
    ("Nuxt", "__NUXT__|/_nuxt/", "Nuxt runtime payload"), ("Gatsby", "(?i)___gatsby|gatsby-chunk", "Gatsby root container"), ("SvelteKit", "(?i)sveltekit", "SvelteKit attributes"), ("Angular", "(?i)<[^>]+ng-version=", "ng-version attribute"),
    ("Vue", "(?i)<[^>]+data-v-[0-9a-f]{6,}|vue([.]runtime)?([.]min)?[.]js", "Vue scoped-style attributes"), ("React", "(?i)data-reactroot|data-reactid|react(-dom)?([.]production)?([.]min)?[.]js", "React root markers"),
)
EMPTY_ROOT, CLIENT_APP, EMPTY_ROOT_SIGNAL, UNKNOWN = "(?i)<div[^>]+id=[\"'](root|app)[\"'][^>]*>[ \n\t]*</div>", "client-rendered JS app", "empty #root/#app container in raw HTML", "plain HTML / unknown"
JSON_LD, TITLE, SITEMAP = "(?i)<script[^>]+type=[\"']application/ld[+]json[\"']", "(?i)<title[^>]*>[ \n\t]*[^< \n\t]", "(?i)<link[^>]+rel=[\"']sitemap[\"']"
DESCRIPTION = "(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"'][^\"']+[\"']|<meta[^>]+content=[\"'][^\"']+[\"'][^>]+name=[\"']description[\"']"


def q(text: str | None) -> str:
    """A string literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lit(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
    return q(value) if isinstance(value, str) else str(value)


def rows(values, columns: str, casts: str = "") -> str:
    body = ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values)
    return f"SELECT {casts or '*'} FROM (VALUES {body}) AS t({columns})"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


NL = "chr(10)"


def one_line(x: str) -> str:
    return f"trim({replaced(x, WS + '+', q(' '))})"


def raw_text(x: str) -> str:
    y = replaced(replaced(replaced(replaced(f"coalesce({x}, '')", COMMENT, "''"), SILENT, "''"), BLOCK, NL), TAG, "''")
    for reference, character in REFERENCES:
        y = f"replace({y}, {q(reference)}, {q(character)})"
    return f"array_to_string(list_filter(list_transform(string_split({y}, {NL}), lambda l: {one_line('l')}), lambda l: l <> ''), {NL})"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def shing(t: str) -> str:
    return f"CASE WHEN len({t}) < 6 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len({t}) - 4), lambda i: array_to_string({t}[i:i + 5], ' ')) END"


def distinct_words(t: str) -> str:
    common = "[" + ", ".join(map(q, COMMON)) + "]"
    return f"list_filter({t}, lambda w: regexp_matches(w, '^[0-9]') OR (length(w) >= 5 AND NOT list_contains({common}, w)))"


def share(needles: str, hay: str) -> str:
    return f"CASE WHEN len({needles}) = 0 THEN 0.0 ELSE len(list_filter({needles}, lambda n: list_contains({hay}, n)))::DOUBLE / len({needles}) END"


def scripts(x: str) -> str:
    heads, bodies = f"regexp_extract_all({x}, {q(SCRIPT)}, 1)", f"regexp_extract_all({x}, {q(SCRIPT)}, 2)"
    pair = f"list_zip({heads}, {bodies})"
    return f"array_to_string(list_transform(list_filter({pair}, lambda s: NOT regexp_matches(s[1], '(?i)\\bsrc\\s*=|\\bsrc\\s*$') AND {one_line('s[2]')} <> ''), lambda s: s[2]), {NL})"


def unescaped(x: str) -> str:
    """For scripts without unicode escapes."""
    for old, new in ((r"\\n", NL), (r"\\t", "' '"), (r"\\/", "'/'"), (r"\\([\"'\\])", "'\\1'")):
        x = replaced(x, old, new)
    return x


def percent(x: str) -> str:
    return f"CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


def filled(text: str, **values: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(f"CAST({values[p]} AS VARCHAR)" if i % 2 else q(p) for i, p in enumerate(parts) if i % 2 or p)


def case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


PAGES = f"""
pg AS (SELECT page_id AS scan_id, url, html, regexp_extract(html, {q('(?is)(<article[^>]*>)(.*?)(</article[ ]*>)')}, 2) AS inner_a FROM pages),
th AS (SELECT *, split_part(html, '<article>', 1) AS before, regexp_extract(html, '(?is)</article[ ]*>(.*)$', 1) AS after, string_split(inner_a, '<p>') AS parts,
  replace(replace(replace({replaced('inner_a', TAG, "' '")}, '\\', '\\\\'), '"', '\\"'), {NL}, '\\n') AS quoted FROM pg),
rh AS (SELECT *, CASE scan_id % 4 WHEN 1 THEN [''] WHEN 2 THEN [''] WHEN 3 THEN parts[1:CAST(ceil(len(parts) / 2) AS BIGINT)] ELSE parts END AS raw_parts FROM th),
raw AS (SELECT *, CASE scan_id % 4
  WHEN 1 THEN before || '<article></article><script>var data = "' || quoted || '";</script>' || after
  WHEN 2 THEN before || '<article></article>' || after
  WHEN 3 THEN before || '<article>' || array_to_string(raw_parts, '<p>') || '</article>' || after
  ELSE html END AS raw_html FROM rh)"""

_hrefs = r"""(?is)<a\b[^>]*?\bhref="([^"]*)\""""


def decoded(x: str) -> str:
    for reference, character in REFERENCES:
        x = f"replace({x}, {q(reference)}, {q(character)})"
    return x


def _element(tag: str, kind: str) -> str:
    """An element of the pages' own four, which each stands once: its place and source."""
    opening, closing = f"'<{tag}>'", f"'</{tag.split()[0]}>'"
    return f"""{{'kind': '{kind}', 's': strpos(html, {opening}) - 1, 'outer': substring(html, strpos(html, {opening}), strpos(substring(html, strpos(html, {opening})), {closing}) + {len(closing) - 3})}}"""


_tall = "80"
_shows = lambda x: f"{raw_text(x)} <> ''"
#: The largest element of the list c that has elements in it, and c with that opened: a paragraph gives way to the b in it.
_descent = lambda before, after: f"""
{before}_g AS (SELECT *, CASE WHEN len(c) < 3 AND NOT stop THEN list_sort(list_transform(list_filter(c, lambda x: x.kind IN ('pb', 'b')), lambda x: {{'n': -length(x.outer), 's': x.s, 'kind': x.kind, 'outer': x.outer}}))[1] END AS g FROM {before}),
{after} AS (SELECT * EXCLUDE (c, g, stop), coalesce(g.kind = 'pb' AND length(g.outer) - 3 >= {_tall} AND {_shows("substring(g.outer, 4)")}, FALSE) AS opens_{after},
  CASE WHEN opens_{after} THEN list_concat(list_filter(c, lambda x: x.s <> g.s), [{{'kind': 'b', 's': g.s + 3, 'outer': substring(g.outer, 4)}}]) ELSE c END AS c, NOT opens_{after} AS stop FROM {before}_g)"""  # noqa: E731
_descents = ",".join(_descent(*step) for step in (("d0", "d1"), ("d1", "d2"), ("d2", "d3")))
_nth = "CASE WHEN len(parts) > 2 THEN ':nth-of-type(' || k || ')' ELSE '' END"

#: Regions of pages of one build: a nav, a div, an article of a heading and paragraphs that may lack their end, a footer.
REGIONS = f"""
e0 AS (SELECT scan_id, url, html, raw_html, parts, raw_parts, {_element('nav', 'nav')} AS nav, {_element('footer', 'footer')} AS foot, {_element('div class="ad"', 'ad')} AS ad, {_element('article', 'article')} AS art FROM raw),
e1 AS (SELECT *, list_concat([{{'kind': 'h1', 's': art.s + 9, 'outer': parts[1]}}], list_transform(range(2, len(parts) + 1), lambda i: {{
  'kind': CASE WHEN parts[i][1:3] = '<b>' THEN 'pb' ELSE 'p' END, 's': art.s + 9 + length(array_to_string(parts[1:i - 1], '<p>')), 'outer': '<p>' || parts[i]}})) AS inside FROM e0),
e2 AS (SELECT *, list_filter([ad, art], lambda x: length(x.outer) >= CASE x.kind WHEN 'ad' THEN {_tall} ELSE 40 END) AS c0,
  list_filter(inside, lambda x: length(x.outer) >= {_tall} AND {_shows('x.outer')}) AS found FROM e1),
d0 AS (SELECT *, len(found) = 0 AS stop, CASE WHEN len(found) = 0 THEN c0 ELSE list_concat(list_filter(c0, lambda x: x.kind <> 'article'), found) END AS c FROM e2),{_descents},
u AS (SELECT scan_id, url, raw_html, parts, raw_parts, art, unnest(list_concat([nav, foot], c)) AS x, unnest(range(len(c) + 2)) AS place FROM d3),
v AS (SELECT *, x.kind AS kind, x.s AS s, x.outer AS outer_html, row_number() OVER (PARTITION BY scan_id ORDER BY length(x.outer) DESC, place) AS size FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY s, place) AS region_ord,
  len(list_filter(range(2, len(parts) + 1), lambda i: art.s + 9 + length(array_to_string(parts[1:i - 1], '<p>')) <= s)) AS k FROM v WHERE size <= 24),
st AS (SELECT scan_id, url, raw_html, region_ord, s AS y, length(outer_html) AS height, outer_html,
  CASE kind WHEN 'nav' THEN 'Navigation' WHEN 'footer' THEN 'Footer' WHEN 'article' THEN coalesce(nullif(substring({raw_text('parts[1]')}, 1, 60), ''), 'Article') ELSE 'Section ' || region_ord END AS name,
  CASE kind WHEN 'ad' THEN 'body > div' WHEN 'h1' THEN 'body > article > h1' WHEN 'p' THEN 'body > article > p' || {_nth} WHEN 'pb' THEN 'body > article > p' || {_nth} WHEN 'b' THEN 'body > article > p' || {_nth} || ' > b' ELSE 'body > ' || kind END AS selector,
  CASE kind WHEN 'article' THEN '<article>' || array_to_string(raw_parts, '<p>') || '</article>' WHEN 'h1' THEN raw_parts[1] WHEN 'p' THEN '<p>' || raw_parts[k + 1] WHEN 'pb' THEN '<p>' || raw_parts[k + 1]
    WHEN 'b' THEN raw_parts[k + 1] ELSE outer_html END AS raw_whole FROM o),
tx AS (SELECT * REPLACE (coalesce(raw_whole, '') AS raw_whole), {decoded(replaced("coalesce(raw_whole, '')", TAG, "''"))} AS raw_inner, trim({replaced(f"lower({raw_text('outer_html')})", WS + '+', "' '")}) AS text FROM st)"""

COVERED = f"""
hy AS (SELECT scan_id, list_distinct(ht) AS ht, list_distinct({shing('ht')}) AS hs, list_distinct(st) AS st, list_distinct({shing('st')}) AS ss FROM (
  SELECT scan_id, {toks(raw_text('raw_html'))} AS ht, {toks(f"sc || {NL} || {unescaped('sc')}")} AS st FROM (SELECT scan_id, raw_html, {scripts('raw_html')} AS sc FROM raw))),
nd AS (SELECT scan_id, region_ord, name, selector, url, raw_html, raw_inner, raw_whole, outer_html, y, height, t, {shing('t')} AS s, CASE WHEN len({distinct_words('t')}) = 0 THEN t ELSE {distinct_words('t')} END AS d FROM (SELECT *, {toks('text')} AS t FROM tx)),
cv AS (SELECT nd.*, len(t) AS words,
  CASE WHEN len(t) = 0 THEN 0.0 WHEN len(t) >= 12 THEN {share('s', 'hs')} ELSE {share('d', 'ht')} END AS coverage,
  CASE WHEN len(t) = 0 THEN 0.0 WHEN len(t) >= 12 THEN {share('s', 'ss')} ELSE {share('d', 'st')} END AS in_scripts FROM nd JOIN hy USING (scan_id))"""

_links = f"len(regexp_extract_all(outer_html, {q(_hrefs)}, 1))"
_container = (
    f"CASE WHEN raw_whole = '' THEN {filled(W.CONTAINER[0], selector='selector')} WHEN {one_line('raw_inner')} = '' THEN {filled(W.CONTAINER[1], selector='selector')} "
    f"ELSE {filled(W.CONTAINER[2], selector='selector', raw_words=f'len({toks(raw_text("raw_inner"))})')} END"
)
_values = {
    "words": "words", "coverage": percent("coverage"), "in_scripts": percent("in_scripts"), "container": _container,
    "found": "CAST(floor(coverage * words + 0.5) AS BIGINT)", "missing": "CAST(floor((1 - coverage) * words + 0.5) AS BIGINT)",
    "iframe_src": "''", "carrier": "''", "routes": "0", "links": "0",
}
CLASSED = f"""
cl AS (SELECT *, CASE WHEN coverage < 0.5 AND in_scripts >= 0.5 THEN 'data_in_script_variable' WHEN coverage < {NEARLY_NONE} THEN 'js_rendered_content'
  WHEN coverage >= {NEARLY_ALL} THEN 'fully_visible' ELSE 'partial_content' END AS issue_type FROM cv WHERE NOT (words = 0 AND {_links} = 0)),
ev AS (SELECT *, {case(W.VERDICT_OF, 'issue_type')} AS status,
  CASE issue_type {' '.join(f"WHEN {q(k)} THEN {filled(W.EVIDENCE[k], **_values)}" for k in ('data_in_script_variable', 'js_rendered_content', 'fully_visible', 'partial_content'))} END AS evidence FROM cl),
ra AS (SELECT *, greatest(words::DOUBLE / nullif(sum(words) OVER w, 0), (height * 1280)::DOUBLE / nullif(sum(height * 1280) OVER w, 0)) AS raw_w FROM ev WINDOW w AS (PARTITION BY scan_id)),
we AS (SELECT *, CASE WHEN sum(raw_w) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE raw_w / sum(raw_w) OVER w END AS weight FROM ra WINDOW w AS (PARTITION BY scan_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round({case(W.SEVERITY, 'status')} * weight, 12) DESC, {case(W.SEVERITY, 'status')} DESC, round(weight, 12) DESC, region_ord) AS rank FROM we)"""

FULL = f"WITH {PAGES}, {REGIONS}, {COVERED}, {CLASSED}"
SCORE = f"sc AS (SELECT scan_id, CAST(floor(round(sum(weight * {case(W.VERDICT_VALUE, 'status')} * 100), 9) + 0.5) AS BIGINT) AS score, count(*) AS n_regions FROM rk GROUP BY scan_id)"


def stack(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(s)}" for s, p, _ in MARKERS) + f" WHEN regexp_matches({x}, {q(EMPTY_ROOT)}) THEN {q(CLIENT_APP)} ELSE {q(UNKNOWN)} END"


def signals(x: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({x}, {q(p)}) THEN {q(g)} END" for _, p, g in MARKERS)
    found = f"list_filter([{hits}], lambda g: g IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, '|') WHEN regexp_matches({x}, {q(EMPTY_ROOT)}) THEN {q(EMPTY_ROOT_SIGNAL)} ELSE '' END"


def prompt(issue: str) -> str:
    opening, body, what, end = W.PROMPTS[issue]
    text = W.PROMPT_HEADER.replace("{opening}", opening) + "\n\n" + body + ("\n" + W.PROMPT_VERIFY.replace("{what}", what) if what else "") + (f"\n\n{end}" if end else "")
    line = one_line("raw_whole")
    snippet = f"CASE WHEN raw_whole = '' THEN {filled(W.SNIPPET_ABSENT, selector='selector')} WHEN length({line}) > 600 THEN substring({line}, 1, 600) || '…' ELSE {line} END"
    signal = f"CASE WHEN {signals('raw_html')} = '' THEN '' ELSE ' (signals: ' || replace({signals('raw_html')}, '|', ', ') || ')' END"
    return filled(text, url="url", stack=f"({stack('raw_html')})", signals=f"({signal})", name="name", selector="selector", evidence="evidence", snippet=f"({snippet})")


PROMPTED = f"pr AS (SELECT *, CASE issue_type {' '.join(f'WHEN {q(k)} THEN {prompt(k)}' for k in ('data_in_script_variable', 'js_rendered_content', 'partial_content'))} END AS fix_prompt FROM rk)"
FLAT = lambda x: f"substring(regexp_replace(regexp_replace(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'), '[`#>\\[\\]|]', '', 'g'), {q('^' + WS + '+|' + WS + '+$')}, '', 'g'), 1, 200)"
FENCE = lambda x: f"repeat('`', CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r))), 0) + 1) AS INTEGER))"
_yes = lambda x, a, b: f"CASE WHEN {x} THEN {q(a)} ELSE {q(b)} END"
CHECK = {"has_json_ld": JSON_LD, "has_title": TITLE, "has_meta_description": DESCRIPTION, "has_sitemap_reference": SITEMAP}
_has = {k: f"coalesce(regexp_matches(raw_html, {q(p)}), FALSE)" for k, p in CHECK.items()}
LINES = (
    f"'- robots.txt: not found' || {NL} || '- llms.txt: not found' || {NL} || '- JSON-LD structured data: ' || {_yes(_has['has_json_ld'], 'present', 'none found')} || {NL} || '- <title>: ' || {_yes(_has['has_title'], 'present', 'missing')}"
    f" || {NL} || '- meta description: ' || {_yes(_has['has_meta_description'], 'present', 'missing')} || {NL} || '- sitemap reference: ' || {_yes(_has['has_sitemap_reference'], 'present', 'none found')}"
    f" || {NL} || '- URL requires JS routing: ' || {_yes("contains(url, '#/')", 'yes (#/ route)', 'no')}"
)
FIX_PLAN = f"""{FULL}, {SCORE}, {PROMPTED},
fx AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round(weight * CASE status WHEN 'bad' THEN 1.0 ELSE 0.5 END, 12) DESC, rank) AS n FROM pr WHERE status IN ('bad', 'warn')),
en AS (SELECT scan_id, n, '### ' || n || '. ' || {FLAT('name')} || ' — ' || replace(issue_type, '_', ' ') || CASE status WHEN 'bad' THEN ' (invisible)' ELSE ' (partial)' END || {NL} || {NL} || 'Selector: `' || replace(selector, '`', '') || '`' || {NL} || 'Evidence: ' || {FLAT('evidence')}
  || {NL} || {NL} || {FENCE('fix_prompt')} || {NL} || fix_prompt || {NL} || {FENCE('fix_prompt')} || {NL} AS entry FROM fx),
bd AS (SELECT scan_id, '## Region fixes (' || count(*) || ', ordered by score impact)' || {NL} || {NL} || string_agg(entry, {NL} ORDER BY n) || {NL} AS body FROM en GROUP BY scan_id)
SELECT raw.scan_id, '# Crawler visibility fix plan — ' || url || {NL} || {NL} || 'Scanned: ' || strftime(make_timestamp((1700000000000 + raw.scan_id * 3600000) * 1000), '%a, %d %b %Y %H:%M:%S') || ' GMT · Visibility score: **' || coalesce(score, 0) || '/100** · '
  || coalesce(n_regions, 0) || ' regions analyzed' || {NL} || {NL} || '## Page-level checks' || {NL} || {NL} || {LINES} || {NL} || {NL}
  || coalesce(body, '## Region fixes' || {NL} || {NL} || 'Nothing to fix — every region is visible to crawlers.' || {NL}) || '---' || {NL} || {NL} || {q('> ' + W.CAVEAT)} || {NL} AS markdown,
  'visibility-' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || '-' || strftime(make_timestamp((1700000000000 + raw.scan_id * 3600000) * 1000), '%Y-%m-%d') || '.md' AS file_name
FROM raw LEFT JOIN sc USING (scan_id) LEFT JOIN bd USING (scan_id)"""

_rate = """
WITH RECURSIVE e AS (SELECT event_type AS ip, event_id AS req_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT ip, n, req_id, ts_ms, TRUE AS allowed, CAST(0 AS BIGINT) AS retry_after, [ts_ms] AS kept FROM e WHERE n = 1
  UNION ALL
  SELECT ip, n, req_id, ts_ms, len(live) < 10, CASE WHEN len(live) < 10 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 60000 - ts_ms) / 1000.0) AS BIGINT)) END, CASE WHEN len(live) < 10 THEN list_append(live, ts_ms) ELSE live END
  FROM (SELECT e.ip, e.n, e.req_id, e.ts_ms, list_filter(f.kept, lambda t: t > e.ts_ms - 60000) AS live FROM f JOIN e ON e.ip = f.ip AND e.n = f.n + 1)
)
SELECT ip, req_id, ts_ms, allowed, retry_after FROM f"""

_url = "regexp_replace(url, '#.*$', '')"
_query = f"list_filter(string_split(CASE WHEN contains({_url}, '?') THEN regexp_extract({_url}, '\\?(.*)$', 1) ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), {q(TRACKING)}))"
_pairs = f"list_transform(list_sort(list_transform({_query}, lambda p: [lower(split_part(p, '=', 1)), split_part(p, '=', 1), CASE WHEN contains(p, '=') THEN p ELSE p || '=' END])), lambda s: s[3])"
_path = f"regexp_extract({_url}, '^[a-z]+://[^/?]*([^?]*)', 1)"
URL_NORMALIZE = f"""
SELECT page_id, lower(regexp_extract({_url}, '^([a-z]+://[^/?]*)', 1)) || CASE WHEN {_path} IN ('', '/') THEN '/' ELSE regexp_replace({_path}, '/+$', '') END
  || CASE WHEN len({_query}) = 0 THEN '' ELSE '?' || array_to_string({_pairs}, '&') END AS normalized_url,
  CASE WHEN {_path} = '' THEN '/' ELSE {_path} END AS path, lower(regexp_extract({_url}, '^[a-z]+://([^/?:]*)', 1)) AS host FROM pages"""

_status_list = "[" + ", ".join(map(q, (*IN_FLIGHT, "done"))) + "]"
LOG = f"lg AS (SELECT conv_id AS scan_id, turn, {_status_list}[least(turn + 1, 6)] AS status, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations)"
SCANS = "sn AS (SELECT event_id AS scan_id, CAST(user_id AS VARCHAR) AS normalized_url, CASE event_type WHEN 'error' THEN 'error' ELSE 'done' END AS status, CAST(floor(value) AS BIGINT) AS score, ts AS finished_at FROM events)"
HALVES = """
pt AS (SELECT ['ok', 'warn', 'bad'][p_size % 3 + 1] AS status, CAST(floor(p_partkey / 16) AS BIGINT) AS pair_id, p_partkey AS region_ord, p_partkey % 2 = 0 AS is_before, '#' || replace(lower(p_brand), '#', '-') AS selector, p_type || ' ' || split_part(p_name, ' ', 1) AS name FROM part),
pv AS (SELECT * FROM pt WHERE is_before), nx AS (SELECT * FROM pt WHERE NOT is_before)"""


def _names(a: str, b: str) -> str:
    x, y = f"list_distinct({toks(a)})", f"list_distinct({toks(b)})"
    common = f"len(list_intersect({x}, {y}))"
    return f"{common}::DOUBLE / (len({x}) + len({y}) - {common})"


BOT = f"""
WITH p AS (SELECT page_id AS scan_id, url, html, page_id % 5 AS k, CASE WHEN page_id % 11 = 10 THEN 500 ELSE 200 END AS cs, octet_length(encode(html)) AS cb FROM pages),
c AS (SELECT *, CASE k WHEN 1 THEN 'Forbidden' WHEN 2 THEN '<html><body><h1>Just a moment...</h1><p>Checking your browser</p></body></html>'
  WHEN 3 THEN '<html><body><p>' || substring({raw_text('html')}, 1, 60) || '</p></body></html>' ELSE html END AS body, CASE k WHEN 1 THEN 403 ELSE 200 END AS s FROM p),
w AS (SELECT *, octet_length(encode(body)) AS b, {toks(raw_text('body'))} AS t, {toks(raw_text('html'))} AS ct FROM c),
ws AS (SELECT *, {shing('ct')} AS cg, list_distinct({shing('t')}) AS g, list_distinct(t) AS dt FROM w),
n AS (SELECT *, CASE WHEN s BETWEEN 200 AND 299 AND len(ct) >= 50 THEN CASE WHEN len(ct) < 12 OR len(t) < 12 THEN {share('ct', 'dt')} ELSE {share('cg', 'g')} END END AS cont FROM ws),
r AS (SELECT *, CASE WHEN cs NOT BETWEEN 200 AND 299 THEN NULL WHEN s IN (401, 403, 429) THEN 'status'
  WHEN regexp_matches(body, {q(CHALLENGE)}) AND NOT regexp_matches(html, {q(CHALLENGE)}) AND len(t) <= 300 THEN 'challenge' WHEN cont < 0.4 THEN 'divergence' END AS blocked_reason FROM n),
v AS (SELECT *, CASE blocked_reason {' '.join(f"WHEN {q(k)} THEN {filled(x, status='s', bytes='b', control_status='cs', control_bytes='cb', words='len(t)', control_words='len(ct)', containment='CAST(floor(cont * 100 + 0.5) AS BIGINT)')}" for k, x in W.BLOCKED_EVIDENCE.items())} END AS blocked_evidence FROM r)
SELECT scan_id, blocked_reason, blocked_evidence, md5({filled(W.BLOCKED_PROMPT, url='url', agent="'GPTBot/1.0'", status='s', bytes='b', control_status='cs', control_bytes='cb', evidence='blocked_evidence')}) AS prompt_md5,
  CAST(len(CASE WHEN blocked_reason IS NULL THEN t ELSE ct END) AS BIGINT) AS analyzed_words FROM v"""


def _grid() -> str:
    """Groups by hand for the fixed files: the group of each crawler, then rules by length."""
    chosen = []
    lines = X.ROBOTS_LINES
    for host in ("host0", "host1", "host2"):
        groups = sorted({n for h, _, n, k, _ in lines if h == host and n})
        agents = {g: [v for h, _, n, k, v in lines if h == host and n == g and k == "agent"] for g in groups}
        for crawler in CRAWLERS:
            name = crawler.lower()
            tiers = ([g for g in groups if name in agents[g]], [g for g in groups if any(a != "*" and a in name for a in agents[g])], [g for g in groups if "*" in agents[g]])
            found = next((t[0] for t in tiers if t), None)
            for h, _, n, k, v in lines:
                if h == host and n == found and k in ("allow", "disallow") and v:
                    like = v.rstrip("$").replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%") + ("" if v.endswith("$") else "%")
                    chosen.append((host, crawler, k == "allow", len(v), like))
    crawlers = ", ".join(f"({q(c)})" for c in CRAWLERS)
    return f"""
WITH c(crawler) AS (VALUES {crawlers}), r AS ({rows(chosen, 'host, crawler, allow, size, pattern')}),
p AS (SELECT page_id, 'host' || (page_id % 4) AS host, CASE WHEN {_path} = '' THEN '/' ELSE {_path} END AS path FROM pages),
m AS (SELECT page_id, r.crawler, arg_max(allow, size * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS allow FROM p JOIN r ON p.host = r.host AND p.path LIKE r.pattern ESCAPE '\\' GROUP BY page_id, r.crawler)
SELECT p.page_id, c.crawler, coalesce(allow, TRUE) AS allowed FROM p CROSS JOIN c LEFT JOIN m ON m.page_id = p.page_id AND m.crawler = c.crawler"""


_now = 1_800_000_000_000
_status7 = "[" + ", ".join(map(q, (*IN_FLIGHT, "done", "error"))) + "]"
_in_flight = "(" + ", ".join(map(q, IN_FLIGHT)) + ")"
_v4 = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in ((0, 16777215), (2130706432, 2147483647), (167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055), (2851995648, 2852061183)))


def _placed(high: str, wide: str, least: str) -> str:
    return f"""{FULL}, h AS (SELECT scan_id, region_ord, y, height AS tall, CAST({high} AS DOUBLE) AS h FROM rk)
SELECT scan_id, region_ord, CAST(0 AS DOUBLE) AS left_percent, round(CAST(y AS DOUBLE) / h * 100, 6) AS top_percent, CAST(100 AS DOUBLE) AS width_percent, round(greatest(CAST({least} AS DOUBLE), least(CAST(tall AS DOUBLE), h - y)) / h * 100, 6) AS height_percent FROM h WHERE y < h - {wide}"""


SQL: dict[str, str] = {
    "page_score": f"{FULL}, {SCORE} SELECT page_id AS scan_id, coalesce(score, 0) AS score, coalesce(n_regions, 0) AS n_regions FROM pages LEFT JOIN sc ON sc.scan_id = page_id",
    "url_normalize": URL_NORMALIZE,
    "url_cases": rows(X.URL_CASES, "input, normalized_url, requires_js_routing"),
    "raw_text": f"SELECT page_id, {raw_text('html')} AS raw_text FROM pages",
    "inline_scripts": f"WITH {PAGES} SELECT scan_id, {scripts('raw_html')} AS scripts, {unescaped(scripts('raw_html'))} AS unescaped FROM raw",
    "script_unescape": rows(X.ESCAPED, "script, unescaped"),
    "tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
    "shingles": f"SELECT item_id, CAST(len(s) AS BIGINT) AS n_shingles, md5(array_to_string(s, '|')) AS shingles_md5 FROM (SELECT item_id, {shing('t')} AS s FROM (SELECT item_id, {toks('text')} AS t FROM benchmark))",
    "distinctive_tokens": f"SELECT item_id, array_to_string({distinct_words('t')}, ' ') AS distinctive FROM (SELECT item_id, {toks('text')} AS t FROM benchmark)",
    "static_regions": f"WITH {PAGES}, {REGIONS} SELECT scan_id AS page_id, region_ord, selector, name, text, len({toks('text')}) AS word_count, y, height, least({_links}, 60) AS n_links FROM tx",
    "resolved_links": f"""WITH {PAGES}, {REGIONS}, l AS (SELECT scan_id, url, region_ord, unnest(regexp_extract_all(outer_html, {q(_hrefs)}, 1)[1:60]) AS h, unnest(range(len(regexp_extract_all(outer_html, {q(_hrefs)}, 1)[1:60]))) AS link_ord FROM tx)
SELECT scan_id AS page_id, region_ord, link_ord, {decoded('h')} AS href, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || {decoded('h')} AS resolved, regexp_matches(h, '^#/|(?i)^javascript:') AS is_client_route FROM l""",
    "region_coverage": f"WITH {PAGES}, {REGIONS}, {COVERED} SELECT scan_id, region_ord, round(coverage, 9) AS coverage, round(in_scripts, 9) AS found_in_scripts FROM cv",
    "classify": f"{FULL} SELECT scan_id, region_ord, issue_type, status, evidence FROM rk",
    "classify_cases": rows([(c[0], c[1], *c[8:]) for c in X.CLASSIFIED if c[8]], "scan_id, region_ord, issue_type, status, evidence", "CAST(scan_id AS BIGINT) AS scan_id, CAST(region_ord AS BIGINT) AS region_ord, issue_type, status, evidence"),
    "weights": f"{FULL} SELECT scan_id, region_ord, round(weight + 1e-12, 9) AS weight FROM rk",
    "issue_order": f"{FULL} SELECT scan_id, rank, region_ord, issue_type FROM rk",
    "verdict_counts": f"{FULL} SELECT scan_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'bad') AS n_bad FROM rk GROUP BY scan_id",
    "verdict_shares": f"{FULL} SELECT scan_id, " + ", ".join(f"CAST(floor(round(sum(CASE WHEN status = '{v}' THEN weight ELSE 0 END) / sum(weight) * 100, 9) + 0.5) AS BIGINT) AS {v}_percent" for v in ("ok", "warn", "bad")) + " FROM rk GROUP BY scan_id",
    "region_labels": f"{FULL} SELECT scan_id, region_ord, {case(W.VERDICT_LABEL, 'status')} AS verdict_label, {case(W.ISSUE_LABEL, 'issue_type')} AS issue_label, {case(W.WHY_IT_MATTERS, 'issue_type')} AS why, {case(W.HOW_TO_FIX, 'issue_type')} AS how, CAST(floor(round(weight * 100, 9) + 0.5) AS BIGINT) AS weight_percent FROM rk",
    "map_placement": _placed("least(greatest(scan_id % 3 * 700, 800), 8000)", "24", "24.0"),
    "screenshot_placement": _placed("1500", "0", "0.0"),
    "fix_prompts": f"{FULL}, {PROMPTED} SELECT scan_id, region_ord, fix_prompt FROM pr",
    "fix_plan": FIX_PLAN,
    "bot_block": BOT,
    "typed_errors": rows([(r[0], *r[5:]) for r in X.RESPONSES], "scan_id, error_type, error_message", "CAST(scan_id AS BIGINT) AS scan_id, error_type, error_message"),
    "redirect_chains": rows(X.FOLLOWED, "scan_id, final_url, n_redirects, error_type", "CAST(scan_id AS BIGINT) AS scan_id, final_url, CAST(n_redirects AS BIGINT) AS n_redirects, error_type"),
    "ip_guard": f"""WITH a AS (SELECT address FROM ({rows(X.V4, 'address, x')}) UNION SELECT (s_suppkey % 256) || '.' || (s_suppkey * 7 % 256) || '.3.4' FROM supplier),
n AS (SELECT address, CASE WHEN regexp_matches(address, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') AND list_max(CAST(string_split(address, '.') AS BIGINT[])) < 256 THEN list_sum(list_transform(list_zip(CAST(string_split(address, '.') AS BIGINT[]), [16777216, 65536, 256, 1]), lambda z: z[1] * z[2])) END AS n FROM a)
SELECT address, coalesce({_v4}, FALSE) AS is_private FROM n""",
    "ip_guard_v6": rows(X.V6, "address, is_private"),
    "host_guard": rows(X.HOSTS, "host, error_type"),
    "fingerprint": f"SELECT page_id, {stack('html')} AS stack, {signals('html')} AS signals FROM pages",
    "fingerprint_cases": rows(X.STACKS, "html, stack, signals"),
    "page_checks": f"SELECT page_id, {', '.join(f'coalesce(regexp_matches(html, {q(p)}), FALSE) AS {k}' for k, p in CHECK.items())}, contains(url, '#/') AS requires_js_routing FROM pages",
    "robots_parse": rows(X.ROBOTS_LINES, "host, line_no, grp, kind, value", "host, CAST(line_no AS BIGINT) AS line_no, CAST(grp AS BIGINT) AS grp, kind, value"),
    "robots_grid": _grid(),
    "llms_check": rows([(r[0], *r[5:]) for r in X.LLMS], "scan_id, present, links_to_path", "CAST(scan_id AS BIGINT) AS scan_id, present, links_to_path"),
    "scan_history_delta": f"WITH {SCANS} SELECT scan_id, lag(scan_id) OVER w AS prev_scan_id, lag(score) OVER w AS prev_score, score - lag(score) OVER w AS score_delta FROM sn WHERE status = 'done' WINDOW w AS (PARTITION BY normalized_url ORDER BY finished_at, scan_id)",
    "dedupe_cached": """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS normalized_url, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms, ts FROM events),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url, ts ORDER BY event_id DESC) AS k FROM e WHERE event_id % 3 <> 0) WHERE k = 1)
SELECT a.event_id AS req_id, a.normalized_url, CASE WHEN a.event_id % 2 <> 0 AND a.ms - d.ms < 600000 THEN d.event_id END AS cached_scan_id, CASE WHEN a.event_id % 2 <> 0 AND a.ms - d.ms < 600000 THEN CAST(floor((a.ms - d.ms) / 1000.0 + 0.5) AS BIGINT) END AS age_seconds
FROM (SELECT * FROM e WHERE event_id % 3 = 0) a ASOF LEFT JOIN d ON a.normalized_url = d.normalized_url AND a.ts >= d.ts""",
    "recent_scans": f"""WITH {SCANS}, t AS (SELECT * FROM sn WHERE status = 'done' ORDER BY finished_at DESC, scan_id DESC LIMIT 60),
u AS (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY finished_at DESC, scan_id DESC) AS k FROM t WHERE score IS NOT NULL)
SELECT scan_id, normalized_url, score FROM u WHERE k = 1 ORDER BY finished_at DESC, scan_id DESC LIMIT 8""",
    "rescan_selector": f"""WITH {HALVES}, a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, selector ORDER BY region_ord) AS k FROM pv), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, selector ORDER BY region_ord) AS k FROM nx)
SELECT a.pair_id, a.region_ord AS prev_ord, b.region_ord AS next_ord FROM a JOIN b USING (pair_id, selector, k)""",
    "rescan_similarity": f"WITH {HALVES}, s AS (SELECT pv.pair_id, pv.region_ord AS prev_ord, nx.region_ord AS next_ord, round({_names('pv.name', 'nx.name')}, 9) AS similarity FROM pv JOIN nx USING (pair_id)) SELECT * FROM s WHERE similarity > 0",
    "event_sequence": f"WITH {LOG} SELECT scan_id, turn, status, seq FROM lg",
    "event_replay": f"WITH {LOG}, x AS (SELECT scan_id, min(seq) AS e FROM lg WHERE status = 'done' GROUP BY scan_id) SELECT scan_id AS client_id, scan_id, seq, status FROM lg LEFT JOIN x USING (scan_id) WHERE seq > scan_id % 3 AND (e IS NULL OR seq <= e)",
    "scan_progress": f"WITH {LOG} SELECT scan_id, arg_max(status, seq) AS status, max(seq) AS seq, {case(PROGRESS, 'arg_max(status, seq)')}::DOUBLE AS progress FROM lg GROUP BY scan_id",
    "finished_events": f"WITH {SCANS} SELECT scan_id AS client_id, scan_id, scan_id % 4 + 1 AS seq, status, score FROM sn",
    "rate_limit": _rate,
    "queue_positions": "WITH s AS (SELECT event_id AS scan_id, CASE WHEN event_id % 100 < 2 THEN 'running' WHEN event_id % 100 < 50 THEN 'waiting' ELSE 'done' END AS state, ts FROM events) SELECT scan_id, state, CASE state WHEN 'running' THEN 0 WHEN 'waiting' THEN row_number() OVER (PARTITION BY state ORDER BY ts, scan_id) END AS position FROM s",
    "boot_sweep": f"WITH s AS (SELECT event_id AS scan_id, {_status7}[event_id % 7 + 1] AS status, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms FROM events) SELECT scan_id, CASE WHEN status IN {_in_flight} THEN 'error' ELSE status END AS status, CASE WHEN status IN {_in_flight} THEN {q(W.SWEPT[0])} END AS error_type, CASE WHEN status IN {_in_flight} THEN {q(W.SWEPT[1])} END AS error_message, CASE WHEN status IN {_in_flight} THEN {_now} ELSE ms END AS finished_ms FROM s",
    "blob_cap": f"WITH t AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || {q(W.TRUNCATED)} ELSE text END AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t",
    "new_scans": rows([(c[0].strip(), c[1], "queued" if c[1] else "error", None if c[1] else "invalid_url") for c in X.URL_CASES], "input_url, normalized_url, status, error_type"),
    "latest_rows": "SELECT user_id AS scan_id, max(event_id) AS version, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
    "time_ago": """WITH t AS (SELECT event_id, event_id * 37 AS s, floor(event_id * 37 / 60.0 + 0.5) AS m FROM events), h AS (SELECT *, floor(m / 60 + 0.5) AS h FROM t)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min ago' WHEN h < 24 THEN CAST(h AS BIGINT) || ' h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || ' d ago' END AS told, CAST(m AS BIGINT) AS age_minutes FROM h""",
    "error_screens": rows([(e, *W.ERROR_COPY.get(e, W.ERROR_COPY[None])) for e in X.ERROR_TYPES], "error_type, title, what, next"),
    "passage_coverage": f"""WITH b AS (SELECT item_id, {toks('text')} AS t FROM benchmark), s AS (SELECT item_id, CASE WHEN len(t) >= 12 THEN {shing('t')} WHEN len({distinct_words('t')}) > 0 THEN {distinct_words('t')} ELSE t END AS s, len(t) >= 12 AS by_shingle FROM b),
n AS (SELECT item_id, by_shingle, len(s) AS n, unnest(s) AS g FROM s), d AS (SELECT doc_id, {toks('text')} AS t FROM documents),
h AS (SELECT DISTINCT doc_id, TRUE AS by_shingle, unnest({shing('t')}) AS g FROM d UNION ALL SELECT DISTINCT doc_id, FALSE, unnest(t) FROM d)
SELECT item_id, doc_id, round(count(*)::DOUBLE / n, 9) AS coverage FROM n JOIN h USING (by_shingle, g) GROUP BY item_id, doc_id, n""",
}
_n_links = f"least({_links}, 60)"
_captured_values = {**_values, "iframe_src": "'https://maps.example.com/embed'", "carrier": f"CASE kind WHEN 0 THEN {q(W.CARRIER[0])} ELSE {filled(W.CARRIER[1], images='2')} END", "routes": "n_routes", "links": "n_links"}
_ranked = f"row_number() OVER (PARTITION BY scan_id ORDER BY round({case(W.SEVERITY, 'status')} * weight, 12) DESC, {case(W.SEVERITY, 'status')} DESC, round(weight, 12) DESC, region_ord)"
SQL["captured_scan"] = f"""WITH {PAGES}, {REGIONS}, {COVERED},
fk AS (SELECT *, (scan_id * 7 + region_ord) % 5 AS kind, {_n_links} AS n_links, CASE WHEN scan_id % 3 = 0 THEN {_n_links} ELSE 0 END AS n_routes FROM cv),
ft AS (SELECT *, CASE WHEN kind = 1 AND coverage < 0.15 THEN 'iframe_embed' WHEN kind IN (0, 2) AND coverage < 0.3 THEN 'canvas_or_image_data' WHEN coverage < 0.5 AND in_scripts >= 0.5 THEN 'data_in_script_variable'
  WHEN coverage < 0.15 THEN 'js_rendered_content' WHEN n_links >= 2 AND n_routes > 0 AND scan_id % 6 <> 0 THEN 'client_side_routes' WHEN coverage >= 0.9 THEN 'fully_visible' ELSE 'partial_content' END AS issue_type
  FROM fk WHERE NOT (words = 0 AND n_links = 0 AND kind NOT IN (0, 1, 2))),
fs AS (SELECT *, {case(W.VERDICT_OF, 'issue_type')} AS status,
  CASE issue_type {' '.join(f"WHEN {q(k)} THEN {filled(v, **_captured_values)}" for k, v in W.EVIDENCE.items() if k != 'hidden_but_present')} END AS evidence FROM ft),
fr AS (SELECT *, greatest(words::DOUBLE / nullif(sum(words) OVER w, 0), height::DOUBLE / nullif(sum(height) OVER w, 0)) AS raw_w FROM fs WINDOW w AS (PARTITION BY scan_id)),
fw AS (SELECT *, raw_w / sum(raw_w) OVER (PARTITION BY scan_id) AS weight FROM fr),
hb AS (SELECT scan_id, {toks(raw_text("'<p>' || parts[2]"))} AS t FROM raw WHERE len(parts) > 1),
hn AS (SELECT scan_id, t, {shing('t')} AS s, CASE WHEN len({distinct_words('t')}) = 0 THEN t ELSE {distinct_words('t')} END AS d FROM hb),
hc AS (SELECT scan_id, t, CASE WHEN len(t) >= 12 THEN {share('s', 'hs')} ELSE {share('d', 'ht')} END AS coverage FROM hn JOIN hy USING (scan_id) WHERE len(t) > 0),
un AS (SELECT scan_id, region_ord, selector, issue_type, status, evidence, weight FROM fw UNION ALL
  SELECT scan_id, 1 + n, '#hidden', 'hidden_but_present', 'ok', {filled(W.EVIDENCE['hidden_but_present'], words='len(t)')}, 0.0 FROM hc JOIN (SELECT scan_id, count(*) AS n FROM tx GROUP BY scan_id) USING (scan_id) WHERE coverage >= 0.9)
SELECT scan_id, region_ord, selector, issue_type, status, evidence, round(weight + 1e-12, 9) AS weight, {_ranked} AS rank FROM un"""
SQL["probe_outcomes"] = f"""WITH {PAGES}, {REGIONS}, l AS (SELECT scan_id, url, {decoded(f"regexp_extract(outer_html, {q(_hrefs)}, 1)")} AS h, {_n_links} AS n FROM tx)
SELECT scan_id, CASE WHEN scan_id % 6 = 0 THEN 'javascript:open' WHEN scan_id % 3 = 0 THEN regexp_replace(url, '#.*$', '') || '#/start' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || h END AS url, scan_id % 3 <> 0 OR scan_id % 6 = 0 AS distinct_content FROM l WHERE n > 0"""
# Greedy matching by likeness: region after region takes the likest one that is left.
CHANGES = f"""WITH RECURSIVE {HALVES.strip()},
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, selector ORDER BY region_ord) AS k FROM pv), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, selector ORDER BY region_ord) AS k FROM nx),
ms AS (SELECT a.pair_id, a.region_ord AS p, b.region_ord AS n FROM a JOIN b USING (pair_id, selector, k)),
lp AS (SELECT * FROM pv WHERE region_ord NOT IN (SELECT p FROM ms)), ln AS (SELECT * FROM nx WHERE region_ord NOT IN (SELECT n FROM ms)),
cd AS (SELECT ln.pair_id, ln.region_ord AS n, list({{'s': -{_names('lp.name', 'ln.name')}, 'p': lp.region_ord}}) FILTER ({_names('lp.name', 'ln.name')} >= 0.6) AS c FROM ln LEFT JOIN lp USING (pair_id) GROUP BY ln.pair_id, ln.region_ord),
st AS (SELECT pair_id, n, list_sort(coalesce(c, [])) AS c, row_number() OVER (PARTITION BY pair_id ORDER BY n) AS i FROM cd),
gr AS (
  SELECT pair_id, i, n, c[1].p AS p, CASE WHEN len(c) = 0 THEN CAST([] AS BIGINT[]) ELSE [c[1].p] END AS taken FROM st WHERE i = 1
  UNION ALL
  SELECT pair_id, i, n, f.p, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f.p) END FROM (
    SELECT st.pair_id, st.i, st.n, gr.taken, list_filter(st.c, lambda x: NOT list_contains(gr.taken, x.p))[1] AS f FROM gr JOIN st ON st.pair_id = gr.pair_id AND st.i = gr.i + 1)
),
mt AS (SELECT 0 AS part, * FROM ms UNION ALL SELECT 1, pair_id, p, n FROM gr WHERE p IS NOT NULL),
al AS (
  SELECT mt.pair_id, part, n AS ord, nx.selector, nx.name, {case({'bad': 0, 'warn': 1, 'ok': 2}, 'nx.status')} - {case({'bad': 0, 'warn': 1, 'ok': 2}, 'pv.status')} AS step, pv.status AS before_status, nx.status AS after_status FROM mt JOIN pv ON pv.region_ord = p JOIN nx ON nx.region_ord = n
  UNION ALL SELECT pair_id, 2, region_ord, selector, name, NULL, NULL, status FROM ln WHERE region_ord NOT IN (SELECT n FROM mt)
  UNION ALL SELECT pair_id, 3, region_ord, selector, name, NULL, status, NULL FROM lp WHERE region_ord NOT IN (SELECT p FROM mt)
),
ch AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY part, ord) AS change_ord, selector, name, CASE part WHEN 2 THEN 'new' WHEN 3 THEN 'removed' ELSE CASE sign(step) WHEN 1 THEN 'improved' WHEN -1 THEN 'regressed' ELSE 'unchanged' END END AS change,
  before_status, 'issue_' || before_status AS before_issue, after_status, 'issue_' || after_status AS after_issue FROM al)"""
SQL["rescan_changes"] = f"{CHANGES} SELECT * FROM ch"
SQL["change_counts"] = f"{CHANGES} SELECT pair_id, " + ", ".join(f"count(*) FILTER (change = '{c}') AS n_{c}" for c in ("improved", "regressed", "unchanged", "new", "removed")) + " FROM ch GROUP BY pair_id"
_queue = """WITH RECURSIVE e AS (SELECT event_type AS queue, event_id AS scan_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS t0, (event_id % 50) * 4000 + 1000 AS lasts FROM events),
e2 AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY t0, scan_id) AS n FROM e),
r AS (
  SELECT queue, n, scan_id, t0, t0 AS start, t0 + lasts AS stop, CAST(0 AS BIGINT) AS free, t0 + lasts AS busy, CAST([] AS BIGINT[]) AS line FROM e2 WHERE n = 1
  UNION ALL
  SELECT queue, n, scan_id, t0, start, start + lasts, greatest(free, busy) AS free, start + lasts AS busy, CASE WHEN start > t0 THEN list_append(list_filter(line, lambda s: s > t0), start) ELSE list_filter(line, lambda s: s > t0) END
  FROM (SELECT e2.*, r.line, r.free, r.busy, greatest(e2.t0, least(r.free, r.busy)) AS start FROM r JOIN e2 ON e2.queue = r.queue AND e2.n = r.n + 1)
)
SELECT queue, scan_id, t0 AS arrival_ms, start AS start_ms, stop AS end_ms"""
SQL["queue_simulation"] = f"{_queue}, CASE WHEN start > t0 THEN len(line) ELSE 0 END AS position FROM r"
SQL["stream_queue"] = f"{_queue} FROM r"
SQL["stream_rate_limit"] = _rate
SQL["stream_event_log"] = "SELECT user_id AS scan_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)) // 1000, event_id) AS seq FROM events"
_article = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
SQL["parsed_pages"] = f"SELECT page_id, {raw_text('html')} AS raw_text, {scripts('html')} AS scripts, TRUE AS has_article, FALSE AS has_missing, CAST(len({toks(decoded(replaced(_article, TAG, "''")))}) AS BIGINT) AS article_words FROM pages"
#: Of the pages' elements only list items and paragraphs have others of their kind beside them.
SQL["node_table"] = "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n, CASE WHEN tag IN ('li', 'p') THEN count(*) ELSE 1 END AS most FROM t GROUP BY page_id, tag"
SQL["stream_reuse"] = SQL["dedupe_cached"]
SQL["event_frames"] = f"WITH x AS ({SQL['event_replay']}) SELECT client_id, scan_id, seq, 'id: ' || seq || chr(10) || 'data: {{\"status\":\"' || status || '\"}}' || chr(10) || chr(10) AS frame FROM x"
SQL["stream_frames"] = f"""WITH l AS (SELECT conv_id, turn + 1 AS seq, CASE WHEN turn >= 5 THEN 'done' ELSE 'fetching' END AS status FROM conversations)
SELECT conv_id AS client_id, conv_id AS scan_id, seq, 'id: ' || seq || chr(10) || 'data: {{"status":"' || status || '"}}' || chr(10) || chr(10) AS frame FROM l WHERE seq > conv_id % 3 AND seq <= 6"""
SQL["scan_telemetry"] = """WITH p AS (SELECT page_id AS scan_id, page_id % 5 AS k, html FROM pages)
SELECT scan_id, CASE k WHEN 1 THEN 403 ELSE 200 END AS crawler_status, crawler_bytes, CASE WHEN scan_id % 11 = 10 THEN 500 ELSE 200 END AS control_status, octet_length(encode(html)) AS control_bytes, scan_id * 7 % 1000 AS fetch_duration_ms,
  CASE WHEN scan_id % 4 <> 3 THEN scan_id * 31 % 5000 END AS render_duration_ms, CASE WHEN scan_id % 4 <> 3 THEN len(string_split(html, '<')) END AS request_count FROM p JOIN (""" + f"""
  SELECT page_id AS scan_id, octet_length(encode(CASE page_id % 5 WHEN 1 THEN 'Forbidden' WHEN 2 THEN '<html><body><h1>Just a moment...</h1><p>Checking your browser</p></body></html>'
    WHEN 3 THEN '<html><body><p>' || substring({raw_text('html')}, 1, 60) || '</p></body></html>' ELSE html END)) AS crawler_bytes FROM pages) USING (scan_id)"""
SQL["scan_errors"] = """SELECT event_id AS scan_id, ['timeout', 'dns_or_network', 'ssrf_blocked', 'render_failed'][event_id % 4 + 1] AS error_type,
  CASE WHEN event_id % 4 = 3 THEN 'The scan failed unexpectedly. Try again.' ELSE 'failed at ' || event_id END AS error_message FROM events WHERE event_type = 'error'"""
SQL["rendered_regions"] = SQL["static_regions"].replace(f"len({toks('text')}) AS word_count, ", "")
_headlines = {"queued": "Waiting for a scanner slot…", "fetching": "Fetching raw HTML…", "rendering": "Rendering in headless browser…", "diffing": "Diffing crawler view vs rendered DOM…", "classifying": "Classifying regions…", "done": "Working…"}
SQL |= {
    "request_validation": """WITH r AS (SELECT event_id AS req_id, CASE event_id % 6 WHEN 3 THEN 'https://e.example/' || event_id WHEN 5 THEN repeat('y', 2048) END AS url, event_id % 4 = 0 AS force FROM events)
SELECT req_id, length(url) AS n_chars, md5(url) AS url_md5, force FROM r WHERE url IS NOT NULL""",
    "client_addresses": "SELECT event_id, CASE event_id % 4 WHEN 2 THEN '10.0.0.' || event_id WHEN 3 THEN '9.9.9.9' ELSE 'local' END AS ip FROM events",
    "allowed_requests": "SELECT event_id AS request_id, event_type <> 'error' AND user_id % 3 <> 0 AS allowed FROM events",
    "transport_errors": "SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'dns_or_network' ELSE 'timeout' END AS fetch_error, ['timeout', 'dns_or_network', 'dns_or_network', 'dns_or_network', 'render_failed'][event_id % 5 + 1] AS render_error FROM events",
    "capped_bodies": """WITH c AS (SELECT doc_id, text, octet_length(encode(text)) AS n, CASE WHEN octet_length(encode(text)) <= 1000 THEN length(text) ELSE (SELECT max(k) FROM unnest(range(200, 1001)) AS u(k) WHERE octet_length(encode(substring(text, 1, k))) <= 1000) END AS k FROM documents)
SELECT doc_id, least(n, 1000) AS bytes, k AS n_chars, md5(substring(text, 1, k)) AS text_md5 FROM c""",
    "blocked_scores": f"{FULL}, {SCORE} SELECT page_id AS scan_id, page_id % 3 = 0 AS blocked, CASE WHEN page_id % 3 = 0 THEN least(10, coalesce(score, 0)) ELSE coalesce(score, 0) END AS score, coalesce(n_regions, 0) AS n_regions FROM pages LEFT JOIN sc ON sc.scan_id = page_id",
    "phase_lines": f"""WITH e AS (SELECT event_id AS n, ['queued', 'fetching', 'rendering', 'diffing', 'classifying', 'done'][event_id % 6 + 1] AS s FROM events)
SELECT n AS event_id, CASE WHEN n % 7 = 0 THEN '' WHEN s = 'fetching' THEN 'u' || n WHEN s = 'rendering' THEN 'HTTP ' || (n % 500) || ' · ' || n || ' bytes' || CASE WHEN n % 5 = 0 THEN ' · crawler blocked — using browser view' ELSE '' END
  WHEN s = 'diffing' THEN (n % 40) || ' requests · ' || (n % 24) || ' regions captured' WHEN s = 'classifying' THEN (n % 24) || ' regions · applying issue taxonomy' ELSE '' END AS line,
  CASE WHEN s = 'queued' AND n % 3 > 0 THEN 'Waiting — #' || (n % 3) || ' in line' ELSE {case(_headlines, 's')} END AS headline FROM e""",
    "kept_events": f"""WITH {LOG}, x AS (SELECT *, 1700000000000 + scan_id * 10000 + seq * 1000 AS ms FROM lg), z AS (SELECT scan_id, min(ms) FILTER (status = 'done') AS ended FROM x GROUP BY scan_id)
SELECT scan_id, seq, status FROM x JOIN z USING (scan_id) WHERE ended IS NULL OR 1700000700000 - ended < 300000""",
    "skeleton_bars": "SELECT event_id, bar, CASE WHEN event_id % 4 = 0 THEN 'ok' ELSE ['ok', 'warn', 'bad'][bar % (event_id % 4) + 1] END AS verdict FROM events, range(5) AS b(bar)",
    "status_documents": """WITH e AS (SELECT event_id AS n, event_id % 4 AS k FROM events)
SELECT n AS scan_id, '{"id":"' || n || '","url":"https://e.example/?a=\\"' || n || '","normalizedUrl":"https://e.example/","status":"' || ['queued', 'rendering', 'done', 'error'][k + 1] || '","progress":' || ['0.0', '0.45', '1.0', '1.0'][k + 1]
  || CASE k WHEN 0 THEN ',"queuePosition":' || (n % 9) WHEN 2 THEN ',"score":' || (n % 101) WHEN 3 THEN ',"errorType":"timeout","message":"too late"' ELSE '' END
  || ',"createdAt":"' || strftime(make_timestamp(n * 1000000 + 7000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' || CASE WHEN k > 1 THEN ',"finishedAt":"' || strftime(make_timestamp(n * 2000000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' ELSE '' END || '}' AS json FROM e""",
    "screenshot_sizes": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 1280 + 1 END AS width, CASE WHEN event_id % 5 <> 0 THEN event_id % 7000 + 1 END AS height FROM events",
    "stored_results": "SELECT event_id, event_id % 11 <> 0 AND event_id % 3 <> 0 AND event_id % 4 <> 3 AS readable FROM events",
}
ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_when = "strftime(make_timestamp((1700000000000 + raw.scan_id * 3600000) * 1000), '%a, %d %b %Y %H:%M:%S') || ' GMT'"
SQL["html_report"] = f"""{FULL}, {SCORE}, {PROMPTED},
sx AS (SELECT scan_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'bad') AS n_bad, string_agg(
  '<section class="region ' || status || '"><header><span class="tag">' || {case(W.VERDICT_LABEL, 'status')} || '</span> <h3>' || {ESC('name')} || '</h3> <code>' || {ESC('selector')} || '</code></header><p class="evidence">' || {ESC('evidence')} || '</p>'
  || CASE WHEN coalesce(fix_prompt, '') <> '' THEN '<details><summary>Fix prompt</summary><pre>' || {ESC('fix_prompt')} || '</pre></details>' ELSE '' END || '</section>', {NL} ORDER BY rank) AS body FROM pr GROUP BY scan_id),
rp AS (SELECT raw.scan_id, '<!doctype html>' || {NL} || '<html lang="en"><head><meta charset="utf-8"><title>Crawler visibility report — ' || {ESC('url')} || '</title></head><body><main>' || {NL}
  || '<h1>Crawler visibility report</h1><p>' || {ESC('url')} || ' · ' || {_when} || '</p><div class="score">' || coalesce(score, 0) || '/100</div>'
  || '<p>' || coalesce(n_ok, 0) || ' visible · ' || coalesce(n_warn, 0) || ' partial · ' || coalesce(n_bad, 0) || ' invisible</p>' || {NL}
  || '<h3>Regions</h3>' || {NL} || coalesce(body, '') || {NL} || '<h3>Page-level checks</h3><ul>'
  || array_to_string(list_transform(string_split({LINES}, {NL}), lambda x: '<li>' || {ESC("regexp_replace(x, '^-\\s*', '')")} || '</li>'), {NL}) || '</ul>' || {NL} || '<p>' || {q(W.CAVEAT).replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;').replace('"', '&quot;')} || '</p></main></body></html>' AS h
  FROM raw LEFT JOIN sc USING (scan_id) LEFT JOIN sx USING (scan_id))
SELECT scan_id, length(h) AS n_chars, md5(h) AS html_md5 FROM rp"""
SQL["hidden_blocks"] = f"""WITH c AS ({SQL['passage_coverage']})
SELECT doc_id AS scan_id, '#block-' || item_id AS selector, 'Hidden content (#block-' || item_id || ')' AS name, coverage, CAST(len({toks('text')}) AS BIGINT) AS word_count,
  {filled(W.EVIDENCE['hidden_but_present'], words=f"len({toks('text')})")} AS evidence FROM c JOIN benchmark USING (item_id) WHERE coverage >= {NEARLY_ALL}"""
