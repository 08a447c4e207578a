"""Queries over the tables, one for each operator or group of operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.functions import net, urls
from crawlvis.functions import text as T
from crawlvis.functions.fence import fenced
from crawlvis.operators import admission, events, history, pages, reporting, responses, robots, scoring, segmentation
from crawlvis.plans import fixtures, oracle, region_queries, scan, state_queries, web_queries
from crawlvis.sources import html as trees
from crawlvis.sources.shared import EACH, new_path, spread
from crawlvis.sources.tables import jpeg_dimensions, parsed_result, table
from crawlvis.streaming import delivery, stateful
from crawlvis.streaming import scans as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**web_queries.QUERIES, **state_queries.QUERIES, **region_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**oracle.SQL, **web_queries.SQL, **state_queries.SQL, **region_queries.SQL}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.rendered_regions(scan.raw_and_rendered(table(spark, sf_dir, "pages")))


def _results(spark: SparkSession, sf_dir: str, *, told: bool = False) -> DataFrame:
    return scan.region_results(_regions(spark, sf_dir), told=told)


def _prompted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages, and their regions with prompts."""
    heads = scan.raw_and_rendered(table(spark, sf_dir, "pages"))
    regions = scan.rendered_regions(scan.fingerprinted(heads), keep=("stack_found",))
    return heads, scan.with_prompts(scan.region_results(regions))


@query
def page_score(spark, sf_dir):
    """The flagship: every page's score from its regions."""
    heads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("scan_id"))
    return scoring.scores(_results(spark, sf_dir), heads)


@query
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized_url"), urls.pathname(F.col("url")).alias("path"), urls.host_of(F.col("url")).alias("host"))


@query
def url_cases(spark, sf_dir):
    return fixtures.url_cases(spark).select("input", urls.normalized(F.col("input")).alias("normalized_url"), urls.requires_js_routing(F.col("input")).alias("requires_js_routing"))


def _segmented(spark, sf_dir):
    """A row for each region of each page's source."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return segmentation.read_pages(rows, raw="html").select("page_id", "url", F.explode("regions").alias("r"))


@query
def resolved_links(spark, sf_dir):
    rows = _segmented(spark, sf_dir).select("page_id", "url", "r.region_ord", F.posexplode("r.links").alias("link_ord", "link"))
    return rows.select("page_id", "region_ord", F.col("link_ord").cast("long").alias("link_ord"), F.col("link.href").alias("href"), urls.resolved(F.col("link.href"), F.col("url")).alias("resolved"), F.col("link.is_client_route").alias("is_client_route"))


@query
def raw_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), EACH).select("page_id", T.raw_text(F.col("html")).alias("raw_text"))


@query
def inline_scripts(spark, sf_dir):
    raw = scan.raw_and_rendered(table(spark, sf_dir, "pages"))
    scripts = T.inline_scripts(F.col("raw_html"))
    return raw.select("scan_id", scripts.alias("scripts"), T.unescaped(scripts).alias("unescaped"))


@query
def script_unescape(spark, sf_dir):
    return fixtures.escaped_scripts(spark).select("script", T.unescaped(F.col("script")).alias("unescaped"))


@query
def tokens(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("tokens_md5"))


@query
def shingles(spark, sf_dir):
    found = T.shingles(T.tokens(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(found).cast("long").alias("n_shingles"), F.md5(F.array_join(found, "|")).alias("shingles_md5"))


@query
def distinctive_tokens(spark, sf_dir):
    words = T.distinctive(T.tokens(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("distinctive"))


#: Needles that are handed to every task; more are joined by a shuffle, in which a needle's documents are dealt over so many tasks.
FEW_NEEDLES, SALTS = 500_000, 16


def _covered(passages, docs, needles, hay):
    """item_id, doc_id, coverage of passages by the documents that have any of their needles (arrays of passages and of documents)."""
    parts = passages.select("item_id", needles.alias("s")).where("size(s) > 0")
    each = parts.select("item_id", F.size("s").alias("n"), F.explode("s").alias("needle")).groupBy("item_id", "n", "needle").agg(F.count("*").alias("times"))
    rows, on = docs.select("doc_id", F.explode(F.array_distinct(hay)).alias("needle")), ["needle"]
    if (parts.agg(F.sum(F.size("s"))).first()[0] or 0) <= FEW_NEEDLES:
        each = F.broadcast(each)
    else:
        each, on = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["needle", "salt"]
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = rows.join(each, on).groupBy("item_id", "doc_id", "n").agg(F.sum("times").alias("found"))
    return found.select("item_id", "doc_id", F.round(F.col("found") / F.col("n"), 9).alias("coverage"))


@query
def passage_coverage(spark, sf_dir):
    """Benchmark passages as regions and documents as pages: pairs that share a shingle or, for short passages, a telling word."""
    words = T.tokens(F.col("text"))
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    passages = fenced(passages, {"w": words}, drop=("text",)).where("size(w) > 0")
    docs = fenced(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), {"w": words}, drop=("text",))
    short, told = F.size("w") < T.SHORT_TOKENS, T.distinctive(F.col("w"))
    long = _covered(passages.where(~short), docs, T.shingles(F.col("w")), T.shingles(F.col("w")))
    few = passages.where(short)
    return long if few.isEmpty() else long.unionByName(_covered(few, docs, F.when(F.size(told) == 0, F.col("w")).otherwise(told), F.col("w")))


@query
def static_regions(spark, sf_dir):
    return _segmented(spark, sf_dir).select("page_id", "r.region_ord", "r.selector", "r.name", "r.text", "r.word_count", F.col("r.box.y").alias("y"), F.col("r.box.height").alias("height"), F.size("r.links").cast("long").alias("n_links"))


@query
def rendered_regions(spark, sf_dir):
    """Regions from a table of nodes with boxes, as a browser would capture it."""
    rows = segmentation.segmented(segmentation.source_nodes(table(spark, sf_dir, "pages"))).where("kind = 'region'")
    return rows.select("page_id", "region_ord", "selector", "name", "text", F.col("box.y").alias("y"), F.col("box.height").alias("height"), F.size("links").cast("long").alias("n_links"))


@query
def region_coverage(spark, sf_dir):
    return _regions(spark, sf_dir).select("scan_id", "region_ord", F.round("coverage", 9).alias("coverage"), F.round("found_in_scripts", 9).alias("found_in_scripts"))


@query
def classify(spark, sf_dir):
    return scoring.classified(_regions(spark, sf_dir)).select("scan_id", "region_ord", "issue_type", "status", "evidence")


@query
def classify_cases(spark, sf_dir):
    """Every row of the taxonomy's decision table, with probes."""
    rows = scoring.probe_outcomes_joined(fixtures.classifier_cases(spark), fixtures.probe_outcomes(spark))
    return scoring.classified(rows, F.col("probe_clears")).select("scan_id", "region_ord", "issue_type", "status", "evidence")


@query
def weights(spark, sf_dir):
    return _results(spark, sf_dir).select("scan_id", "region_ord", F.round(F.col("weight") + 1e-12, 9).alias("weight"))


@query
def issue_order(spark, sf_dir):
    return _results(spark, sf_dir).select("scan_id", "rank", "region_ord", "issue_type")


@query
def hidden_blocks(spark, sf_dir):
    """Each passage as a hidden block of the documents that have half of it: found where a document has nearly all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scan_id"), F.col("text").alias("raw_text"), F.lit("").alias("scripts"))
    pairs = passage_coverage(spark, sf_dir).where("coverage > 0.5").select(F.col("doc_id").alias("scan_id"), "item_id")
    blocks = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("#block-"), F.col("item_id").cast("string")).alias("selector"), "text")
    rows = scoring.with_haystacks(docs.join(pairs, "scan_id")).join(blocks, "item_id")
    return scoring.hidden_blocks(rows).select("scan_id", "selector", "name", F.round("coverage", 9).alias("coverage"), "word_count", "evidence")


@query
def verdict_counts(spark, sf_dir):
    return scoring.verdict_counts(_results(spark, sf_dir), "scan_id")


@query
def verdict_shares(spark, sf_dir):
    return scoring.verdict_shares(_results(spark, sf_dir), "scan_id")


@query
def region_labels(spark, sf_dir):
    return reporting.labelled(_results(spark, sf_dir)).select("scan_id", "region_ord", "verdict_label", "issue_label", "why", "how", "weight_percent")


@query
def map_placement(spark, sf_dir):
    rows = reporting.drawable(_results(spark, sf_dir), F.pmod(F.col("scan_id"), F.lit(3)) * 700)
    return rows.select("scan_id", "region_ord", "left_percent", "top_percent", "width_percent", "height_percent")


@query
def screenshot_placement(spark, sf_dir):
    rows = reporting.drawable(_results(spark, sf_dir), F.lit(1500), F.lit(1280))
    return rows.select("scan_id", "region_ord", "left_percent", "top_percent", "width_percent", "height_percent")


@query
def fix_prompts(spark, sf_dir):
    return _prompted(spark, sf_dir)[1].select("scan_id", "region_ord", "fix_prompt")


@query
def fix_plan(spark, sf_dir):
    docs = scan.scan_documents(*_prompted(spark, sf_dir))
    return docs.select("scan_id", reporting.fix_plan().alias("markdown"), reporting.attachment_name(F.col("url"), F.col("scanned_at"), F.col("scanned_at"), ".md").alias("file_name"))


@query
def html_report(spark, sf_dir):
    docs = scan.scan_documents(*_prompted(spark, sf_dir))
    return docs.select("scan_id", F.length(reporting.html_report()).cast("long").alias("n_chars"), F.md5(reporting.html_report()).alias("html_md5"))


def _captured(spark, sf_dir):
    """Tables of captured scans: the pages' raw responses; their regions with flags and routes by number; the first paragraph as a hidden block; probes."""
    heads = scan.raw_and_rendered(table(spark, sf_dir, "pages"))
    shown = segmentation.read_pages(heads.select("scan_id", "url", "html"), raw="html").select("scan_id", "url", F.explode("regions").alias("r")).select("scan_id", "url", "r.*")
    kind = F.pmod(F.col("scan_id") * 7 + F.col("region_ord"), F.lit(5))
    flags = F.struct(
        (kind == 0).alias("has_canvas"), (kind == 0).alias("canvas_dominant"), (kind == 1).alias("has_iframe"), (kind == 1).alias("iframe_dominant"), F.when(kind == 1, F.lit("https://maps.example.com/embed")).alias("iframe_src"),
        F.lit(False).alias("has_table"), F.when(kind == 2, F.lit(3)).otherwise(F.lit(0)).cast("long").alias("img_count"), F.when(kind == 2, F.lit(2)).otherwise(F.lit(0)).cast("long").alias("img_without_alt_count"), (kind == 2).alias("image_dominant"),
    )
    by_script = F.when((F.col("scan_id") % 6 == 0), F.lit("javascript:open")).otherwise(F.lit("#/start"))
    routes = F.transform("links", lambda link, i: F.struct(F.when(i == 0, by_script).otherwise(F.concat(F.lit("#"), link["href"])).alias("href"), F.lit(True).alias("is_client_route")))
    captures = shown.withColumns({"flags": flags, "links": F.when(F.col("scan_id") % 3 == 0, routes).otherwise(F.col("links"))})
    paragraph = F.concat(F.lit("<p>"), F.get(F.split(F.regexp_extract("html", scan.ARTICLE, 2), "<p>"), 1))
    hidden = heads.select("scan_id", F.lit(1).cast("long").alias("block_ord"), F.lit("#hidden").alias("selector"), T.raw_text(paragraph).alias("text"))
    first = F.get("links", F.lit(0))["href"]
    probes = captures.where(F.size("links") > 0).select("scan_id", urls.resolved(first, F.col("url")).alias("url"), F.lit(200).alias("status"))
    return heads.select("scan_id", "url", F.col("raw_html").alias("html")), captures, hidden, probes


@query
def captured_scan(spark, sf_dir):
    """Whole scans of captured tables: every class of the taxonomy can come up, and hidden blocks stand beside the regions."""
    rows = scan.scanned(*_captured(spark, sf_dir))
    return rows.select("scan_id", "region_ord", "selector", "issue_type", "status", "evidence", F.round(F.col("weight") + 1e-12, 9).alias("weight"), "rank")


@query
def probe_outcomes(spark, sf_dir):
    """What the first route of each region serves of its own."""
    heads, _, _, probes = _captured(spark, sf_dir)
    return scoring.probed(probes, heads)


def _responses(spark, sf_dir):
    """A crawler's and a browser's response for each page; every fifth crawler is refused, challenged, given half, or given another text."""
    rows = spread(table(spark, sf_dir, "pages"), EACH).select(F.col("page_id").alias("scan_id"), F.col("url").alias("requested_url"), "html")
    k = F.pmod(F.col("scan_id"), F.lit(5))
    challenge = F.lit("<html><body><h1>Just a moment...</h1><p>Checking your browser</p></body></html>")
    short = F.concat(F.lit("<html><body><p>"), F.substring(T.raw_text(F.col("html")), 1, 60), F.lit("</p></body></html>"))
    crawler = F.when(k == 1, F.lit("Forbidden")).when(k == 2, challenge).when(k == 3, short).otherwise(F.col("html"))
    status = F.when(k == 1, F.lit(403)).otherwise(F.lit(200))
    made = rows.select("scan_id", F.lit("crawler").alias("ua_role"), "requested_url", status.alias("status"), F.octet_length(crawler).cast("long").alias("bytes"), crawler.alias("html"))
    control = rows.select("scan_id", F.lit("control").alias("ua_role"), "requested_url", F.when(F.col("scan_id") % 11 == 10, F.lit(500)).otherwise(F.lit(200)).alias("status"), F.octet_length("html").cast("long").alias("bytes"), "html")
    return made.unionByName(control)


@query
def bot_block(spark, sf_dir):
    rows = responses.bot_blocks(responses.paired(_responses(spark, sf_dir)))
    prompt = F.when(F.col("blocked_reason").isNotNull(), responses.blocked_prompt(F.lit("GPTBot/1.0")))
    return rows.select("scan_id", "blocked_reason", "blocked_evidence", F.md5(prompt).alias("prompt_md5"), T.word_count(F.col("raw_text")).alias("analyzed_words"))


@query
def scan_telemetry(spark, sf_dir):
    """What is told of each scan's fetches and render."""
    rows = _responses(spark, sf_dir).withColumn("duration_ms", F.col("scan_id") * 7 % 1000)
    renders = table(spark, sf_dir, "pages").where("page_id % 4 != 3").select(F.col("page_id").alias("scan_id"), (F.col("page_id") * 31 % 5000).alias("render_duration_ms"), F.size(F.split("html", "<")).cast("long").alias("request_count"))
    return responses.telemetry(responses.paired(rows), renders).select("scan_id", "telemetry.*")


@query
def scan_errors(spark, sf_dir):
    """Errors of finished scans: those that the engine knows, and all others as one."""
    known = F.element_at(F.array(F.lit("timeout"), F.lit("dns_or_network"), F.lit("ssrf_blocked"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("scan_id"), responses.scan_error(known, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("e"))
    return rows.select("scan_id", "e.error_type", "e.error_message")


def _picked(id_col, *values):
    """One of the values, by the id."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(id_col) % len(values) + 1).cast("int"))


@query
def request_validation(spark, sf_dir):
    key = F.col("event_id").cast("string")
    url = F.element_at(F.array(F.lit(""), F.lit(" \n "), F.lit(None).cast("string"), F.concat(F.lit(" https://e.example/"), key, F.lit("\t")), F.repeat(F.lit("x"), F.lit(2049)), F.repeat(F.lit("y"), F.lit(2048))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), url.alias("url"), F.when(F.col("event_id") % 4 < 2, F.col("event_id") % 4 == 0).alias("force"))
    return admission.valid_requests(rows).select("req_id", F.length("url").cast("long").alias("n_chars"), F.md5("url").alias("url_md5"), "force")


@query
def client_addresses(spark, sf_dir):
    forwarded = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.concat(F.lit(" 10.0.0."), F.col("event_id").cast("string"), F.lit(" , 1.1.1.1")), F.lit("9.9.9.9")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", admission.requested_by(forwarded).alias("ip"))


@query
def allowed_requests(spark, sf_dir):
    """Requests of renders: media and hosts with an error are not let through."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.when(F.col("event_type") == "error", F.lit("media")).otherwise(F.lit("script")).alias("resource_type"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    verdicts = users.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.when(F.col("user_id") % 3 == 0, F.lit("ssrf_blocked")).alias("error_type"))
    return responses.allowed_requests(rows, verdicts).select("request_id", "allowed")


@query
def transport_errors(spark, sf_dir):
    """Error types of failed fetches and renders."""
    name = _picked("event_id", "TimeoutError", "AbortError", "TypeError")
    message = _picked("event_id", "Timeout 15000ms exceeded.", "net::ERR_NAME_NOT_RESOLVED at x", "net::ERR_CONNECTION_REFUSED", "net::ERR_INTERNET_DISCONNECTED", "Target closed")
    return table(spark, sf_dir, "events").select("event_id", responses.fetch_error(name).alias("fetch_error"), responses.render_error(message).alias("render_error"))


@query
def capped_bodies(spark, sf_dir):
    """Texts as bodies, read up to 1000 bytes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", responses.capped_body(F.encode("text", "UTF-8"), 1000).alias("b"))
    return rows.select("doc_id", "b.bytes", F.length("b.text").cast("long").alias("n_chars"), F.md5("b.text").alias("text_md5"))


@query
def blocked_scores(spark, sf_dir):
    """Scores of scans of which every third is blocked."""
    heads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("scan_id"), (F.col("page_id") % 3 == 0).alias("blocked"))
    return scoring.scores(_results(spark, sf_dir), heads)


@query
def phase_lines(spark, sf_dir):
    """What is told of each phase."""
    n = F.col("event_id")
    status = _picked("event_id", "queued", "fetching", "rendering", "diffing", "classifying", "done")
    facts = F.struct(F.concat(F.lit("u"), n.cast("string")).alias("url"), (n % 500).alias("status_code"), n.alias("bytes"), (n % 5 == 0).alias("blocked"), (n % 40).alias("request_count"), (n % 24).alias("region_count"))
    return table(spark, sf_dir, "events").select("event_id", events.phase_line(status, F.when(n % 7 != 0, facts)).alias("line"), events.phase_text(status, n % 3).alias("headline"))


@query
def kept_events(spark, sf_dir):
    """Logs of scans that go on, or ended less than some minutes ago."""
    log = events.numbered(_log(spark, sf_dir), "turn").withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("scan_id") * 10_000 + F.col("seq") * 1000))
    return events.kept_log(log, F.timestamp_millis(F.lit(1_700_000_700_000))).select("scan_id", "seq", "status")


@query
def skeleton_bars(spark, sf_dir):
    """The verdicts that tint the bars of a scan that isn't done."""
    known = F.slice(F.array(F.lit("ok"), F.lit("warn"), F.lit("bad")), F.lit(1), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: events.skeleton_verdict(known, i))).alias("bar", "verdict")).select("event_id", F.col("bar").cast("long").alias("bar"), "verdict")


@query
def status_documents(spark, sf_dir):
    """What clients that poll get, field by field."""
    n = F.col("event_id")
    status = _picked("event_id", "queued", "rendering", "done", "error")
    rows = table(spark, sf_dir, "events").select(
        n.alias("scan_id"), F.concat(F.lit("https://e.example/?a=\""), n.cast("string")).alias("input_url"), F.lit("https://e.example/").alias("normalized_url"), status.alias("status"), (n % 9).alias("queue_position"),
        F.when(n % 4 == 3, F.lit("timeout")).alias("error_type"), F.when(n % 4 == 3, F.lit("too late")).alias("error_message"), F.when(n % 4 == 2, n % 101).alias("score"), F.timestamp_millis(n * 1000 + 7).alias("created_at"), F.when(n % 4 > 1, F.timestamp_millis(n * 2000)).alias("finished_at"),
    )
    return rows.select("scan_id", events.status_json().alias("json"))


@query
def screenshot_sizes(spark, sf_dir):
    """Width and height of made JPEG headers, every fifth of which is cut."""
    h = lambda v, n: F.lpad(F.hex(v), n, "0")
    n = F.col("event_id")
    header = F.unhex(F.concat(F.lit("FFD8FFE00004ABCDFFC0001108"), h(n % 7000 + 1, 4), h(n % 1280 + 1, 4), F.lit("0311")))
    rows = table(spark, sf_dir, "events").select("event_id", jpeg_dimensions(F.when(n % 5 == 0, F.substring(header, 1, 9)).otherwise(header)).alias("d"))
    return rows.select("event_id", F.col("d.width").cast("long").alias("width"), F.col("d.height").cast("long").alias("height"))


@query
def stored_results(spark, sf_dir):
    """Which stored results can be read: verdicts must be known and no required field missing."""
    n = F.col("event_id")
    box = F.struct(*[F.lit(1).alias(x) for x in ("x", "y", "width", "height")])
    region = F.struct(F.lit("#a").alias("selector"), F.lit("A").alias("name"), _picked("event_id", "ok", "warn", "bad", "odd").alias("status"), F.lit("i").alias("issueType"), F.lit(1.0).alias("coverage"), F.lit("e").alias("evidence"), box.alias("boundingBox"), F.lit(1.0).alias("weight"), F.lit(3).alias("wordCount"))
    blob = F.to_json(F.struct(F.lit("u").alias("url"), F.lit("u").alias("finalUrl"), F.lit("t").alias("scannedAt"), F.when(n % 3 != 0, n).alias("score"), F.array(region).alias("regions"), F.lit("r").alias("rawText"), F.lit(1).alias("pageHeight"), F.lit(1).alias("viewportWidth"), n.alias("more")))
    return table(spark, sf_dir, "events").select("event_id", parsed_result(F.when(n % 11 != 0, blob).otherwise(F.lit("{"))).isNotNull().alias("readable"))


@query
def typed_errors(spark, sf_dir):
    rows = fixtures.responses(spark).withColumn("error_type", responses.typed_error())
    return rows.select("scan_id", "error_type", responses.error_message().alias("error_message"))


@query
def redirect_chains(spark, sf_dir):
    return responses.followed(fixtures.hops(spark))


@query
def ip_guard(spark, sf_dir):
    """Fixed addresses, and addresses made from the suppliers' keys."""
    made = table(spark, sf_dir, "supplier").select(F.concat_ws(".", F.pmod("s_suppkey", F.lit(256)), F.pmod(F.col("s_suppkey") * 7, F.lit(256)), F.lit(3), F.lit(4)).alias("address"))
    return fixtures.v4_addresses(spark).unionByName(made).distinct().select("address", net.is_private_v4(F.col("address")).alias("is_private"))


@query
def ip_guard_v6(spark, sf_dir):
    return fixtures.v6_addresses(spark).select("address", net.is_private(F.col("address"), F.lit(6)).alias("is_private"))


@query
def host_guard(spark, sf_dir):
    return responses.host_verdicts(fixtures.hosts(spark), fixtures.dns(spark))


@query
def fingerprint(spark, sf_dir):
    found = pages.fingerprint(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("f"))
    return rows.select("page_id", "f.stack", F.array_join("f.signals", "|").alias("signals"))


@query
def fingerprint_cases(spark, sf_dir):
    found = pages.fingerprint(F.col("html"))
    return fixtures.stacks(spark).select("html", found["stack"].alias("stack"), F.array_join(found["signals"], "|").alias("signals"))


@query
def page_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in pages.checks(F.col("html"), F.col("url")).items()])


@query
def robots_parse(spark, sf_dir):
    return robots.parsed_lines(fixtures.robots_files(spark))


@query
def robots_grid(spark, sf_dir):
    """Every page against one of the robots files, dealt by page."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("host"), F.pmod(F.col("page_id"), F.lit(4)).cast("string")).alias("host"), urls.pathname(F.col("url")).alias("path"))
    cells = robots.grid(rows, fixtures.robots_files(spark)).select("page_id", F.explode("robots_grid").alias("c"))
    return cells.select("page_id", "c.crawler", "c.allowed")


@query
def llms_check(spark, sf_dir):
    rows = fixtures.llms_files(spark).withColumn("c", pages.llms_check(responses.usable_text_file(F.col("status"), F.col("content_type"), F.col("body")), F.col("url")))
    return rows.select("scan_id", "c.present", "c.links_to_path")


def _scans(spark, sf_dir):
    """Events as finished scans: a user is a URL, an error event a failed scan."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scan_id"), F.col("user_id").cast("string").alias("normalized_url"), F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("done")).alias("status"),
        F.floor("value").cast("long").alias("score"), F.col("ts").cast("timestamp").alias("finished_at"),
    )


@query
def scan_history_delta(spark, sf_dir):
    return history.score_deltas(_scans(spark, sf_dir)).select("scan_id", "prev_scan_id", "prev_score", "score_delta")


@query
def dedupe_cached(spark, sf_dir):
    """Events of one kind ask for scans that events of the others finished."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("normalized_url"), F.col("ts").cast("timestamp").alias("ts"))
    asked = rows.where("event_id % 3 = 0").select(F.col("event_id").alias("req_id"), "normalized_url", "ts", (F.col("event_id") % 2 == 0).alias("force"))
    done = rows.where("event_id % 3 != 0").select(F.col("event_id").alias("scan_id"), "normalized_url", F.col("ts").alias("finished_at"))
    return history.cached_scans(asked, done)


@query
def recent_scans(spark, sf_dir):
    return history.recent_scans(_scans(spark, sf_dir)).select("scan_id", "normalized_url", "score")


def _halves(spark, sf_dir):
    """Parts as regions of two scans: pairs of scans by key, alternately before and after."""
    rows = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 16).cast("long").alias("pair_id"), F.col("p_partkey").alias("region_ord"), F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))).alias("selector"),
        F.concat_ws(" ", F.col("p_type"), F.element_at(F.split("p_name", " "), 1)).alias("name"), F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("bad")), (F.pmod("p_size", F.lit(3)) + 1).cast("int")).alias("status"),
    ).toDF("pair_id", "region_ord", "before", "selector", "name", "status").withColumn("issue_type", F.concat(F.lit("issue_"), F.col("status")))
    return rows.where("before").drop("before"), rows.where("not before").drop("before")


@query
def rescan_selector(spark, sf_dir):
    return history.selector_matches(*_halves(spark, sf_dir))


@query
def rescan_similarity(spark, sf_dir):
    """Likeness of the names of all pairs of regions with a common word."""
    return history.name_pairs(*_halves(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query
def rescan_changes(spark, sf_dir):
    return history.region_changes(*_halves(spark, sf_dir))


@query
def change_counts(spark, sf_dir):
    return history.change_counts(history.region_changes(*_halves(spark, sf_dir)), "pair_id")


def _log(spark, sf_dir):
    """Conversations as event logs of scans."""
    status = F.element_at(F.array(*[F.lit(s) for s in (*history.IN_FLIGHT, "done")]), F.least(F.col("turn") + 1, F.lit(6)).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scan_id"), "turn", status.alias("status"))


@query
def event_sequence(spark, sf_dir):
    return events.numbered(_log(spark, sf_dir), "turn")


@query
def event_replay(spark, sf_dir):
    log = events.numbered(_log(spark, sf_dir), "turn")
    clients = log.select("scan_id").distinct().select(F.col("scan_id").alias("client_id"), "scan_id", F.pmod("scan_id", F.lit(3)).alias("last_event_id"))
    return events.replayed(log, clients).select("client_id", "scan_id", "seq", "status")


@query
def scan_progress(spark, sf_dir):
    return events.latest_status(events.numbered(_log(spark, sf_dir), "turn"))


@query
def finished_events(spark, sf_dir):
    clients = _scans(spark, sf_dir).select(F.col("scan_id").alias("client_id"), "scan_id", F.pmod("scan_id", F.lit(4)).alias("last_event_id"))
    none = F.lit(None).cast("string")
    return events.finished_events(clients, _scans(spark, sf_dir).withColumns({"error_type": none, "error_message": none})).drop("error_type", "error_message")


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), F.col("event_type").alias("ip"), F.col("ts").cast("timestamp").alias("ts"))


@query
def rate_limit(spark, sf_dir):
    return admission.rate_limited(_requests(spark, sf_dir))


def _arrivals(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("scan_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ms"), (F.pmod("event_id", F.lit(50)) * 4000 + 1000).alias("duration_ms"))


@query
def queue_simulation(spark, sf_dir):
    return admission.queued(_arrivals(spark, sf_dir))


@query
def queue_positions(spark, sf_dir):
    state = F.when(F.col("event_id") % 100 < 2, F.lit("running")).when(F.col("event_id") % 100 < 50, F.lit("waiting")).otherwise(F.lit("done"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), state.alias("state"), F.col("ts").alias("enqueued_at"))
    return admission.queue_positions(rows).select("scan_id", "state", "position")


@query
def boot_sweep(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (*history.IN_FLIGHT, "done", "error")]), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), status.alias("status"), none.alias("error_type"), none.alias("error_message"), F.col("ts").cast("timestamp").alias("finished_at"))
    return history.swept(rows, F.timestamp_millis(F.lit(1_800_000_000_000))).select("scan_id", "status", "error_type", "error_message", F.unix_millis("finished_at").alias("finished_ms"))


@query
def blob_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", history.capped_text(F.col("text"), 2000).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query
def new_scans(spark, sf_dir):
    rows = fixtures.url_cases(spark).select(F.monotonically_increasing_id().alias("req_id"), F.col("input").alias("url"), F.lit(None).cast("timestamp").alias("ts"))
    return history.new_scans(rows).select("input_url", "normalized_url", "status", "error_type")


@query
def latest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    return history.latest_rows(rows)


@query
def time_ago(spark, sf_dir):
    now = F.timestamp_millis(F.lit(1_800_000_000_000))
    then = F.timestamp_millis(F.lit(1_800_000_000_000) - F.col("event_id") * 37_000)
    return table(spark, sf_dir, "events").select("event_id", history.time_ago(then, now).alias("told"), history.age_minutes(then, now).cast("long").alias("age_minutes"))


@query
def error_screens(spark, sf_dir):
    return fixtures.error_types(spark).select("error_type", reporting.error_copy(F.col("error_type")).alias("c")).select("error_type", "c.title", "c.what", "c.next")


@query
def parsed_pages(spark, sf_dir):
    """The parser's text, scripts and containers beside the fast reader's."""
    names = F.array(*[F.lit(s) for s in ("nav", "article", "footer", "#missing")])
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html"), EACH).select("page_id", trees.read_pages(F.col("html"), names).alias("r"))
    c = lambda i, field: F.get("r.containers", F.lit(i))[field]
    return rows.select("page_id", F.col("r.raw_text").alias("raw_text"), F.col("r.scripts").alias("scripts"), c(1, "present").alias("has_article"), c(3, "present").alias("has_missing"), c(1, "words").alias("article_words"))


@query
def node_table(spark, sf_dir):
    rows = trees.node_table(spread(table(spark, sf_dir, "pages"), EACH))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("nth_of_type").alias("most"))


@query
def stream_event_log(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    return streams.completed(streams.event_log(rows, forget=False), "event-log")


@query
def event_frames(spark, sf_dir):
    log = events.numbered(_log(spark, sf_dir), "turn")
    clients = log.select("scan_id").distinct().select(F.col("scan_id").alias("client_id"), "scan_id", F.pmod("scan_id", F.lit(3)).alias("last_event_id"))
    return events.frames(log.select("scan_id", "seq", "status"), clients)


@query
def stream_frames(spark, sf_dir):
    """Events of a stream, numbered by their turn, written to each client once."""
    log = streams.table_stream(spark, sf_dir, "conversations")
    status = F.when(F.col("turn") >= 5, F.lit("done")).otherwise(F.lit("fetching"))
    rows = log.select(F.col("conv_id").alias("scan_id"), (F.col("turn") + 1).cast("long").alias("seq"), status.alias("status"))
    clients = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("client_id"), F.col("conv_id").alias("scan_id"), F.pmod("conv_id", F.lit(3)).cast("long").alias("last_event_id"))
    with stateful.rocks(spark):
        return delivery.drained(stateful.delivered(rows, clients), new_path(spark, "frames")).select("client_id", "scan_id", "seq", "frame")


@query
def stream_reuse(spark, sf_dir):
    """Requests of a stream with the scans that they may reuse."""
    asked = streams.table_stream(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("req_id"), F.col("user_id").cast("string").alias("normalized_url"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2 == 0).alias("force"))
    done = table(spark, sf_dir, "events").where("event_id % 3 != 0").select(F.col("event_id").alias("scan_id"), F.col("user_id").cast("string").alias("normalized_url"), F.col("ts").cast("timestamp").alias("finished_at"))
    return streams.delivered(asked, lambda out: streams.reuse(done, out), "reuse").select("req_id", "normalized_url", "cached_scan_id", "age_seconds")


@query
def stream_rate_limit(spark, sf_dir):
    rows = stateful.in_order(_requests(spark, sf_dir), "ts", 1, "requests", stateful.MOST_ROWS)
    return streams.completed(streams.rate_limited(rows, forget=False), "rate-limit")


@query
def stream_queue(spark, sf_dir):
    rows = stateful.in_order(_arrivals(spark, sf_dir).withColumn("at", F.timestamp_millis("arrival_ms")), "at", 1, "scans", stateful.MOST_ROWS)
    return streams.completed(streams.queued(rows), "queue")
