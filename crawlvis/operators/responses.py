"""Crawler and control responses: blocks, typed errors, auxiliary files, address checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions import net, urls
from crawlvis.functions import text as T
from crawlvis.functions import wording as W
from crawlvis.functions.fence import fenced
from crawlvis.functions.hosts import canonical
from crawlvis.functions.template import chosen, filled

# What tells that a crawler is blocked.
BLOCKING = (401, 403, 429)
CHALLENGE = r"(?i)just a moment|checking your browser|verify you are human|cf-chl|cf_chl|challenge-platform|attention required|ddos protection|h?captcha|enable javascript and cookies to continue"
CHALLENGE_WORDS, SIMILAR, CONTROL_WORDS = 300, 0.4, 50
# What tells of a login.
LOGIN_PATH = r"(?i)/(log[-_]?in|sign[-_]?in|auth(?:enticate|orize)?|sso)(/|$|\?)"
PASSWORD, PASSWORD_WORDS = r"(?i)<input[^>]+type=[\"']?password", 80
LOOKS_HTML = r"(?i)^\s*(<!doctype html|<html|<head|<body)"
# Limits of fetching.
MAX_BODY_BYTES, MAX_REDIRECTS, REDIRECTS = 3_000_000, 5, (301, 302, 303, 307, 308)
FETCH_MS, AUX_MS = 15_000, 10_000


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def containment(control: Column, crawler: Column, control_shingles: Column, crawler_shingles: Column) -> Column:
    """The share of the control's text that the crawler's has: by shingle, or by word if either is short."""
    by_word = F.when(F.size(control) == 0, F.lit(1.0)).otherwise(T.fraction(T.matched(control, crawler), F.size(control)))
    by_shingle = F.when(F.size(control_shingles) == 0, F.lit(1.0)).otherwise(T.fraction(T.matched(control_shingles, crawler_shingles), F.size(control_shingles)))
    return F.when((F.size(control) < T.SHORT_TOKENS) | (F.size(crawler) < T.SHORT_TOKENS), by_word).otherwise(by_shingle)


def paired(responses: DataFrame) -> DataFrame:
    """One row per scan: the crawler's response, and the control's in columns that begin with control_; null where there is none.

    responses: scan_id, ua_role (crawler or control) and the columns of a fetch. One aggregation, no self-join.
    """
    columns = [c for c in responses.columns if c not in ("scan_id", "ua_role")]
    row = F.struct(*columns)
    pick = lambda role: F.max(F.when(F.col("ua_role") == role, row)).alias(role)
    pairs = responses.groupBy("scan_id").agg(pick("crawler"), pick("control")).where("crawler is not null")
    return pairs.select("scan_id", *[F.col("crawler")[c].alias(c) for c in columns], *[F.col("control")[c].alias(f"control_{c}") for c in columns])


def bot_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs with blocked_reason (status, challenge, divergence or null), blocked_evidence, and raw_html and raw_text of the view that is analyzed.

    A control that failed tells nothing, so no block is claimed. The control's page is analyzed where the crawler is blocked.
    """
    read = fenced(pairs, {"_text": T.raw_text(F.col("html")), "_control_text": T.raw_text(F.col("control_html"))})
    read = fenced(read, {"_words": T.tokens(F.col("_text")), "_control_words": T.tokens(F.col("_control_text"))})
    read = fenced(read, {"_shingles": T.shingles(F.col("_words")), "_control_shingles": T.shingles(F.col("_control_words"))})
    read = fenced(read, {"_containment": F.when(is_success(F.col("status")) & (F.size("_control_words") >= CONTROL_WORDS), containment(F.col("_control_words"), F.col("_words"), F.col("_control_shingles"), F.col("_shingles")))}, drop=("_shingles", "_control_shingles"))
    marked = lambda c: F.coalesce(F.rlike(c, F.lit(CHALLENGE)), F.lit(False))
    reason = (
        F.when(~F.coalesce(is_success(F.col("control_status")), F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("status").isin(*BLOCKING), F.lit("status"))
        .when(marked(F.col("html")) & ~marked(F.col("control_html")) & (F.size("_words") <= CHALLENGE_WORDS), F.lit("challenge"))
        .when(F.col("_containment") < SIMILAR, F.lit("divergence"))
    )
    values = {
        "status": F.col("status"), "bytes": F.col("bytes"), "control_status": F.col("control_status"), "control_bytes": F.col("control_bytes"),
        "words": F.size("_words"), "control_words": F.size("_control_words"), "containment": F.floor(F.col("_containment") * 100 + 0.5),
    }
    told = fenced(read, {"blocked_reason": reason})
    told = told.withColumn("blocked_evidence", chosen({k: filled(t, **values) for k, t in W.BLOCKED_EVIDENCE.items()}, F.col("blocked_reason")))
    blocked = F.col("blocked_reason").isNotNull()
    return told.withColumns({"raw_html": F.when(blocked, F.col("control_html")).otherwise(F.col("html")), "raw_text": F.when(blocked, F.col("_control_text")).otherwise(F.col("_text"))}).drop("_text", "_control_text", "_words", "_control_words", "_containment")


def blocked_prompt(agent: Column) -> Column:
    """The fix prompt of a blocked page."""
    c = F.col
    return filled(W.BLOCKED_PROMPT, url=c("requested_url"), agent=agent, status=c("status"), bytes=c("bytes"), control_status=c("control_status"), control_bytes=c("control_bytes"), evidence=c("blocked_evidence"))


def typed_error() -> Column:
    """unsupported_content_type, login_redirect or null for a response that isn't blocked. Content type goes first."""
    kind, html = F.lower(F.coalesce("content_type", F.lit(""))), F.coalesce("html", F.lit(""))
    is_pdf = F.startswith(html, F.lit("%PDF-"))
    is_html = (F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml"))) & ~is_pdf
    undeclared = (kind == "") & F.rlike(html, F.lit(LOOKS_HTML))
    path = F.when(F.rlike("final_url", F.lit(urls.PARTS)), urls.pathname(F.col("final_url")))
    landed = (F.size(F.coalesce("redirects", F.array().cast("array<string>"))) > 0) & F.rlike(path, F.lit(LOGIN_PATH))
    asks = F.rlike(html, F.lit(PASSWORD)) & (F.size(T.tokens(T.raw_text(html))) < PASSWORD_WORDS)
    return F.when(~(is_html | undeclared), F.lit("unsupported_content_type")).when(path.isNotNull() & (landed | asks), F.lit("login_redirect"))


def content_label() -> Column:
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    first = F.substring_index(kind, ";", 1)
    return F.when(F.startswith(F.coalesce("html", F.lit("")), F.lit("%PDF-")), F.lit("application/pdf")).when(first == "", F.lit("unknown")).otherwise(first)


def error_message() -> Column:
    """The message of the row's error_type, as far as the response tells it."""
    path = urls.pathname(F.col("final_url"))
    return F.when(F.col("error_type") == "unsupported_content_type", F.concat(F.lit("This URL serves "), content_label(), F.lit(", not an HTML page."))).when(
        F.col("error_type") == "login_redirect", F.concat(F.lit("This page requires signing in — the crawler was sent to "), path, F.lit("."))
    )


def fetch_error(name: Column) -> Column:
    """The error type of a failure's class name."""
    return F.when(name.isin("TimeoutError", "AbortError"), F.lit("timeout")).otherwise(F.lit("dns_or_network"))


def render_error(message: Column) -> Column:
    """The error type of a failed render, by its message."""
    return (
        F.when(F.rlike(message, F.lit(r"(?i)timeout.*exceeded")), F.lit("timeout"))
        .when(F.rlike(message, F.lit(r"(?i)ERR_NAME_NOT_RESOLVED|ERR_CONNECTION|ERR_INTERNET")), F.lit("dns_or_network"))
        .otherwise(F.lit("render_failed"))
    )


def scan_error(error_type: Column, message: Column) -> Column:
    """struct<error_type, error_message> of a failed scan: the engine's own error, or the general one for any other failure (a null type)."""
    own = error_type.isNotNull()
    return F.struct(F.when(own, error_type).otherwise(F.lit(W.UNEXPECTED[0])).alias("error_type"), F.when(own, message).otherwise(F.lit(W.UNEXPECTED[1])).alias("error_message"))


def telemetry(pairs: DataFrame, renders: DataFrame) -> DataFrame:
    """scan_id and the struct ``telemetry`` of paired responses and of renders (scan_id, render_duration_ms, request_count).

    A scan without a control has nulls there; one that wasn't rendered has nulls for its render.
    """
    found = pairs.join(renders.select("scan_id", "render_duration_ms", "request_count"), "scan_id", "left")
    fields = {
        "crawler_status": "status", "crawler_bytes": "bytes", "control_status": "control_status", "control_bytes": "control_bytes",
        "fetch_duration_ms": "duration_ms", "render_duration_ms": "render_duration_ms", "request_count": "request_count",
    }
    return found.select("scan_id", F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("telemetry"))


def capped_body(body: Column, cap: int | None = None) -> Column:
    """struct<text, bytes> of a binary body, read up to the cap in bytes.

    Bytes that aren't UTF-8 become U+FFFD; a character that the cap cuts off is left out.
    """
    cap = MAX_BODY_BYTES if cap is None else cap
    kept = F.substring(body, 1, cap)
    tail = F.hex(F.substring(kept, F.greatest(F.octet_length(kept) - 2, F.lit(1)), F.lit(3)))
    more = lambda pattern: F.rlike(tail, F.lit(pattern))
    cut = F.when(more("(C[2-9A-F]|D.|E.|F[0-4])$"), 1).when(more("(E.|F[0-4])[89AB].$"), 2).when(more("F[0-4]([89AB].){2}$"), 3).otherwise(0)
    whole = F.when(F.octet_length(body) > cap, F.substring(kept, F.lit(1), F.octet_length(kept) - cut)).otherwise(kept)
    return F.struct(F.make_valid_utf8(whole.cast("string")).alias("text"), F.octet_length(kept).cast("long").alias("bytes"))


def usable_text_file(status: Column, content_type: Column, body: Column) -> Column:
    """The body of robots.txt or llms.txt; null unless it was served, and as something other than HTML."""
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")) | F.rlike(body, F.lit(LOOKS_HTML))
    return F.when((status == 200) & ~html, body)


def followed(hops: DataFrame) -> DataFrame:
    """Redirect chains, from hops (scan_id, hop from 0, url, status, location, private, elapsed_ms), as final_url, n_redirects and error_type.

    A hop to another scheme than http(s) or to a private address blocks the chain, more than the allowed hops fail it, and
    all hops share one budget of time. What goes wrong first counts.
    """
    moves = F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull()
    wrong = (
        F.when(~F.rlike("url", F.lit("(?i)^https?://")) | F.col("private"), F.lit("ssrf_blocked"))
        .when(F.col("elapsed_ms") > FETCH_MS, F.lit("timeout"))
        .when(moves & (F.col("hop") >= MAX_REDIRECTS), F.lit("dns_or_network"))
    )
    rows = hops.select("scan_id", "hop", "url", wrong.alias("wrong"))
    last = F.max_by("url", "hop")
    return rows.groupBy("scan_id").agg(last.alias("final_url"), F.max("hop").cast("long").alias("n_redirects"), F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("hop"))).alias("error_type"))


def host_verdicts(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """host, error_type: dns_or_network where a name has no address or can't be one, ssrf_blocked where any is private or the name is local, else null.

    hosts: host. dns: host, address, family. Literal addresses, in whatever spelling, are judged as they are.
    """
    known = dns.groupBy(canonical(F.col("host")).alias("_host")).agg(F.bool_or(net.is_private(F.col("address"), F.col("family"))).alias("_private"))
    rows = fenced(hosts, {"_host": canonical(F.col("host"))}).join(known, "_host", "left")
    literal = F.startswith("_host", F.lit("[")) | F.rlike("_host", F.lit(net.DOTTED))
    local = F.rlike("_host", F.lit(r"^(.*\.)?localhost$"))
    own = net.is_private(F.regexp_replace("_host", r"^\[|\]$", ""), F.lit(4))
    lost = F.lit("dns_or_network")
    error = F.when(F.col("_host").isNull(), lost).when(literal, F.when(own, F.lit("ssrf_blocked"))).when(local, F.lit("ssrf_blocked")).when(F.col("_private").isNull(), lost).when(F.col("_private"), F.lit("ssrf_blocked"))
    return rows.select("host", error.alias("error_type"))


def allowed_requests(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Requests of a render with allowed: not a medium, and to a host without an error. requests: host, resource_type, …"""
    return requests.join(verdicts, "host", "left").withColumn("allowed", (F.col("resource_type") != "media") & F.col("error_type").isNull()).drop("error_type")
