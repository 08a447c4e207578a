"""Personal data, and the terms that give it away, in DataFrame functions only.

Addresses, numbers and cards are found by their form. What else reveals them is told by the corpus: a term that
hardly occurs but beside one protected value tells nearly as much as the value itself. With an occurrence of a word drawn at
random, let c be that it stands within ``NEAR`` characters of the value, and t that it is the term. The value's information is
IC(c) = -log2 p(c), and the term discloses PMI(c; t) = log2 p(c | t) / p(c) of it. A term whose disclosure comes within
``SLACK`` bits of the whole, in ``SUPPORT`` different texts at least, is generalised to the longest of its prefixes that no
longer does, or removed if none is left. That bound is p(c | t) >= 2 ** -SLACK, so it needs no logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.functions.arrays import running_sums
from crawlvis.functions.fence import let
from crawlvis.llm.quality import fenced
from crawlvis.llm.store import written

KINDS = ("email", "ip", "card", "phone")
# The forms, written so that each match is found without going back: a match can only begin where a run of its characters
# does, or where the match before it ended. They match what the plain forms match from left to right.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}\p{M}]+"
APART = r"[^\p{L}\p{M}]+"
#: Characters beside a value that count as near, the least length of a term, different texts that must agree, and bits. Without
#: slack a term must tell all that the value does, so none of its occurrences is in a text that hasn't got the value.
NEAR, LEAST, SUPPORT, SLACK = 64, 4, 3, 0
#: Lengths of prefixes that a term may be generalised to, longest first.
PREFIXES = (6, 4, 2)
#: Buckets of hashes that are handed to every task, to pass over what can't match: at most so many numbers, whatever the input.
BUCKETS = 1 << 20
CHUNK = 1024


SPANS = "array<struct<start:long,end:long,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points, end exclusive."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
        ends = running_sums(steps)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPANS)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum: every second one from the right doubled, and their digits added."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def protected(text: Column) -> dict[str, Column]:
    """The spans of each kind. Null text has none."""
    none = F.array().cast(SPANS)
    has = lambda c, spans: F.when(F.contains(text, F.lit(c)), spans).otherwise(none)
    n = lambda s: F.length(digits(s["value"]))
    return {
        "email": has("@", matches(text, EMAIL)),
        "ip": has(".", F.filter(matches(text, IP), lambda s: F.rlike(s["value"], F.lit(rf"^{PART}(?:\.{PART}){{3}}$")))),
        "card": F.filter(matches(text, CARD), lambda s: luhn(digits(s["value"]))),
        "phone": has("+", F.filter(matches(text, PHONE), lambda s: n(s).between(8, 15))),
    }


def blanked(text: Column) -> Column:
    """The text with blanks for its addresses of mail, which alone of the kinds have letters; places stay."""

    def joined(found: Column) -> Column:
        ends = F.concat(F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, EMAIL), ends, lambda a, b: F.concat(a, b)), "")

    return F.when(F.contains(text, F.lit("@")), let(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), joined)).otherwise(text)


def terms(text: Column) -> Column:
    """The words of a blanked text, in lower case, that are long enough to tell something."""
    return F.filter(F.split(F.lower(text), APART), lambda w: F.length(w) >= LEAST)


def nearby(chunks: Column, span: Column) -> Column:
    """array<struct<start, value>> of the words that lie as a whole within ``NEAR`` characters of a span. chunks: the blanked text, cut every ``CHUNK`` characters."""

    def cut(start: Column, length: Column) -> Column:
        at = F.floor(start / CHUNK).cast("int")
        two = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
        return F.substring(two, (start - at * CHUNK + 1).cast("int"), length.cast("int"))

    def words(text: Column, start: Column) -> Column:
        kept = F.filter(matches(text, WORD), lambda w: F.length(w["value"]) >= LEAST)
        return F.transform(kept, lambda w: F.struct((w["start"] + start).alias("start"), F.lower(w["value"]).alias("value")))

    first = F.greatest(span["start"] - NEAR - 1, F.lit(0))
    # One character more on either side tells a word that is cut; what it begins or ends is left out.
    headless = lambda x: let(F.length(F.regexp_extract(x, rf"^{WORD}", 0)), lambda n: F.concat(F.repeat(F.lit(" "), n), F.substring(x, n + 1, F.lit(NEAR + 1))))
    left = let(cut(first, span["start"] - first), lambda x: F.when(span["start"] > NEAR, headless(x)).otherwise(x))
    right = let(cut(span["end"], F.lit(NEAR + 1)), lambda x: F.when(F.length(x) > NEAR, F.regexp_replace(x, rf"{WORD}\z", "")).otherwise(x))
    return F.concat(let(left, lambda x: words(x, first)), let(right, lambda x: words(x, span["end"])))


def forms(term: Column) -> Column:
    """A term, and its shorter prefixes with a star, longest first."""
    return F.concat(F.array(term), F.array_compact(F.array(*[F.when(F.length(term) > n, F.concat(F.substring(term, 1, n), F.lit("*"))) for n in PREFIXES])))


def _entities(kind: str):
    """Spans with a number for kind and value, the same wherever the value stands."""
    return lambda s: F.struct(F.xxhash64(F.lit(kind), s["value"]).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))


def book(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, spans by kind, and ``near``: the words beside each value, once for each place, as strings of value, place and word, which are told apart by hashing. Written, so the texts are scanned once for it."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = fenced(base, ["doc_id", "t"], digest=F.unhex(F.sha2("t", 256)), **protected(F.col("t")))
    every = F.concat(*[F.transform(k, _entities(k)) for k in KINDS])
    cut = fenced(found, ["doc_id", "digest", *KINDS], every=every, chunks=F.when(F.size(every) > 0, F.regexp_extract_all(blanked(F.col("t")), F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    told = lambda s, w: F.concat_ws(" ", s["entity"].cast("string"), w["start"].cast("string"), w["value"])
    beside = F.flatten(F.transform("every", lambda s: F.transform(nearby(F.col("chunks"), s), lambda w: told(s, w))))
    return written(cut.select("doc_id", "digest", *KINDS, F.array_distinct(beside).alias("near")), "personal")


def occurrences(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """term, n of every word of the corpus."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.explode(terms(blanked(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def disclosing(pages: DataFrame, counts: DataFrame, *, support: int = SUPPORT, slack: float = SLACK) -> DataFrame:
    """term, replacement of the terms that give a protected value away: a prefix and a star, or nothing.

    pages: from ``book``. counts: from ``occurrences``. A value or text that repeats without end is counted by text first, so no task
    holds its rows.
    """
    words = pages.select("digest", F.explode("near").alias("w")).withColumn("w", F.split("w", " "))
    near = words.select("digest", F.get("w", F.lit(0)).alias("entity"), F.explode(forms(F.get("w", F.lit(2)))).alias("form"))
    by_text = near.groupBy("entity", "form", "digest").agg(F.count("*").alias("n"))
    pairs = by_text.groupBy("entity", "form").agg(F.sum("n").alias("n_near"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    most = pairs.groupBy("form").agg(F.max("n_near").alias("n_near"))  # the value that it tells most of
    every = counts.select("n", F.explode(forms(F.col("term"))).alias("form"))
    total = _among(every, most, "form").groupBy("form").agg(F.sum("n").alias("n"))
    told = written(most.join(total, "form").where(F.col("n_near") >= F.col("n") * F.lit(2.0**-slack)).select("form"), "told")
    whole = told.where(~F.endswith(F.col("form"), F.lit("*"))).withColumnRenamed("form", "term")
    ways = whole.select("term", F.posexplode(F.slice(forms(F.col("term")), F.lit(2), F.lit(len(PREFIXES)))).alias("at", "form"))
    safe = ways.join(told, "form", "left_anti").groupBy("term").agg(F.min_by("form", "at").alias("replacement"))
    return whole.join(safe, "term", "left").select("term", F.coalesce("replacement", F.lit("")).alias("replacement"))


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def _among(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` may be among those of ``wanted``: told by buckets of hashes, of which there are at most ``BUCKETS``."""
    buckets = wanted.select(_bucket(*columns).alias("bucket")).distinct()
    return rows.join(F.broadcast(buckets), _bucket(*columns) == F.col("bucket"), "left_semi")


def term_spans(docs: DataFrame, told: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, terms (array<struct<start, end, replacement>>) of the documents that have disclosing terms, once for each id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.unhex(F.sha2(text, 256)).alias("digest"))
    words = rows.select("doc_id", "digest", F.explode(F.array_distinct(terms(blanked(F.col("t"))))).alias("term"))
    hits = _among(words, told, "term").join(told, "term").groupBy("doc_id", "digest").agg(F.map_from_entries(F.collect_set(F.struct("term", "replacement"))).alias("found"))
    hits = written(hits, "term-hits")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
    whole = _among(rows, hits, "doc_id", "digest").join(hits.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "found"), same)
    at = F.filter(let(blanked(F.col("t")), lambda x: matches(x, WORD)), lambda w: F.map_contains_key(F.col("found"), F.lower(w["value"])))
    spans = F.transform(at, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at(F.col("found"), F.lower(w["value"])).alias("replacement")))
    return whole.select("doc_id", "digest", spans.alias("terms")).groupBy("doc_id", "digest").agg(F.any_value("terms").alias("terms"))


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, the spans of each kind, and ``terms``, the spans of what discloses them, for every row.

    A null or empty text has no spans; rows that repeat are told again; a null id stays null; an empty table gives an empty result;
    other columns are ignored, whatever their names. A text of any length is scanned in linear time.
    """
    pages = book(docs, id_col=id_col, text_col=text_col)
    told = written(disclosing(pages, occurrences(docs, text_col=text_col)), "disclosing")
    spans = term_spans(docs, told, id_col=id_col, text_col=text_col)
    spans = spans.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "terms")
    rows = pages.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    return rows.select("doc_id", "digest", *KINDS, F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,replacement:string>>")).alias("terms"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans, kind by kind, joined by commas."""
    name = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k.removesuffix("s")), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[name(k) for k in kinds]), ",")


def sanitised(text: Column, found: Column) -> Column:
    """The text with names of their kinds for protected values, and what ``found``, a map from terms to replacements, has for terms."""

    def replaced(x: Column, pattern: str, new, between=None) -> Column:
        parts, values = F.split(x, pattern), F.concat(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), new), F.array(F.lit("")))
        return F.array_join(F.zip_with(parts if between is None else F.transform(parts, between), values, lambda a, b: F.concat(a, b)), "")

    told = lambda w: F.coalesce(F.try_element_at(found, F.lower(w)), w)
    x = replaced(text, EMAIL, lambda m: F.lit("[EMAIL]"), lambda p: replaced(p, WORD, told))
    x = replaced(x, IP, lambda m: F.when(F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")), F.lit("[IP]")).otherwise(m))
    x = replaced(x, CARD, lambda m: F.when(luhn(digits(m)), F.lit("[CARD]")).otherwise(m))
    return replaced(x, PHONE, lambda m: F.when(F.length(digits(m)).between(8, 15), F.lit("[PHONE]")).otherwise(m))


def spans_and_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    rows = scanned(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))
