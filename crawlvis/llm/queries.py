"""The queries of this subpackage's operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.llm import attribution, audit, codec, disclosure, extraction, language, licenses, manifest, near_duplicates, oracles, packing, quality, topk, warc
from crawlvis.llm.store import spread, written

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one, which is a row group or two, dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), 64)
    return topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), 2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.judged(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op4_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version of the policy rejects, alone and beside others, from the bits of one ledger."""
    book = written(quality.ledger(table(spark, sf_dir, "documents")).select("failures"), "ledger")
    parts = [quality.ablations(book, version).withColumn("version", F.lit(version)) for version in quality.POLICIES]
    return reduce(DataFrame.unionByName, parts)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), frequent=20_000)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.members(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.tamper_test(table(spark, sf_dir, "documents"), third, lowered)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.spans_and_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_html_extraction": op6_html_extraction,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scan": op9_license_scan,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_personal_data": op13_personal_data,
    "op4_rule_ablations": op4_rule_ablations,
}


def licenses_sql() -> str:
    """The license scan without filters: every window against every template, every phrase at every word."""
    least, templates = licenses.THRESHOLD, licenses.templates_of()
    strings = lambda tokens: f"CAST([{', '.join(map(repr, tokens))}] AS VARCHAR[])"
    rows = ", ".join(
        f"({t.number}, '{t.label}', {t.size}, {strings(t.tokens)}, {t.least(least)}, CAST([{', '.join(strings(x) for x in licenses.telling(t, templates, least))}] AS VARCHAR[][]), CAST([{', '.join(str(u.number) for u in licenses.fuller(t, templates, least))}] AS INTEGER[]))"
        for t in templates
    )
    sizes = ", ".join(f"({n})" for n in licenses.sizes_of(templates))
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in licenses.PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(number, label, size, tokens, least, telling, fuller) AS (VALUES {rows}), z(size) AS (VALUES {sizes}), p(words, label) AS (VALUES {phrases}),
w AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS place FROM w, p
      WHERE len(w) >= len(words) AND list_has_all(w, words)),
c AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS names FROM b GROUP BY doc_id),
g AS (SELECT doc_id, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w WHERE len(w) > 2),
l AS (SELECT doc_id, size, unnest(list_transform(range(1, 1 + greatest(len(w) - size, 1), size), lambda i: g[i:i + 2 * size - 3])) AS g, unnest(range(1, 1 + greatest(len(w) - size, 1), size)) AS place FROM g, z),
m AS (SELECT doc_id, place, l.size, number, label, fuller, len(list_intersect(tokens, g)) / len(tokens) AS share FROM l JOIN t USING (size)
      WHERE list_has_any(tokens, g) AND len(list_intersect(tokens, g)) >= least AND len(list_filter(telling, lambda x: 2 * len(list_intersect(x, g)) < len(x))) = 0),
k AS (SELECT doc_id, place, size, list(number) AS numbers FROM m GROUP BY ALL),
f AS (SELECT doc_id, list_distinct(list(label)) AS found, max(share) AS most FROM m JOIN k USING (doc_id, place, size) WHERE NOT list_has_any(fuller, numbers) AND label <> '' GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(names, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE CAST(coalesce(most, 0) AS DOUBLE) END AS score
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""


OP1_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
),
m AS (
  SELECT doc_id, t, w, len(w) AS n, l,
    CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM w
),
e AS (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS p FROM m),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e) WHERE c > 1),
k AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
f AS (
  SELECT m.doc_id, n AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR (n_words > 0 AND 5 * n_symbols > n_words) OR 10 * n_dup_lines > 3 * n_lines
    OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words))) AS kept,
  CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 0 AND n_symbols >= 2 * n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words))::INT + 32 * (n_words > 0 AND 5 * n_symbols > n_words)::INT AS BIGINT) AS failures
FROM f
"""

_rules = ", ".join(f"({v}, '{r.name}', {1 << r.bit}, {quality.mask(v)})" for v in quality.POLICIES for r in quality.RULES if r.name in quality.POLICIES[v])
ABLATIONS_SQL = f"""WITH b AS ({OP4_SQL}), r(version, rule, bit, mask) AS (VALUES {_rules})
SELECT version, rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & mask = bit) AS n_only FROM r, b GROUP BY ALL"""

ORACLE_SQL: dict[str, str] = {"op4_rule_ablations": ABLATIONS_SQL, "op1_top_k": OP1_SQL, "op4_quality_rules": OP4_SQL, "op9_license_scan": licenses_sql(), "op10_warc_round_trip": OP10_SQL, "op11_filter_audit": oracles.OP11_SQL, "op12_merkle_manifest": oracles.manifest_sql(), "op13_personal_data": oracles.personal_sql(disclosure.NEAR, disclosure.LEAST, disclosure.SUPPORT, disclosure.SLACK, disclosure.PREFIXES)}
