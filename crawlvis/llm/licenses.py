"""License scans by an exact set-similarity join of text blocks with license texts, in DataFrame functions only.

Templates are notices of a sentence and whole license texts. Their tokens are the three words in a row that they hold, so
that the order of words counts. A block is a window of a text's words, whatever its lines; windows are twice as long as the
templates of their size and overlap by half, so whatever is no longer than that lies in one window as a whole. A block
matches a template if it holds at least a threshold of the template's tokens.

A text none of whose templates can be there is passed over: it must have one of the tokens that no match can do without.
Tokens are ordered by how many blocks of the whole corpus have them, rarest first. A matching block must have a token of the
template's prefix (prefix filter), enough tokens (length filter), and enough tokens left where the first shared one stands in
either order (positional filter); pairs that pass are verified. Templates that differ by less than the threshold lets pass
are told apart: a block must have half of the tokens that do so, and a template contained in another that the block matches gives
way to it. Beside it, phrases are found where their words stand in a row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.license_texts import NOTICES, TEXTS
from crawlvis.llm.quality import fenced, three_in_a_row
from crawlvis.llm.store import written

# Phrases that name a license, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
THRESHOLD = 0.9
#: Characters between words, and between words of a text whose capitals still stand.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a token; and sizes of templates in words, each of which has windows of its own. Longer templates have sizes of their own, which double.
TOKEN, SIZES = 3, (16, 64, 512)
#: The label of templates that name no license, and only take from others what reads like them.
NONE = ""
#: What a text may have more of than its template, and still lies in one window for sure.
ROOM = 1.25


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[str, ...]  # distinct, in order
    size: int

    def least(self, threshold: float) -> int:
        """Tokens that a block must share."""
        return max(1, math.ceil(threshold * len(self.tokens) - 1e-9))


def size_of(words: int) -> int:
    """The size of a template of so many words: the least that leaves it some room, doubled from the largest on as often as it takes."""
    for size in SIZES:
        if size >= ROOM * words:
            return size
    while size < ROOM * words:
        size *= 2
    return size


def sizes_of(templates: list[Template]) -> list[int]:
    return sorted({t.size for t in templates})


def templates_of(texts=NOTICES + TEXTS) -> list[Template]:
    """Templates of texts, of three words at least, and their labels."""
    out = []
    for i, (text, label) in enumerate(texts):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if len(words) < TOKEN:
            raise ValueError(f"a template must have {TOKEN} words")
        out.append(Template(i, label, tuple(dict.fromkeys(" ".join(words[k : k + TOKEN]) for k in range(len(words) - TOKEN + 1))), size_of(len(words))))
    return out


def telling(t: Template, templates: list[Template], threshold: float) -> list[tuple[str, ...]]:
    """For each template of another label that would otherwise pass for ``t`` and doesn't contain it: the tokens of ``t`` that it lacks. A block must have half of them."""
    near = [u for u in templates if u.label != t.label and u not in fuller(t, templates, threshold) and len(set(t.tokens) & set(u.tokens)) >= t.least(threshold)]
    return [tuple(w for w in t.tokens if w not in u.tokens) for u in near]


def fuller(t: Template, templates: list[Template], threshold: float) -> list[Template]:
    """Templates of other labels and the same size that pass for ``t``, while it doesn't pass for them."""
    shared = lambda u: len(set(t.tokens) & set(u.tokens))
    return [u for u in templates if u.label != t.label and u.size == t.size and shared(u) >= t.least(threshold) and shared(u) < u.least(threshold)]


def _lower(text: Column) -> Column:
    """A-Z in lower case. Other letters may change to others outside ASCII, which no phrase or template has.

    Two characters have ASCII ones in their lower case; texts with them go letter by letter.
    """
    capitals = "".join(map(chr, range(65, 91)))
    return F.when(F.rlike(text, F.lit("[\u212a\u0130]")), F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """array<struct<label, first, last, n>> of the phrases in ``words``, a text's words with a blank around each."""
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def place(phrase: str, label: str) -> Column:
        def described(parts: Column) -> Column:
            first = blanks(F.element_at(parts, 1)) - 1
            last = blanks(words) - blanks(F.element_at(parts, -1)) - len(phrase.split())
            return F.struct(F.lit(label).alias("label"), first.cast("long").alias("first"), last.cast("long").alias("last"), (F.size(parts) - 1).cast("long").alias("n"))

        parts = F.array(F.split(words, f"(?<= ){phrase}(?= )"))
        return F.when(F.contains(words, F.lit(f" {phrase} ")), F.element_at(F.transform(parts, described), 1))

    return F.array_compact(F.array(*[place(*p) for p in phrases]))


def candidates(s: str, templates: list[Template], threshold: float) -> Column:
    """Whether a text can match any template at all: of each one's tokens at most so many may be missing, so of one more than that any must be there.

    s: the column of the text's words, with a blank around each. The tokens with the most letters are asked for, which are rare.
    """
    some = {w for t in templates for w in sorted(t.tokens, key=lambda w: (-len(w), w))[: len(t.tokens) - t.least(threshold) + 1]}
    return F.expr(" OR ".join(f"contains({s}, ' {w} ')" for w in sorted(some)))


def blocks_of(templates: list[Template], threshold: float) -> Column:
    """array<struct<size, b>>: the windows of the words in a row ``tri`` that are long enough for a template of their size, as the template tokens that they hold."""
    parts = []
    for size in sizes_of(templates):
        mine = [t for t in templates if t.size == size]
        known, least = F.expr("array(" + ", ".join(f"'{w}'" for w in sorted({w for t in mine for w in t.tokens})) + ")"), min(t.least(threshold) for t in mine)
        starts = F.sequence(F.lit(1), F.greatest(F.size("tri") + TOKEN - 1 - size, F.lit(1)), F.lit(size))
        held = _held(starts, 2 * size - TOKEN + 1, known)
        parts.append(F.transform(F.filter(held, _at_least(least)), _sized(size)))
    return F.concat(*parts)


def _held(starts: Column, length: int, known: Column) -> Column:
    return F.transform(starts, lambda i: F.array_intersect(F.slice("tri", i, F.lit(length)), known))


def _at_least(least: int):
    return lambda b: F.size(b) >= least


def _sized(size: int):
    return lambda b: F.struct(F.lit(size).alias("size"), b.alias("b"))


def frequencies(blocks: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many blocks have each of ``tokens``. blocks: arrays of distinct template tokens, ``b``. Counted map-side first."""
    counts = blocks.select(F.explode("b").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # a row per template token at most
    return {w: 0 for w in tokens} | {r["w"]: r["n"] for r in counts}


def block_matches(blocks: DataFrame, templates: list[Template], threshold: float, counts: dict[str, int]) -> DataFrame:
    """key, label, containment of the blocks and the templates that they match.

    blocks: key, size, and b, the distinct template tokens of a block. counts: the tokens' frequencies in all blocks.
    """
    order = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    ranks = F.expr("map(" + ", ".join(f"'{w}', {i}" for w, i in order.items()) + ")")
    array = lambda tokens: "array(" + ", ".join(str(i) for i in sorted(order[w] for w in tokens)) + ")"
    ranked_tokens = lambda tokens: F.expr(array(tokens))
    prefixes = [f"({order[w]}, {at}, {t.number})" for t in templates for at, w in enumerate(sorted(t.tokens, key=order.get)[: len(t.tokens) - t.least(threshold) + 1])]
    facts = [f"({t.number}, '{t.label}', {t.size}, {t.least(threshold)}, {len(t.tokens)}, {array(t.tokens)})" for t in templates]
    listed = lambda rows, names: blocks.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS x({names})")
    shared = listed(prefixes, "rank, at, t").join(F.broadcast(listed(facts, "t, label, of_size, least, n, tr")), "t")  # templates only, whose number and length the code fixes
    ranked = fenced(blocks, ["key", "size"], r=F.sort_array(F.transform("b", lambda w: F.element_at(ranks, w))))
    shortest = F.create_map(*[F.lit(x) for size in sorted({t.size for t in templates}) for x in (size, min(t.least(threshold) for t in templates if t.size == size))])
    own_prefix = F.slice("r", F.lit(1), F.size("r") - F.element_at(shortest, F.col("size")) + 1)
    probes = ranked.select("key", "size", "r", F.posexplode(own_prefix).alias("pos", "rank"))
    able = (F.col("size") == F.col("of_size")) & (F.size("r") >= F.col("least")) & (1 + F.least(F.col("n") - F.col("at") - 1, F.size("r") - F.col("pos") - 1) >= F.col("least"))
    pairs = probes.join(F.broadcast(shared), "rank").where(able).dropDuplicates(["key", "t"])
    overlap = F.size(F.array_intersect("r", "tr"))

    def holds(told: list[tuple[str, ...]]) -> Column:
        good = F.lit(True)
        for tokens in told:
            good &= 2 * F.size(F.array_intersect("r", ranked_tokens(tokens))) >= len(tokens)
        return good

    passes = lambda t: (F.size(F.array_intersect("r", ranked_tokens(t.tokens))) >= t.least(threshold)) & holds(telling(t, templates, threshold))
    for t in templates:
        must, over = telling(t, templates, threshold), fuller(t, templates, threshold)
        wins = holds(must)
        for u in over:
            wins &= ~passes(u)
        if must or over:
            pairs = pairs.where((F.col("t") != t.number) | wins)
    return pairs.where(overlap >= F.col("least")).select("key", "label", (overlap / F.col("n")).alias("containment"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=NOTICES + TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, for every row.

    score: the largest containment of a template in a block, 1 where a phrase is found, 0 without either. A null
    or empty text has no words, empty labels and null places. Rows that repeat are scanned again, a null id stays null, an
    empty table gives an empty result, other columns are ignored whatever their names.
    """
    templates = templates_of(texts)
    universe = sorted({w for t in templates for w in t.tokens})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), _lower(text).alias("t"))
    spaced = fenced(base, ["doc_id"], s=F.concat(F.lit(" "), F.trim(F.regexp_replace("t", BETWEEN, " ")), F.lit(" ")))
    none = F.array().cast("array<string>")
    words = fenced(spaced, ["doc_id", "s"], w=F.when(candidates("s", templates, threshold), F.split(F.trim("s"), " ")).otherwise(none))
    split = fenced(words, ["doc_id", "s"], tri=F.when(F.size("w") > 0, three_in_a_row("w")).otherwise(none))
    blocks = F.when(F.size("tri") > 0, blocks_of(templates, threshold)).otherwise(F.array().cast("array<struct<size:int,b:array<string>>>"))
    n_words = F.when(F.col("s") == "  ", F.lit(0)).otherwise(F.length("s") - F.length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) - 1)
    measured = split.select("doc_id", F.monotonically_increasing_id().alias("row"), n_words.cast("long").alias("n_words"), phrase_places(F.col("s"), phrases).alias("places"), blocks.alias("blocks"))
    book = written(measured, "licenses")  # one pass over the texts; what follows reads small columns, and row numbers hold
    each = book.select("row", F.posexplode("blocks").alias("block", "x")).select(F.struct("row", "block").alias("key"), "x.size", "x.b")
    matches = block_matches(each, templates, threshold, frequencies(each, universe)).where(F.col("label") != NONE)
    found = matches.groupBy(F.col("key.row").alias("row")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    named = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    is_base = F.size("places") > 0
    return book.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words",
        F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(named, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(is_base, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
