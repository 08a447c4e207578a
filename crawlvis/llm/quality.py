"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each document is measured once and every rule evaluated once; the ledger keeps the measurements
and one bit per failed rule. A policy is a versioned mask of rules that reject. Applying another
policy, or asking what each rule alone rejects, reads the ledger and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space and symbols of the base rules.
BLANK = "\t\n\x0b\x0c\r "
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "n_symbols >= 2 * n_words AND n_words > 0"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", 4, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
    Rule("symbol_ratio", 5, "5 * n_symbols > n_words AND n_words > 0"),
)
#: Rejecting rules by policy version. Version 1 has the base rules alone, version 2 judges symbols by two to a word,
#: version 3 also rejects texts with more than one symbol to five words, as menus with bars between their words have.
POLICIES = {1: ("few_words", "repeated_windows"), 2: tuple(r.name for r in RULES if r.bit < 5), 3: tuple(r.name for r in RULES)}
BASE, CURRENT = 1, 3


def mask(version: int) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def fenced(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, computed once each: the optimizer doesn't copy them into what refers to them."""
    row = F.struct(*[F.col(c) for c in keep], *[c.alias(n) for n, c in columns.items()])
    return df.select(F.inline(F.array(row)))


def three_in_a_row(w: Column | str) -> Column:
    """Every three words in a row of the array ``w``, joined by blanks, which no word has; none if there are fewer."""
    n = F.size(w)
    part = lambda at: F.slice(w, F.lit(at), F.greatest(n - 2, F.lit(0)))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    return F.transform(zipped, lambda x: F.concat_ws(" ", x["a"], x["b"], x["c"]))


def _covered(windows: str) -> Column:
    """Words in windows that occur twice or more, each counted once: sorts the windows with their places."""
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    placed = F.sort_array(F.arrays_zip(F.col(windows).alias("t"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))

    def twice(s: Column) -> Column:
        """Places of the windows of sorted ``s`` that equal a neighbour."""
        up = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.lit(None)))
        pair = F.arrays_zip(s.alias("s"), up.alias("u"), F.concat(F.array(F.lit(None)), s).alias("d"))
        same = F.filter(pair, lambda x: x["s"].isNotNull() & (F.coalesce(x["s"]["t"] == x["u"]["t"], F.lit(False)) | F.coalesce(x["s"]["t"] == x["d"]["t"], F.lit(False))))
        return F.sort_array(F.transform(same, lambda x: x["s"]["p"]))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(placed, lambda s: let(twice(s), total))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), and failures (long).

    Bit b of ``failures`` is set where the rule of bit b fails. A null or empty text has no words and no lines, so it
    fails ``few_words`` alone. Rows that repeat are measured again. ``keep``: columns that are carried along, in a
    struct ``row`` so that their names can't clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []), text.alias("t"))
    held = ["doc_id"] + ["row"] * bool(keep)
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = fenced(
        base, held,
        w=F.filter(F.split("t", SPLIT), lambda x: x != ""), l=lines,
        n_symbols=F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long"),
    )
    held += ["n_symbols"]
    wide = fenced(
        split, held, n_words=F.size("w").cast("long"), word_chars=F.length(F.array_join("w", "")).cast("long"), n_lines=F.size("l").cast("long"), n_dup_lines=(F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        windows=F.when(F.size("w") > 3, three_in_a_row("w")).otherwise(F.array().cast("array<string>")),
    )
    held += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered("windows"))
    measured = fenced(wide, held, n_repeat_words=repeats.cast("long"))
    bits = None
    for rule in RULES:
        bit = F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("failures", bits.cast("long"))


def judged(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed, and kept: no rule of the policy fails and none of the base policy."""
    fails = lambda m: F.col("failures").bitwiseAND(F.lit(m)) != 0
    return book.withColumns({"base_failed": fails(mask(BASE)), "kept": ~fails(mask(BASE) | mask(version))})


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row per rule of the policy: how many documents it fails, and how many only it rejects. One aggregation over the bits."""
    m = F.lit(mask(version))
    failed = F.col("failures").bitwiseAND(m)
    counts = book.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    zero = F.lit(0).cast("long")
    return counts.select("bits", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(zero)).alias("n_only"),
    )


def kept_documents(docs: DataFrame, version: int = CURRENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    return judged(ledger(docs, id_col=id_col, text_col=text_col, keep=tuple(docs.columns)), version).where("kept").select("row.*")
