"""How filters interact: a Walsh-Hadamard audit of which documents fail which of them.

Every document has a mask with one bit per filter that it fails. The masks are summed up as signed
parities, one sum for each of the 32 sets of filters, per part and label; the transform is its own
inverse up to a factor, so the number of documents of each mask comes back exactly. What any order
of the filters keeps, removes and repeats, and each filter's share over all orders, are then sums
over 32 cells and read no document again.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.llm.quality import SPLIT, fenced


@dataclass(frozen=True)
class Filter:
    letter: str
    bit: int
    fails: str | None  # SQL over the measurements; None for the filter of repeated texts


FILTERS = (
    Filter("A", 0, "n_words < 200"),
    Filter("B", 1, "100 * n_distinct < 50 * n_words"),
    Filter("C", 2, "100 * n_capitals > 3 * n_points"),
    Filter("D", 3, "n_symbols > 0"),
    Filter("E", 4, None),
)
CELLS = 1 << len(FILTERS)
REPEATED = next(1 << f.bit for f in FILTERS if f.fails is None)
#: What a sum counts: all documents, those of good quality, toxic ones.
LABELS = ("all", "good", "toxic")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, and ``bits``: the filters that the text fails on its own. A null text is empty, a null part ''."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words = F.filter(F.split("t", SPLIT), lambda x: x != "")
    rows = fenced(
        base, ["doc_id", "part"], digest=F.unhex(F.sha2("t", 256)), w=words, n_points=F.length("t").cast("long"),
        n_capitals=F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long"), n_symbols=F.rlike(F.col("t"), F.lit("[#$%&*|]")).cast("int"),
    )
    rows = fenced(rows, ["doc_id", "part", "digest", "n_points", "n_capitals", "n_symbols"], n_words=F.size("w").cast("long"), n_distinct=F.size(F.array_distinct("w")).cast("long"))
    bits = F.lit(0)
    for f in FILTERS:
        if f.fails:
            bits = bits.bitwiseOR(F.when(F.expr(f.fails), F.lit(1 << f.bit)).otherwise(F.lit(0)))
    return rows.select("doc_id", "part", "digest", bits.alias("bits"))


def masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, label, n: documents by mask, in pieces that are still to be summed up.

    Whether a text repeats one of a smaller id is told from the least id of its digest. Copies have the same bits, so they
    are counted by digest and part before they meet; no task holds a group of copies. Only the documents of the least id
    are told apart from the rest, and they are one row of the group. A null id is neither smaller nor greater than another. A
    document with several rows of labels has each label that any of them gives.
    """
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    told = rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    each = told.groupBy("doc_id", "digest", "part", "bits", "good", "toxic").agg(F.count("*").alias("n"))
    counted = lambda of: F.struct(F.col(of).alias("all"), (F.col(of) * F.col("good")).alias("good"), (F.col(of) * F.col("toxic")).alias("toxic"))
    each = each.withColumns({"counts": counted("n"), "known": F.col("doc_id").isNotNull()})
    total = lambda name: F.sum(f"counts.{name}").alias(name)
    groups = each.groupBy("digest", "part", "bits").agg(
        F.min(F.when(F.col("known"), F.struct("doc_id", "counts"))).alias("first"), F.struct(*[total(x) for x in LABELS]).alias("every"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("unknown"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("leads", F.coalesce(F.col("first.doc_id") == least, F.lit(False)))
    ahead = lambda x: F.when(F.col("leads"), F.col(f"first.counts.{x}")).otherwise(F.lit(0)) + (F.col("unknown") if x == "all" else F.lit(0))
    cells = [F.struct(F.col("bits").alias("mask"), F.lit(x).alias("label"), ahead(x).alias("n")) for x in LABELS]
    cells += [F.struct(F.col("bits").bitwiseOR(F.lit(REPEATED)).alias("mask"), F.lit(x).alias("label"), (F.col(f"every.{x}") - ahead(x)).alias("n")) for x in LABELS]
    return groups.select("part", F.explode(F.array(*cells)).alias("c")).select("part", "c.*").where("n > 0")


def _odd(a: Column, b: Column | int) -> Column:
    """1 where ``a`` and ``b`` share an odd number of bits."""
    return F.bit_count(a.bitwiseAND(F.lit(b) if isinstance(b, int) else b)).bitwiseAND(F.lit(1))


def parities(counted: DataFrame) -> DataFrame:
    """part, label, sums: for each set of filters, the documents that fail an even number of them less those that fail an odd one."""
    signed = [F.sum(F.col("n") * (1 - 2 * _odd(F.col("mask"), s))).alias(f"s{s}") for s in range(CELLS)]
    return counted.groupBy("part", "label").agg(*signed).select("part", "label", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def inverted(sums: Column) -> Column:
    """The number of documents of each mask, from the signed sums. Exact: the transform twice is 32 times the counts."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    signed = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.get(sums, s) * (1 - 2 * _odd(m, s)))
    return F.transform(every, lambda m: F.shiftright(signed(m), len(FILTERS)))


def cells(counted: DataFrame) -> DataFrame:
    """part, and for each label the array of its documents by mask, zeros included."""
    rows = parities(counted).select("part", "label", inverted(F.col("sums")).alias("c"))
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    return rows.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("c"))), none).alias(x) for x in LABELS])


def _over(counts: Column, wanted) -> Column:
    """The sum of the cells, each times what ``wanted`` gives for its mask."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.get(counts, m) * wanted(m))


def evaluated(parts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order and step."""
    letters = "".join(f.letter for f in FILTERS)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    rows = parts.select("part", *LABELS, F.explode(orders).alias("filter_order"))
    rows = rows.select("part", *LABELS, "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda at: f"shiftleft(1, instr('{letters}', substring(filter_order, {at}, 1)) - 1)"
    before = F.expr(f"aggregate(sequence(1, {len(letters)}), 0, (a, k) -> a + if(k < step, {bit('k')}, 0))")
    rows = fenced(rows, ["part", *LABELS, "filter_order", "step"], here=F.expr(bit("step")), before=before)
    here, earlier = F.col("here"), F.col("before")
    fails = lambda m, b: m.bitwiseAND(b) != 0
    one = lambda condition: condition.cast("long")
    removed = lambda m: one(fails(m, here) & ~fails(m, earlier))
    share = lambda m: F.when(fails(m, here), F.floor(F.lit(factorial(len(letters))) / F.bit_count(m))).otherwise(F.lit(0)).cast("long")
    count = F.col("all")
    return rows.select(
        "part", "filter_order", "step",
        _over(count, lambda m: one(~fails(m, here) & ~fails(m, earlier))).alias("kept"), _over(count, removed).alias("removed"), _over(count, lambda m: one(fails(m, here) & fails(m, earlier))).alias("redundant"),
        _over(count, lambda m: one(m == here)).alias("unique_fails"), _over(F.col("good"), removed).alias("good_lost"), _over(F.col("toxic"), removed).alias("toxic_lost"), _over(count, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, every order of the five filters and every step, what the step does and how filters share the removals.

    A null text is empty: it fails A, and E where an earlier text is null or empty too. Rows that repeat count each; of rows of
    one id with one text, none is a copy of the other. A null part counts as ''. Empty tables give no rows. Columns besides
    those named are not read.
    """
    return evaluated(cells(masks(measured(docs), labels)))
