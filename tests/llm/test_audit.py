"""The filter audit against every order applied one after the other."""

import hashlib
import random
from itertools import permutations

from pyspark.sql import functions as F

from crawlvis.llm import audit

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failures(docs):
    """The letters that each document fails."""
    out = []
    for doc_id, text, _ in docs:
        t = text or ""
        w = words(t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append(bad + "E" * any(o is not None and doc_id is not None and o < doc_id and (x or "") == t for o, x, _ in docs))
    return out


def by_hand(docs, labels):
    good, toxic = ({x[0] for x in labels if x[k] == 1} - {None} for k in (1, 2))  # a null id has no labels
    bad, out = failures(docs), {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(doc_id, b) for (doc_id, _, lang), b in zip(docs, bad, strict=True) if (lang or "") == part]
        removed_by = {letter: 0 for letter in "ABCDE"}
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, stay = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                removed_by[letter] += len(gone)
                again = sum(letter in b for _, b in mine) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), again, sum(b == letter for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def documents(n, seed):
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randint(0, r.choice((60, 9999)))}" for _ in range(r.choice((30, 199, 200, 260)))) for _ in range(12)]
    texts += [t + r.choice((" #", " A" * 60, "\x0b\tx", " y")) for t in texts] + [None, "", " ", "É" * 50]
    return [(None if r.random() < 0.05 else r.randint(0, n), r.choice(texts), r.choice((None, "", "en", "de"))) for _ in range(n)]


def test_audit_equals_all_orders(spark):
    docs = documents(220, 3)
    docs += docs[:5]  # rows that repeat
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 220, 3)] + [(3, 1, None), (9, None, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "'x' as mask", "0 as part", "2 as quality")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = by_hand(docs, labels)
    rows = audit.audit(df, known)
    assert rows.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(expected) == 3 * 600 and set(got) == expected


def test_transform_is_its_own_inverse(spark):
    counts = [random.Random(1).randint(0, 10**12) for _ in range(32)]
    rows = spark.createDataFrame([("p", "all", m, n) for m, n in enumerate(counts)], "part string, label string, mask int, n long")
    sums = audit.parities(rows)
    assert sums.first()["sums"][0] == sum(counts)
    assert sums.select(audit.inverted(F.col("sums")).alias("c")).first()["c"] == counts


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x" * 3_000_000, None)], "doc_id long, text string, lang string")
    rows = audit.audit(one, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r["part"], r["kept"], r["removed"], r["shapley"]) for r in rows] == [("", 0, 1, 120), ("", 0, 0, 0), ("", 0, 0, 0), ("", 0, 0, 0), ("", 0, 0, 0)]


def test_copies_meet_as_counts(spark):
    """A text of a third of all rows is one row per part where copies meet."""
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text", "'en' as lang")
    rows = audit.masks(audit.measured(df), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows.where("mask & 16 != 0").agg(F.sum("n"), F.count("*")).first()[:] == (999, 1)
    assert hashlib.sha256(b"same").hexdigest() == audit.measured(df).where("doc_id = 0").select(F.lower(F.hex("digest"))).first()[0]
