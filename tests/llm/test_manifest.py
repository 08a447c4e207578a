"""The manifest against a tree that is built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from crawlvis.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The levels of a tree: each with its runs."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    """What stands left and right of the way up from leaf i."""
    out = []
    for level in levels[:-1]:
        run, at = level[i - i % 8 : i - i % 8 + 8], i % 8
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 8
    return out


def by_hand(rows):
    order = lambda v: (v is not None, v)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(*row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda x: (order(x[0][0]), x[1]))
    trees = {g: climb([x[1] for x in groups[g]]) for g in names}
    crown = climb([trees[g][-1][0] for g in names])
    root, out = crown[-1][0] if names else None, []
    for k, g in enumerate(names):
        for i, (row, own) in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(crown, k)
            doc_id, source, lang, n_chars, text = row
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(doc_id, source, lang, n_chars, text)
            for left, right in path:
                fold = h(left, fold, right)
            out.append((doc_id, own, trees[g][-1][0], root, h(*(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


def checked(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' as hash", "1 as leaf", "2 as grp", "'y' as row").repartition(3)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, manifest.tamper_test(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).collect()), key=repr)


def made(n, r):
    texts = ["Hello World", "plain", "", None, "ÄÖ Ünï", "A" * 200_000]
    return [(i, r.choice(("a", None, "")), r.choices(("en", "de", None, "", "é", "Z"), (60, 5, 3, 2, 1, 1))[0], r.choice((None, 3)), r.choice(texts)) for i in r.sample(range(-n, 10 * n), n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_manifest_equals_a_tree_in_memory(spark, n):
    rows = made(n, random.Random(n))
    assert checked(spark, rows) == by_hand(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = made(40, random.Random(2))
    rows += rows[:10] + [(None, "a", "en", 1, "x"), (None, None, None, None, None), (None, None, None, None, None), (rows[0][0], "other", rows[0][2], 1, "t")]
    assert checked(spark, rows) == by_hand(rows)


def test_manifest_of_nothing(spark):
    assert checked(spark, []) == []


def test_many_groups(spark):
    rows = [(i, "s", f"l{i % 70}", 1, "T") for i in range(150)]
    assert checked(spark, rows) == by_hand(rows)


def test_no_task_sorts_a_group(spark):
    """Rows of one group are numbered in several ranges."""
    rows = spark.range(5000).selectExpr("'g' as grp", "id as o0")
    placed = manifest.numbered(rows, "grp", ["o0"], "test")
    assert placed.where("idx != o0 or size != 5000").count() == 0
