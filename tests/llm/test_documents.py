"""Language, quality, licenses and near duplicates against plain restatements, with edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlvis.llm import language, licenses, near_duplicates, quality
from crawlvis.llm.components import components

DATA = Path("/root/testdata/sf0.001")
NASTY = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ???"), (5, "one"), (5, "one"), (None, "one two"), (6, "x" * 4000), (7, "a b c " * 3000), (8, "Kelvin İx mit license")]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(NASTY, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "w": F.lit("w"), "row": F.lit(1), "n_words": F.lit("n")})


def ledger_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark, nasty):
    r = random.Random(2)
    extra = [(100 + i, "".join(r.choice(("a ", "b ", "c\n", "## ", "dd ", "\n", "é|x ")) for _ in range(r.randrange(90)))) for i in range(150)]
    df = nasty.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = quality.judged(quality.ledger(df)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert sorted(map(str, ((x["doc_id"], *(x[n] for n in names)) for x in got))) == sorted(map(str, ((i, *ledger_of(t)) for i, t in NASTY + extra)))
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good), (2, "few"), (3, "same words here " * 30), (4, " ".join(f"w{i}***" for i in range(80))), (5, good + "\n" + "l\n" * 60)], "doc_id long, text string")
    book = quality.ledger(docs)
    kept = lambda v: {x["doc_id"] for x in quality.judged(book, v).where("kept").collect()}
    assert kept(2) == {1} and kept(1) == {1, 4, 5} - {x["doc_id"] for x in book.where("100 * n_repeat_words > 50 * n_words").collect()}
    rows = {x["rule"]: (x["n_failed"], x["n_only"]) for x in quality.ablations(book).collect()}
    assert rows["few_words"][1] == 1 and rows["symbol_ratio"] == (1, 0) and rows["repeated_lines"][0] >= 1
    bits = {x["doc_id"]: x["failures"] for x in book.collect()}
    for rule in quality.RULES:
        assert rows[rule.name] == (sum(b >> rule.bit & 1 for b in bits.values()), sum(b == 1 << rule.bit for b in bits.values()))
    assert {r["doc_id"] for r in quality.kept_documents(docs).collect()} == {1}


def test_quality_filter_keeps_columns(nasty):
    out = quality.kept_documents(nasty)
    assert out.columns == nasty.columns and out.count() == 0
    assert quality.ledger(nasty.limit(0)).count() == 0


def license_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels, score = [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    base, templates = set(labels), licenses.templates_of()
    for size in licenses.SIZES:
        for start in range(0, max(len(words) - size, 1), size):
            window = words[start : start + 2 * size]
            have = {" ".join(window[i : i + 3]) for i in range(len(window) - 2)}
            share = {t: len(have & set(t.tokens)) / len(t.tokens) for t in templates if t.size == size}
            good = {t for t in share if share[t] >= licenses.THRESHOLD - 1e-9 and all(2 * len(have & set(x)) >= len(x) for x in licenses.telling(t, templates, licenses.THRESHOLD))}
            for t in good:
                if not good & set(licenses.fuller(t, templates, licenses.THRESHOLD)):
                    labels.add(t.label)
                    score = max(score, share[t])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else score


def test_license_texts_and_look_alikes(spark):
    r = random.Random(3)
    whole = dict(zip([label for _, label in licenses.TEXTS], [t for t, _ in licenses.TEXTS], strict=True))
    filler = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows, want = [], {}
    for label, text in whole.items():
        for n in (0, 3, 70, 300, 511, 512, 900):
            words = text.split()
            words[-5] += " Inc"  # as a name that was put in
            rows.append((f"{label}-{n}", f"{filler(n)}\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + f"\n{filler(n)}"))
            want[rows[-1][0]] = {label}
    rows += [("reserved", "the rights of all are reserved to nobody"), ("v3", "This work is licensed under the GNU General Public License, version 3. It is no longer version 2 of it."), ("half", " ".join(whole["mit"].split()[:60]))]
    want |= {"reserved": set(), "v3": {"gpl-3"}, "half": set()}
    got = {x["doc_id"]: set(filter(None, x["labels"].split(","))) for x in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, labels in want.items():
        assert labels <= got[name] and got[name] - labels <= {"apache-2", "mpl-2"} - labels, name


def test_license_scan(spark, nasty):
    r = random.Random(4)
    bits = ["Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "Released under the MIT License.", "Apache License, Version 2.0", "All rights\nreserved", "All rights reserved.", "words the of to", "licensed under the gnu general public license v 3", "\n", "under  THE mit-license", "xunder the mit license", "version 3", "é", "license"]
    extra = [(100 + i, " ".join(r.choice(bits) for _ in range(r.randrange(8)))) for i in range(200)]
    for i in range(120):  # whole texts, some with words changed, put in or left out
        words = [w for _ in range(r.choice((1, 1, 2))) for w in r.choice(licenses.TEXTS)[0].split()]
        for _ in range(r.choice((0, 0, 1, 3, 6))):
            words[r.randrange(len(words))] = r.choice(("", "new", "a b", "VERSION"))
        extra.append((400 + i, "x " * r.choice((0, 30, 500)) + " ".join(words) + " y" * r.choice((0, 40))))
    df = nasty.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("n_words", F.lit("")))
    got = [tuple(x) for x in licenses.scan(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *license_of(t))) for i, t in NASTY + extra)
    assert licenses.scan(df.limit(0)).count() == 0


def test_language_backoff_and_edges(spark, nasty):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 40)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    assert [x for x, _ in model.predict(["the dog", "der katzenhund", "et le chienne", "", "123 !"])] == ["en", "de", "fr", "und", "und"]
    out = language.predictions(nasty, model).collect()
    assert len(out) == len(NASTY) and all((x["lang_pred"] == "und") == (x["doc_id"] in (1, 2, 3, 4)) and 0 <= x["score"] <= 1 for x in out)
    nothing = language.identified(nasty)
    assert {(x["lang_pred"], x["score"]) for x in nothing.collect()} == {("und", 0.0)}
    assert language.kept_documents(nasty, model).columns == nasty.columns
    assert language.identified(nasty.limit(0)).count() == 0


def restated(train, texts):
    """Word-first backoff in plain dictionaries: language and score of each text."""
    langs = sorted({lang for _, lang in train})
    words = {lang: Counter(w for t, x in train if x == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}
    grams = {}
    for n in language.LENGTHS:
        for lang in langs:
            count = grams[n, lang] = Counter()
            for w, c in words[lang].items():
                m = f"\x02{w}\x03"
                for i in range(len(m) - n + 1):
                    if m[i : i + n] not in "\x02\x03":
                        count[m[i : i + n]] += c
    log = lambda count, x: math.log(count.get(x, 0.5)) - math.log(sum(count.values()) + 1)

    def score(word, lang):
        if any(word in words[x] for x in langs):
            return log(words[lang], word)
        m = f"\x02{word}\x03"
        for n in language.LENGTHS:
            known = [m[i : i + n] for i in range(len(m) - n + 1) if any(m[i : i + n] in grams[n, x] for x in langs)]
            if known:
                return sum(log(grams[n, lang], g) for g in known) / len(known)
        return 0.0

    out = []
    for t in texts:
        found = re.findall(r"[^\W\d_]+", (t or "").lower())
        totals = [sum(score(w, lang) for w in found) for lang in langs]
        best = max(range(len(langs)), key=lambda k: (totals[k], -k)) if langs else None
        out.append((langs[best], 1 / sum(math.exp(x - totals[best]) for x in totals)) if found and langs else ("und", 0.0))
    return out


def test_language_equals_a_plain_restatement(spark):
    r = random.Random(5)
    vocabulary = {"en": "the cat and dog runs over hill with words of joy".split(), "de": "der hund und die katze über den hügel läuft größe".split(), "fr": "le chat et chien sur la colline avec joie été".split(), "rare": "qwx zzt vvk".split()}
    rows = []
    for i in range(240):
        lang = r.choice(("en", "de", "fr", "fr")) if i % 40 else "rare"
        rows.append((i, " ".join(r.choice(vocabulary[lang]) + r.choice(("", "", "s", "en")) for _ in range(r.randrange(12))) + r.choice(("", ". 12!", "_x")), lang if r.random() < 0.8 else None))
    rows += [(None, "nonono", "none"), (900, None, "en"), (901, "漢字 dog", None), (902, "Ωmega dogcat hundkatze " * 50, None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as w")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = [(t or "", lang) for i, t, lang in rows if lang and i is not None and not held(i)]
    train = [x for x in train if x[1] in {lang for t, lang in train if re.search(r"[^\W\d_]", t)}]
    want = sorted((str(i), held(i), p, round(s, 9)) for (i, _, _), (p, s) in zip(rows, restated(train, [t for _, t, _ in rows]), strict=True))
    assert sorted((str(x["doc_id"]), x["held_out"], x["lang_pred"], round(x["score"], 9)) for x in language.identified(df).collect()) == want


def test_language_sample_keeps_rare_languages_whole(spark):
    rows = [(i, f"w{i}", "many" if i % 50 else "few") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, languages = language.training_sample(df, max_rows=300)
    count = Counter(x["lang"] for x in sample.collect())
    free = [lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert languages == ["few", "many"] and count["few"] == free.count("few") and 200 < count["many"] < 400


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) >= 0.98 * len(out)


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected_classes(rows):
    sets, links = [shingle_set(t) for _, t in rows], defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        label[i] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], label[i], len(links[i])) for i in range(len(rows)))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)  # families of several blocks
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [r.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    for i in range(60, 160):
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 4, 5, 30, 200))))))
    rows += [(200 + i, rows[i * 7][1]) for i in range(12)] + [(300, None), (301, ""), (302, "!"), (303, "Same Words here, now FIVE six"), (304, "same words here now five six"), (305, "Zé " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as keys", "1 as node", "2 as family")
    got = sorted((x["doc_id"], x["class_id"], x["n_links"]) for x in near_duplicates.members(df).collect())
    want = expected_classes(rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    missed = sum(a[2] != b[2] for a, b in zip(got, want, strict=True))
    assert missed == 0
    kept = near_duplicates.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({x[1] for x in want})


def test_near_duplicates_edges(spark, nasty):
    got = near_duplicates.members(nasty).collect()
    assert len(got) == len(NASTY)
    assert {x["n_links"] for x in got if x["doc_id"] == 5} == {1}
    assert near_duplicates.members(nasty.limit(0)).count() == 0
    kept = near_duplicates.kept_documents(nasty).collect()
    assert sum(x["doc_id"] == 5 for x in kept) == 1 and sum(x["doc_id"] is None for x in kept) == 1


def forest_edges(rows, batch, similarity=0.8, trees=32):
    """What a single task reads off sorted rows (tree, hi, lo, node, sketch…), in batches of a size."""
    sketch = trees * near_duplicates.LEVELS // 64
    schema = pa.schema([("tree", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("node", pa.binary()), *[(f"s{k}", pa.int64()) for k in range(sketch)]])
    rows = sorted(rows)
    parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + batch]], schema=schema) for i in range(0, len(rows), batch)]
    return [r for b in near_duplicates._forest(iter(parts), similarity, trees) for r in b.to_pylist()]


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
@pytest.mark.parametrize("run", [2, 5, 256])
def test_the_tries_connect_what_shares_a_prefix(monkeypatch, batch, run):
    monkeypatch.setattr(near_duplicates, "RUN", run)
    r = random.Random(batch * run)
    near, far = [0, 0, 0, 0], [-1, -1, -1, -1]
    level = lambda: r.choice((1, 1, 2))
    rows = []
    for n in range(120):
        levels = [level() for _ in range(8)]
        key = [sum(v << (48 - 16 * k) for k, v in enumerate(part)) for part in (levels[:4], levels[4:])]
        rows.append((n % 3, *key, f"{n:04}".encode(), *(near if n % 2 else far)))
    out = forest_edges(rows, batch)
    prefix = {x[3]: (x[0], *(x[1 + k // 4] >> (48 - 16 * (k % 4)) & 0xFFFF for k in range(8))) for x in rows}
    sketch = {x[3]: x[4] for x in rows}
    for depth in range(near_duplicates.LEAST_DEPTH, near_duplicates.LEVELS + 1):
        root = {x: x for x in prefix}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for e in out:
            if e["v"] is not None and e["depth"] >= depth:
                assert prefix[e["u"]][: e["depth"] + 1] == prefix[e["v"]][: e["depth"] + 1]
                root[find(e["u"])] = find(e["v"])
        for a in prefix:
            for b in prefix:
                if prefix[a][: depth + 1] == prefix[b][: depth + 1] and sketch[a] == sketch[b]:
                    assert find(a) == find(b)
    ends = [x for x in out if x["hi"] is not None]
    assert {x["u"] for x in ends} >= {min(rows)[3]} and {x["depth"] for x in ends} == set(range(4, 9))
    if run == 256:  # all pairs of runs inside the task were looked at: no edge joins texts whose sketches differ
        inner = [e for e in out if e["v"] is not None and len({prefix[min(rows)[3]][:5], prefix[max(rows)[3]][:5], prefix[e["u"]][:5]}) == 3]
        assert all(sketch[e["u"]] == sketch[e["v"]] for e in inner)


def test_the_matched_prefix_is_shortened_until_the_recall():
    met, missed = [100.0, 90.0, 80.0, 70.0, 60.0], [0.0, 0.001, 0.1, 1.0, 5.0]
    at = lambda recall: near_duplicates.matched_depth(met, missed, recall)
    assert (at(0.5), at(0.98), at(0.99), at(0.9999), at(1.0)) == (8, 7, 6, 5, 4)
    assert near_duplicates.matched_depth([0.0] * 5, [0.0] * 5) == near_duplicates.LEVELS


def test_the_measured_recall_is_that_of_the_tries():
    """Pairs of known similarity: the measure, made from what is met, against the pairs that are met in no tree."""
    r, trees = np.random.default_rng(3), 32
    for s in (0.8, 0.9):
        rows, n = [], 3000
        shares = r.random((n, trees, near_duplicates.LEVELS)) < s
        for i in range(n):
            bits = r.integers(0, 2, 256)
            twin = np.where(shares[i].ravel(), bits, r.integers(0, 2, 256))
            for half, of in ((0, bits), (1, twin)):
                words = np.packbits(of.astype(np.uint8)).view(np.int64).tolist()
                for t in range(2):  # two of the trees speak for all
                    lv = [i >> 8, i & 255, 7, 7, 7, 7, 7, 7]
                    for k in np.flatnonzero(~shares[i, t]):
                        lv[k] = lv[k] + 1000 * half
                    key = [sum(int(v) << (48 - 16 * k) for k, v in enumerate(p)) for p in (lv[:4], lv[4:])]
                    rows.append((t, *key, f"{i:05}{half}".encode(), *words))
        out = forest_edges(rows, 5000)[-1]
        for k, depth in enumerate(range(near_duplicates.LEAST_DEPTH, near_duplicates.LEVELS + 1)):
            real = (1 - s**depth) ** trees
            assert out["met"][k] == pytest.approx(n * 2 / trees, rel=0.4)
            assert real / 8 <= out["missed"][k] / out["met"][k] <= 3 * (1 - 0.8**depth) ** trees + 1e-6


def test_chance_candidates_do_not_chain(spark):
    """A long chain of texts that share a third of their shingles with the next: no family of the whole chain, and true links are all found."""
    words = [f"w{i}" for i in range(4200)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 44])) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["class_id"], x["n_links"]) for x in near_duplicates.members(df).collect())
    assert got == expected_classes(rows)
    signed = df.select(F.unhex(F.md5("text")).alias("node"), "doc_id", "text").mapInArrow(lambda b: near_duplicates._signed(b, 5, 32), "node binary, rank long, signature array<long>")
    sizes = components(near_duplicates.candidate_edges(signed, recall=1.0)).groupBy("label").count().collect()
    assert max(x["count"] for x in sizes) <= 20
