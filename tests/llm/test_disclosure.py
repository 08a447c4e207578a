"""Personal data and the terms that disclose it, against the plain forms of Python's own patterns and a count word by word."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crawlvis.llm import disclosure

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in FORMS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def is_word(c):
    import unicodedata

    return unicodedata.category(c)[0] in "LM"


def words(text):
    """Words of a text with blanks for its addresses of mail: start, end, lower case."""
    text = re.sub(FORMS["email"], lambda m: " " * len(m[0]), text or "")
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and is_word(text[end]):
            end += 1
        if end - at >= disclosure.LEAST:
            out.append((at, end, text[at:end].lower()))
        at = max(end, at + 1)
    return out


def forms(term):
    return [term, *(term[:n] + "*" for n in disclosure.PREFIXES if len(term) > n)]


def told(texts):
    total, near, seen = Counter(), Counter(), defaultdict(set)
    for text in texts:
        own, places = words(text), set()
        total.update(f for _, _, w in own for f in forms(w))
        for kind, begin, end, value in base(text):
            places |= {(kind, value, s, w) for s, e, w in own if (s >= begin - disclosure.NEAR and e <= begin) or (s >= end and e <= end + disclosure.NEAR)}
        for kind, value, _, w in places:
            for f in forms(w):
                near[kind, value, f] += 1
                seen[kind, value, f].add(text)
    bad = {f for (k, v, f), n in near.items() if len(seen[k, v, f]) >= disclosure.SUPPORT and n * 2**disclosure.SLACK >= total[f]}
    return {f: next((x for x in forms(f)[1:] if x not in bad), "") for f in bad if not f.endswith("*")}


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


ODD = [
    None, "", "a@b.c_d@e.f.g 1.2.3.4.5.6.7.8", "12-34 56 78 4111-1111-1111-1111 0", "4111 1111 1111 1111", "4111  1111 1111 1111", "x4111111111111111y", "0.0.0.0 000.001.255.0256 10.0.0.300 1.2.3", "+49 (0) 30 1234.5678-", "+1 +1 (2", "é" * 30 + "a@b.co" + "ß" * 70, "a@@b.c a@b..c a@b.c. @b.c .@-.-",
    "+" * 50 + "1 2345678", "1" * 300 + "." + "1.1.1", "😀a@b.cc😀+12345678😀", "4" * 16 + "-" + "1" * 16, "5500 0000 0000 0004-1 x 5500000000000004", "a.b@c.d-e.f%g@h.i",
]


def corpus(seed, n):
    r = random.Random(seed)
    common = "quick brown lazy dogs jumped over where river banks flow along with many small green leaves über straße".split()
    out = []
    for i in range(n):
        w = [r.choice(common) for _ in range(r.randint(5, 60))]
        for value in ("+1 (555) 123-4567", "4111 1111 1111 1111", "10.0.0.255", "jane.roe@mail.example.org,", "x@y.zz"):
            if r.random() < 0.12:
                w.insert(r.randint(0, len(w)), value)
        if i % 6 == 0:
            w[len(w) // 2 : len(w) // 2] = ["Zyxander", "Quillsworth", "calls", "zyx.q@corp.example.com", "Montgomery.", "montgomeries"]
        if i % 15 == 7:
            w += ["Montgomery", "Quillsome"]
        out.append(" ".join(w))
    return out


def test_spans_and_terms(spark):
    texts = corpus(4, 90) + ODD
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (6, texts[7]), (200, texts[12]), (201, texts[12])]
    bad = told([t for _, t in rows])
    assert "zyxander" in bad and "quillsworth" in bad and bad["quillsworth"] != ""
    expected = []
    for i, t in rows:
        found = base(t)
        terms = [("term", s, e) for s, e, w in words(t) if w in bad]
        n = Counter(k for k, *_ in found)
        own = listed([x[:3] for x in found])
        expected.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(own.encode()).hexdigest(), listed([*(x[:3] for x in found), *terms]), len(terms)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as email", "'x' as terms", "2 as digest", "3 as near").repartition(3)
    assert sorted(map(tuple, disclosure.spans_and_digests(df).collect()), key=repr) == sorted(expected, key=repr)
    pages = disclosure.book(df)
    assert {r["term"]: r["replacement"] for r in disclosure.disclosing(pages, disclosure.occurrences(df)).collect()} == bad


def test_sanitised_text(spark):
    text = "Zyxander Quillsworth, zyx.q@corp.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, at 10.0.0.1 and 10.0.0.300."
    found = F.create_map(F.lit("zyxander"), F.lit(""), F.lit("quillsworth"), F.lit("qu*"))
    out = spark.createDataFrame([(text,), (None,)], "t string").select(disclosure.sanitised(F.col("t"), found).alias("x")).collect()
    assert out[0]["x"] == " qu*, [EMAIL] or [PHONE], card [CARD], at [IP] and 10.0.0.300." and out[1]["x"] is None


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.spans_and_digests(none).count() == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1 " * 330_000, "1 " * 500_000, "a@b.cc " * 20_000], ids=lambda t: t[:8])
def test_a_megabyte_takes_linear_time(spark, text):
    one = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string").select(*[F.size(c).alias(k) for k, c in disclosure.protected(F.col("text")).items()]).first()
    one("x")
    began = time.monotonic()
    row = one(text)
    assert time.monotonic() - began < 20
    n = Counter(k for k, *_ in base(text)) if text[0] == "a" and "b" in text else None
    assert n is None or row["email"] == n["email"]


def test_many_values_in_a_text(spark):
    """Words beside ten thousands of values of one text, in time that goes with their number."""
    texts = ["some words a@b.cc more terms +1 (555) 123-4567 " * 8_000, "a@b.cc " * 20_000]
    began = time.monotonic()
    rows = disclosure.spans_and_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_email"], r["n_phone"], r["n_terms"]) for r in rows] == [(8_000, 8_000, 0), (20_000, 0, 0)]
    assert time.monotonic() - began < 90
