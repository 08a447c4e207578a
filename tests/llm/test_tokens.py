"""Encoding, packing and attribution against the tokenizers library and plain restatements."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlvis.llm import attribution, codec, packing
from crawlvis.llm.bpe import Vocabulary
from crawlvis.llm.transducer import Transducer, compile_words, save

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = [
    "", " ", "\n\n", "I'm it's WE'LL we'LL they'd've ''s 's 'llama\n'sa  \n\n x", "a  b\t\td \n", "ΟΔΟΣ Σ İstanbul é x́y", "<|endoftext|>a<|startoftext|> b<|endoftext|><|endoftext|>",
    "½²٣ १२३ 漢字かな👍🏽 ''''' a''b 1'2s", "\x1c\x1f\x85 q", "aaaaaaaaaaaa aaa", "x" * 5000, "The quick brown fox. " * 300,
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return Vocabulary.read(path), Tokenizer.from_file(path)


def test_ids_equal_the_librarys(pair):
    vocabulary, library = pair
    r = random.Random(7)
    texts = ODD + ["".join(r.choice("ab'sStTlLreEvVmMdD12 \n\t .,!é²") for _ in range(r.randrange(60))) for _ in range(1500)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in vocabulary.encode_all(texts)] == expected


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5))
def test_any_text_encodes_as_in_the_library(texts):
    path = public_tokenizers.path(FILES[0])
    vocabulary, library = test_any_text_encodes_as_in_the_library.__dict__.setdefault("pair", (Vocabulary.read(path), Tokenizer.from_file(path)))
    assert [x.tolist() for x in vocabulary.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_longer_than_a_scan_is_whole(pair):
    vocabulary, library = pair
    texts = ["word " * 400, "b", "é\n" * 300]
    got = []
    parts = [vocabulary.normalized(t) for t in texts]
    for some in vocabulary.encode(parts, limit=100):
        got += [some.ids[a:b].tolist() for a, b in zip(some.ends, some.ends[1:], strict=False)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_finds_just_its_words(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(("a", "ab", "abc", "bc", "c", "xbc", "é", "walking", "talking"))}
    arrays = compile_words(words)
    save(arrays, str(tmp_path / "t"))
    lexicon = Transducer(str(tmp_path / "t"))
    asked = ["abc", "ab", "abcd", "", "x", "bc", "talking", "é", "alking", "walking"]
    found = lexicon.find(pa.array(asked))
    assert [f >= 0 for f in found] == [w.encode() in words for w in asked]
    ids, count = lexicon.outputs(found[found >= 0])
    assert ids.tolist() == [i for w in asked if w.encode() in words for i in words[w.encode()]]
    assert count.tolist() == [2] * int((found >= 0).sum())
    assert len(arrays["final"]) < sum(map(len, words)) + 1  # suffixes are shared
    assert (Transducer(_saved(tmp_path, {})).find(pa.array(["a"])) == -1).all()


def _saved(folder, words):
    save(compile_words(words), str(folder / "none"))
    return str(folder / "none")


def test_lexicon_changes_no_id(tmp_path):
    vocabulary = Vocabulary.read(public_tokenizers.path(FILES[1]))
    save(compile_words(codec.lexicon_words(vocabulary, ["thntti", "the", "'s"])), str(tmp_path / "t"))
    lexicon = Transducer(str(tmp_path / "t"))
    texts = ["the thntti and others it's", "unknownish wordes", ""]
    assert [x.tolist() for x in vocabulary.encode_all(texts, lexicon)] == [x.tolist() for x in vocabulary.encode_all(texts)]


def test_round_trip_digests(spark):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    got = sorted(map(tuple, codec.round_trip_digests(df, public_tokenizers.path(FILES[1]), frequent=5).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=str)


def test_decode_gives_the_text_back(spark):
    texts = ["it is, é well ", "a\n b\t漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path(FILES[0])
    back = codec.decode(codec.encoded(df, path).select("doc_id", "ids"), path)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == texts
    assert codec.encoded(df.limit(0), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_packs_every_piece_once(counts):
    made = packing.plan(counts, 40)
    packed = {}
    for lengths, times in made.patterns:
        assert sum(lengths) <= 40 and times > 0
        for n in lengths:
            packed[n] = packed.get(n, 0) + times
    assert packed == counts
    # No packing can do with less than its tokens fill, or put two pieces of more than half a sequence together.
    least = max(-(-sum(n * c for n, c in counts.items()) // 40), sum(c for n, c in counts.items() if n > 20))
    assert least <= made.sequences <= 1.5 * least + 1


@pytest.mark.parametrize(("counts", "sequences"), [({}, 0), ({40: 3}, 3), ({25: 2, 15: 2}, 2), ({20: 4}, 2), ({20: 1, 12: 1, 8: 1}, 1), ({10: 4}, 1), ({19: 1, 12: 1, 5: 1, 4: 1}, 1), ({21: 3}, 3)])
def test_exact_complements_are_found(counts, sequences):
    assert packing.plan(counts, 40).sequences == sequences


def test_index_finds_what_a_search_of_all_combinations_finds():
    r = random.Random(11)
    for _ in range(300):
        free = np.zeros(31, dtype=np.int64)
        for _ in range(r.randrange(8)):
            free[r.randint(1, 30)] = r.randint(1, 3)
        index = packing.Combinations(free)
        for _ in range(12):  # counts only fall between lookups
            total = r.randint(1, 30)
            held = [n for n in range(31) for _ in range(free[n])]
            want = next((k for k in (1, 2, 3) if any(sum(c) == total for c in itertools.combinations(held, k))), None)
            found = index.filling(total)
            assert (found and len(found)) == want
            if found:
                assert sum(found) == total and all(free[n] >= found.count(n) for n in found)
                for n in found:
                    free[n] -= 1


def test_packed_documents(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = [" ".join(r.choice(("alpha", "be", "gamma,", "it's", "été")) for _ in range(r.choice((0, 3, 3, 3, 40, 90)))) for _ in range(150)] + [None, "same", "same"]
    rows = [(i if i < 152 else 151, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as length", "2 as offset", "3 as row")
    got = packing.packed_documents(df, path, capacity=64).collect()
    expected = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(map(str, (tuple(x)[:5] for x in got))) == sorted(map(str, expected))
    places = {}
    for x in got:
        places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 64
    total = sum(x["length"] for x in got)
    assert len(places) <= 1.05 * total / 64 + 3
    assert packing.packed_documents(df.limit(0), path).count() == 0
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, 0, 0, 0, 70)], "doc_id long, piece int, start long, ids_crc32 long, length long"), 64).collect()


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_by_rule(rule):
    r = random.Random(5)
    for _ in range(200):
        widths = np.array([r.randint(1, 6) for _ in range(r.randint(1, 12))])
        total = int(widths.sum())
        starts = np.array(sorted({0, *(r.randrange(total) for _ in range(3))}))
        tokens, crossing = attribution.attribute(starts, widths, rule)
        want, cross, at = [0] * len(starts), [0] * len(starts), 0
        for w in widths:
            inside = [sum(1 for b in range(at, at + w) if s <= b < (starts[i + 1] if i + 1 < len(starts) else total)) for i, s in enumerate(starts)]
            i = inside.index(max(inside)) if rule == "majority" else next(k for k, n in enumerate(inside) if n)
            want[i] += 1
            cross[i] += sum(n > 0 for n in inside) > 1
            at += w
        assert tokens.tolist() == want and crossing.tolist() == cross


def test_section_tokens_add_up(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    texts = ["one line", "two\nlines é\n", "a\n\n\n  b\r\nc\x0bd", "", None, "\n", "x" * 3000, "é\né"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id\nat all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as section", "'x' as n_tokens")
    every = attribution.section_tokens(df, path).collect()
    assert sum(x["doc_id"] == 0 for x in every) == 2 and sorted(x["section"] for x in every if x["doc_id"] is None) == [0, 1]
    assert attribution.section_tokens(df.limit(0), path).count() == 0
    got = [x for x in every if x["doc_id"] not in (0, None)] + [x for x in every if x["doc_id"] == 0][:1]
    for i, t in enumerate(texts):
        mine = sorted((x for x in got if x["doc_id"] == i), key=lambda x: x["section"])
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert sum(x["n_tokens"] for x in mine) == n == mine[0]["doc_tokens"]
        assert "".join((t or "")[x["char_start"] : x["char_end"]] for x in mine) == (t or "")
        assert all((t or "")[x["char_start"] : x["char_end"]].count("\n") <= 1 for x in mine)
    with pytest.raises(ValueError, match="rule"):
        attribution.section_tokens(df, path, rule="none")


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens_equal_the_librarys_offsets(spark, rule):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    r = random.Random(21)
    texts = ["".join(r.choice(("a", "é", "\n", "\n\n", " \n", "\n ", "word", " the", "漢", "\t")) for _ in range(r.randrange(40))) for _ in range(120)]
    got = {(x["doc_id"], x["section"]): (x["n_tokens"], x["n_crossing"]) for x in attribution.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, rule=rule).collect()}
    want = {}
    for i, t in enumerate(texts):
        lines = [x + "\n" for x in t.split("\n")[:-1]] + [x for x in t.split("\n")[-1:] if x] or [""]
        of = [k for k, line in enumerate(lines) for _ in line.encode()]  # the section of each byte
        for k in range(len(lines)):
            want[i, k] = [0, 0]
        at = 0
        for token in library.encode(t, add_special_tokens=False).tokens:
            held = of[at : at + len(token)]  # a byte-level token has one character for each byte
            at += len(token)
            to = held[0] if rule == "start" else max(sorted(set(held)), key=held.count)
            want[i, to][0] += 1
            want[i, to][1] += len(set(held)) > 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_frequent_words_are_the_most_frequent(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{chr(97 + min(r.randrange(26), r.randrange(26)))}" for _ in range(60)) for _ in range(40)] + [None, "", "ÉTÉ été 12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    count = collections.Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    for most in (0, 1, 5, 12, 100):
        got = codec.frequent_words(df, most)
        assert len(got) <= most and got == sorted(count, key=lambda w: (-count[w], w))[: len(got)]
    assert len(codec.frequent_words(df, 100)) == len(count) and len(codec.frequent_words(df, 12)) >= 10
    assert codec.frequent_words(df.limit(0), 5) == []
