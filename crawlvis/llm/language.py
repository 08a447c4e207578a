"""Language identification by word-first backoff.

A word known from the training rows scores its log frequency in each language. An unseen word falls
back to its character n-grams, with a mark at either end: the longest length of which any n-gram is
known gives the mean of their log frequencies, and shorter ones are tried in turn. A text's language
is the one with the largest sum over all of its words. That sum tells languages apart, but grows with
the text whatever the language; whether a text is in a language at all is told by the share of its
words that the model knows in it, against the share that new texts of the language are expected to have.

The model is fit on a bounded sample of the labelled rows: ``MAX_ROWS_PER_LANGUAGE`` of each language, so a rare one keeps
all of its rows at every size. It holds every word and n-gram of the sample, as sorted 64-bit hashes with an entry for
each language that has it, so its size follows the sample and not the square of the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.scan import LETTER, ranges, scans
from crawlvis.llm.store import new_path

#: About how many labelled rows of a language the model is fit on: they are taken by a hash of their id, so the sample is the same each time.
MAX_ROWS_PER_LANGUAGE = 5_000
LENGTHS = (5, 4, 3, 2, 1)
#: Files that a model is dealt over, and rows that are judged together.
FILES, ROWS = 8, 500
#: Log frequency of what a language lacks while another has it.
MISSING = 0.5
MIN_SCORE = 0.5
#: Part of a language's expected share of known words that a text must reach to be kept.
MIN_KNOWN = 0.5
UNKNOWN = "und"
#: The seed with which Spark's own hash of a string is the same number.
SEED = 42


def held_out(id_col: str) -> Column:
    """Rows that no model learns from; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def hashed(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in strings), dtype=np.uint64, count=len(strings))


@dataclass
class Lexicon:
    """Strings by hash: the languages that have them and by how much their log frequency there is above ``base``, that of what a language lacks."""

    keys: np.ndarray  # sorted
    starts: np.ndarray  # of each key's entries, and the end
    langs: np.ndarray
    above: np.ndarray
    base: np.ndarray  # by language

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> Lexicon:
        order = np.lexsort((langs, hashes))
        hashes, langs, counts = hashes[order], langs[order], counts[order].astype(np.float64)
        keys, first = np.unique(hashes, return_index=True)
        totals = np.bincount(langs, weights=counts, minlength=n_langs)[:n_langs]
        return cls(keys, np.append(first, len(hashes)), langs.astype(np.int32), np.log(counts / MISSING), np.log(MISSING) - np.log(totals + 1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each string; -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def entries(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For known strings by number: which of them, the language, and how much above the base."""
        size = self.starts[found + 1] - self.starts[found]
        at = ranges(self.starts[found], size)
        return np.repeat(np.arange(len(found)), size), self.langs[at], self.above[at]


@dataclass
class Model:
    """The words, the n-grams by length, and the share of known words, by language, that new texts of it should have."""

    languages: list[str]
    words: Lexicon
    grams: dict[int, Lexicon]
    expected: np.ndarray

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words: the level that knows each (0 the words, then the lengths of n-grams in turn, last none), and, word for word,
        entries: the word, the language, how much its score is above the level's base."""
        found = self.words.find(hashed(words))
        level = np.where(found >= 0, 0, len(LENGTHS) + 1)
        known = np.flatnonzero(found >= 0)
        of, lang, above = self.words.entries(found[known])
        parts = [(known[of], lang, above)]
        left = np.flatnonzero(found < 0)
        for k, n in enumerate(LENGTHS, 1):
            if not len(left):
                break
            pieces, owner = [], []
            for i in left.tolist():
                marked = f"\x02{words[i]}\x03"
                some = [marked[j : j + n] for j in range(len(marked) - n + 1)]
                pieces += some
                owner.append(len(some))
            gram = self.grams[n].find(hashed(pieces))
            owner = np.repeat(left, owner)[gram >= 0]
            count = np.bincount(owner, minlength=len(words))
            of, lang, above = self.grams[n].entries(gram[gram >= 0])
            parts.append((owner[of], lang, above / count[owner[of]]))  # the mean of the known n-grams
            level[np.unique(owner)] = k
            left = left[count[left] == 0]
        of, lang, above = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(of, kind="stable")
        return level, of[order], lang[order], above[order]

    def bases(self) -> np.ndarray:
        return np.vstack([self.words.base, *(self.grams[n].base for n in LENGTHS), np.zeros(len(self.languages))])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language and the share of it in the posterior over languages, for each whole text; ``und`` and 0 without letters."""
        return [(lang, score) for lang, score, _ in self.judged(texts)]

    def judged(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """As ``predict``, and whether the text is in the language: any of its words or n-grams is known, and of its words
        no less than ``MIN_KNOWN`` of the expected share, less a standard error, which matters in short texts."""
        out, n_langs = [], len(self.languages)
        for begin, end, scan in scans([t.lower() for t in texts]):
            n = end - begin
            if not n_langs:
                out += [(UNKNOWN, 0.0, False)] * n
                continue
            start, _ = scan.runs()
            cuts = np.concatenate((np.flatnonzero(start), [len(scan.points)]))
            totals = np.zeros((n, n_langs))
            count, known, seen = (np.zeros(n, dtype=np.int64) for _ in range(3))
            if len(cuts) > 1:
                pieces = scan.strings(cuts).dictionary_encode()
                lettered = scan.kinds[cuts[:-1]] == LETTER
                used, chosen = np.unique(pieces.indices.to_numpy()[lettered], return_inverse=True)
                level, of, lang, above = self.scores(pieces.dictionary.take(pa.array(used)).to_pylist())
                owner = np.searchsorted(scan.starts, cuts[:-1][lettered], side="right") - 1
                # How often each text has each word, and its entries.
                pair, times = np.unique(owner * len(used) + chosen, return_counts=True)
                text, word = np.divmod(pair, max(len(used), 1))
                np.add.at(totals, text, times[:, None] * self.bases()[level[word]])
                first = np.searchsorted(of, np.arange(len(used) + 1))
                size = np.diff(first)[word]
                at, of_text, of_times = ranges(first[word], size), np.repeat(text, size), np.repeat(times, size)
                totals += np.bincount(of_text * n_langs + lang[at], weights=of_times * above[at], minlength=n * n_langs).reshape(n, n_langs)
                count = np.bincount(owner, minlength=n)
                seen = np.bincount(text, weights=times * (level[word] <= len(LENGTHS)), minlength=n)
                whole = (np.repeat(level[word], size) == 0) & (lang[at] == totals.argmax(axis=1)[of_text])
                known = np.bincount(of_text, weights=of_times * whole, minlength=n)
            best = totals.argmax(axis=1)
            some = np.maximum(count, 1)
            fits = (seen > 0) & (known / some + 0.5 / np.sqrt(some) >= MIN_KNOWN * self.expected[best])
            share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            out += [(self.languages[b], float(s), bool(f)) if c else (UNKNOWN, 0.0, False) for b, s, c, f in zip(best, share, count, fits, strict=True)]
        return out


def training_sample(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", max_rows: int = MAX_ROWS_PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """The labelled rows that aren't held out, about ``max_rows`` of each language by a hash of their id, and the languages in order."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.coalesce(~held_out(id_col), F.lit(False)))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    some = [x for lang, n in sorted(rows.items()) if n > max_rows for x in (F.lit(lang), F.lit(max_rows / n))]
    share = F.coalesce(F.element_at(F.create_map(*some), F.col(lang_col)), F.lit(1.0)) if some else F.lit(1.0)
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)), sorted(rows)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS_PER_LANGUAGE) -> Fitted:
    """A model from text and language of labelled rows that aren't held out: of rows with a null id none.

    Words and n-grams are counted by Spark, which combines the counts of a task before they are dealt by language and
    string; hash, language and count of each go to files, dealt by hash, that tasks write and workers read. Rows that repeat count again. Without labelled rows,
    or with empty texts alone, there are no languages.
    """
    sample, languages = training_sample(docs, id_col=id_col, lang_col=lang_col, max_rows=max_rows)
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang_col)) - 1 if languages else F.lit(0)
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))
    words = sample.select(place.cast("int").alias("lang"), word.alias("w")).where("w != ''").groupBy("lang", "w").agg(F.count("*").alias("c"))
    marked = F.concat(F.lit("\x02"), "w", F.lit("\x03"))

    def of_length(n: int) -> Column:  # a lambda with a second parameter would be given the place there
        return F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))

    grams = F.flatten(F.array(*[F.when(F.length(marked) >= n, of_length(n)).otherwise(F.array().cast("array<string>")) for n in LENGTHS]))
    counted = words.select("lang", "c", F.explode(grams).alias("w")).where(~F.col("w").isin("\x02", "\x03")).groupBy("lang", "w").agg(F.sum("c").alias("c"))  # every word has both marks

    entry = lambda table, n: table.select(n.cast("int").alias("n"), F.xxhash64("w").alias("h"), "lang", "c")
    entries = entry(words, F.lit(0)).unionByName(entry(counted, F.length("w")))
    path = new_path(docs.sparkSession, "language")
    entries.repartitionByRange(FILES, "n", "h").write.parquet(path)
    files = sorted(docs.sparkSession.read.parquet(path).inputFiles())
    for file in files:
        docs.sparkSession.sparkContext.addFile(file)
    return Fitted(tuple(f.rsplit("/", 1)[1] for f in files), tuple(languages))


@dataclass(frozen=True)
class Fitted:
    """A model in files of the shared folder, which every executor fetches once: tasks wrote them, and the driver has only their names."""

    files: tuple[str, ...]
    labelled: tuple[str, ...]

    def load(self) -> Model:
        return _loaded(self.files, self.labelled)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        return self.load().predict(texts)

    @property
    def languages(self) -> list[str]:
        return self.load().languages

    @property
    def grams(self) -> dict[int, Lexicon]:
        return self.load().grams


@lru_cache(maxsize=1)
def _loaded(files: tuple[str, ...], labelled: tuple[str, ...]) -> Model:
    """The model of a process's own, read from the files that its executor fetched."""
    columns: dict[str, list[np.ndarray]] = {name: [np.zeros(0, dtype=kind)] for name, kind in (("n", np.int8), ("h", np.int64), ("lang", np.int32), ("c", np.int64))}
    for file in files:
        table = pq.read_table(SparkFiles.get(file), partitioning=None, memory_map=True)
        for name, parts in columns.items():
            parts.append(table[name].to_numpy().astype(parts[0].dtype))
        del table
    n, h, lang, c = (np.concatenate(parts) for parts in columns.values())
    del columns
    pa.default_memory_pool().release_unused()
    # A language of empty texts alone is none.
    there = np.unique(lang)
    names, n_langs = [labelled[i] for i in there], len(there)
    lang = np.searchsorted(there, lang)
    # As many of a new text's words are unknown as words that occur once are of the sample's.
    word = n == 0
    totals = np.bincount(lang[word], weights=c[word], minlength=n_langs)
    again = np.bincount(lang[word], weights=c[word] * (c[word] > 1), minlength=n_langs)
    lexicon = lambda some: Lexicon.of(h[some].view(np.uint64), lang[some], c[some], n_langs)
    return Model(names, lexicon(word), {k: lexicon(n == k) for k in LENGTHS}, again / np.maximum(totals, 1))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``ROWS``, so that few texts at a time are also Python's own."""
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            yield batch.slice(begin, ROWS)


def predictions(docs: DataFrame, model: Fitted, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is any text if the model knows no language.
    Equal languages go to the first by name. Rows that repeat are predicted again.
    """
    kind = dict(docs.dtypes)[id_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score = zip(*model.load().predict([t or "" for t in batch.column(1).to_pylist()]), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def kept_documents(docs: DataFrame, model: Fitted, *, text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the model, with a score of at least ``least``.

    Null and empty texts go; rows that repeat stay or go together, and all columns stay as they are.
    """
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = model.load().judged([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([fits and score >= least for _, score, fits in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model fit on the rows that aren't held out.

    A null id is not held out, and no model learns from its row. A null text, or one without a letter, is ``und`` with
    score 0, as is every text if no row is labelled. Rows that repeat are predicted again, an empty table gives an empty
    result, and other columns are ignored whatever their names.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predictions(docs, model, id_col=id_col, text_col=text_col).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
