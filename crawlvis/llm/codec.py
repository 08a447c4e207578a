"""Encoding whole texts to ids and back, through a lexicon of frequent words compiled to a transducer.

The lexicon holds the words that are most frequent in the corpus, counted over all texts, and the
vocabulary's own whole words. Words outside it are merged exactly. Lexicon or not, ids are the same.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.bpe import Vocabulary
from crawlvis.llm.store import dropped, written, written_bytes
from crawlvis.llm.transducer import Transducer, compile_words, packed


@lru_cache(maxsize=4)
def _mapped(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


def lexicon_words(vocabulary: Vocabulary, frequent: list[str] = ()) -> dict[bytes, list[int]]:
    """Words with their ids: the vocabulary's entries that are whole words and encode to themselves, and ``frequent`` ones."""
    from crawlvis.llm.bpe import byte_names

    bytes_of = {n: b for b, n in enumerate(byte_names())}
    special, cut = set(vocabulary.special.values()), -len("</w>")
    whole = [t[:cut] for i, t in enumerate(vocabulary.tokens) if t.endswith("</w>") and i not in special] if vocabulary.marked else [t for i, t in enumerate(vocabulary.tokens) if i not in special]
    words = []
    for token in whole:
        try:
            words.append(bytes(bytes_of[c] for c in token).decode())
        except (UnicodeDecodeError, KeyError):
            continue
    words = [w for w in dict.fromkeys([*words, *frequent]) if w and not w.isspace()]
    ids, count = vocabulary.merge(pa.array(words, type=pa.string()))
    return {w.encode(): part.tolist() for w, part in zip(words, np.split(ids, np.cumsum(count)[:-1]), strict=True)} if words else {}


def frequent_words(docs: DataFrame, most: int, *, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, in lower case, by frequency and then by word: ``most`` at most.

    Counted map-side first. Where to cut is told by a histogram of the logarithms of the counts, of some hundred rows, so
    that nothing but the words above comes together; words of the interval of counts that would go beyond ``most`` are left out.
    """
    word = F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("w")
    level = F.floor(F.log("n") * 64).cast("int").alias("level")
    counts = written(docs.select(word).where("w != ''").groupBy("w").agg(F.count("*").alias("n")).select("w", "n", level), "words")
    cut, total = None, 0
    for row in counts.groupBy("level").agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():
        total += row["c"]
        if total > most:
            break
        cut = row["level"]
    found = [] if cut is None else counts.where(F.col("level") >= cut).select("w", "n").collect()
    dropped(counts)
    return [r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))]


def lexicon_file(docs: DataFrame, vocabulary: Vocabulary, frequent: list[str] = ()) -> str:
    """Compiles the lexicon to a file in the shared folder, which every executor fetches once and maps, and gives its name there."""
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}"  # Spark refuses a file of a name that it has met
    spark.sparkContext.addFile(written_bytes(spark, name, packed(compile_words(lexicon_words(vocabulary, frequent)))))
    return name


def encoded(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = 0) -> DataFrame:
    """doc_id, ids and the text they decode to, for every row. Null text counts as empty: no ids, empty text.

    The decoded text is that of the vocabulary's library without a decoder: the tokens, joined by blanks.
    Repeated rows are encoded again, other columns ignored. A special token's string gives its own id.
    """
    return _encode(docs, vocabulary_path, id_col, text_col, frequent, digest=False)


def round_trip_digests(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encoded``, with digests taken where the ids are made."""
    return _encode(docs, vocabulary_path, id_col, text_col, frequent, digest=True)


def _encode(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, frequent: int, *, digest: bool) -> DataFrame:
    vocabulary = Vocabulary.read(vocabulary_path)
    name = lexicon_file(docs, vocabulary, frequent_words(docs, frequent, text_col=text_col) if frequent else ())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lexicon = shared.value, _mapped(name)
        shown = np.array(vocabulary.tokens, dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for ids in vocabulary.encode_all(texts, lexicon):
                text = " ".join(shown[ids].tolist())
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (ids.astype(np.int64), text))
            a, b, *c = zip(*rows, strict=True) if rows else ((), (), ())
            if digest:
                columns = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c[0], pa.string())]
            else:
                columns = [pa.array(list(a), pa.list_(pa.int64())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def decode(ids: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids → doc_id and the text as bytes decode to it, a blank at each word's end where those are marked."""
    shared = ids.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    kind = dict(ids.dtypes)["doc_id"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from crawlvis.llm.bpe import byte_names

        vocabulary = shared.value
        bytes_of = {n: bytes([b]) for b, n in enumerate(byte_names())}
        special = set(vocabulary.special.values())
        raw = [t.encode() if i in special else b"".join(bytes_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>") if vocabulary.marked else b"".join(bytes_of.get(c, b"") for c in t) for i, t in enumerate(vocabulary.tokens)]
        for batch in batches:
            out = [None if x is None else b"".join(raw[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")
