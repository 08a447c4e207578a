"""Token counts by section from one encoding of each whole document: offset-mapped attribution.

A document is encoded once. Its tokens' byte spans are joined with the spans of its sections; a
token that crosses a boundary is allotted by an explicit rule:

* ``majority``: to the section that holds most of its bytes, the earlier one if they hold as many;
* ``start``: to the section that holds its first byte.

So the counts of a document's sections add up to the tokens of the document, which separate
encodings of the sections would not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.bpe import Vocabulary
from crawlvis.llm.scan import ranges

RULES = ("majority", "start")


def attribute(starts: np.ndarray, widths: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For tokens of ``widths`` bytes end to end and sections beginning at ``starts`` (the first at 0): tokens of each section, and how many of them cross a boundary."""
    n = len(starts)
    end = np.cumsum(widths)
    begin = end - widths
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.maximum(np.searchsorted(starts, end, side="left") - 1, first)
    to, crossing = first.copy(), np.flatnonzero(last > first)
    if rule == "majority":
        # A row for each section that a crossing token touches: the most bytes win, then the earlier section.
        touched = last[crossing] - first[crossing] + 1
        token, section = np.repeat(crossing, touched), ranges(first[crossing], touched)
        shared = np.minimum(end[token], np.append(starts[1:], end[-1:])[section]) - np.maximum(begin[token], starts[section])
        order = np.lexsort((section, -shared, token))
        to[crossing] = section[order][np.cumsum(touched) - touched]
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def section_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority") -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing, doc_tokens.

    Sections are the lines of the text, each with its line feed, so they cover it. A null or empty text has
    one empty section without tokens; an empty table gives an empty result. Rows that repeat give their sections again, a
    null id stays null, other columns are ignored whatever their names. A special token's own string in a text counts as that token.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    if shared.value.marked:
        raise ValueError("a vocabulary that keeps every byte is needed")
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            of, parts = [], []
            for row, ids in enumerate(vocabulary.encode_all(texts)):
                text = texts[row]
                lines = text.splitlines(keepends=True) if text.isascii() and not any(c in text for c in "\r\x0b\x0c\x1c\x1d\x1e") else [x + "\n" for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
                chars = np.cumsum([0, *map(len, lines)]) if lines else np.array([0, 0])
                starts = chars[:-1] if text.isascii() else np.cumsum([0, *(len(x.encode()) for x in lines)])[:-1]
                tokens, crossing = attribute(starts, vocabulary.widths[ids], rule)
                n = len(starts)
                of.append(np.full(n, row))
                parts.append((np.arange(n), chars[:-1], chars[1:], tokens, crossing, np.full(n, len(ids))))
            if of:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                columns[0] = columns[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(of))), *columns], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    schema = f"doc_id {kind}, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
