"""Best-fit packing of token pieces into sequences of a fixed capacity, by exact-complement hashing.

Only how many pieces there are of each length matters for the plan, and there are at most
``capacity`` lengths: the plan is made on the driver from that bounded histogram, whatever the
number of documents. The sums of one, two and three lengths are indexed once, by sum
(``Combinations``). For each length, longest first, the remaining gap is looked up there: a single
length first, then pairs, then triples; those that fill it exactly are consumed as often as the
counts allow. What is left is packed best-fit decreasing,
all pieces of a length at a time. Pieces are then numbered within their length, in salted groups
so that a common length is spread over many tasks, and the plan's intervals give each its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.llm.bpe import Vocabulary
from crawlvis.llm.store import written

#: Pieces of one length and salt that one task numbers, about.
PIECES_PER_SALT = 2_000_000
LEAST_SALTS = 256


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document's ids are those of its whole text (null: empty) and then ``end_id``. Only documents of
    more than ``capacity`` ids are cut, from the end, so that at most the first piece is shorter.
    A repeated row gives its pieces again; a null id stays null; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, end = shared.value, np.array([end_id], dtype="<u4")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            of, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(vocabulary.encode_all(texts)):
                ids = np.concatenate((ids.astype("<u4", copy=False), end))
                first = len(ids) % capacity or capacity
                for k, at in enumerate(range(first - capacity, len(ids), capacity)):
                    part = ids[max(at, 0) : at + capacity]
                    of.append(row)
                    piece.append(k)
                    start.append(max(at, 0))
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int64))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int64()))] if with_ids else columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


@dataclass
class Plan:
    """Which lengths share sequences: ``lengths``, longest first, in ``times`` sequences from number ``base``."""

    patterns: list[tuple[tuple[int, ...], int]]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by length and first rank: the length, first rank, first sequence and offset of each interval."""
        rows, used, base = [], {}, 0
        for lengths, times in self.patterns:
            offset = 0
            for n in lengths:
                rows.append((n, used.get(n, 0), base, offset))
                used[n] = used.get(n, 0) + times
                offset += n
            base += times
        rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return tuple(rows.T)

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)


class Combinations:
    """Sums of one, two and three of the available lengths, hashed by sum, under availability counts.

    The index is built once from the lengths that occur. For each sum up to the capacity it lists the pairs (high, low),
    and the triples as (length, sum of a pair), the largest length first. Counts only ever fall, so an entry whose lengths
    have run out is passed over for good. It takes about two entries of four bytes for each two of the capacity's lengths.
    """

    def __init__(self, free: np.ndarray):
        self.free, self.capacity = free, len(free) - 1
        lengths = np.flatnonzero(free)
        self.high, self.pair_ends = self._hashed(lengths, lengths, both=False)
        sums = np.flatnonzero(np.diff(self.pair_ends))  # that some pair has
        self.first, self.triple_ends = self._hashed(lengths, sums, both=True)
        self.pair_at, self.triple_at = self.pair_ends[:-1].copy(), self.triple_ends[:-1].copy()

    def _hashed(self, a: np.ndarray, b: np.ndarray, *, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """The larger part ``a`` of each sum with a part of ``b``, by sum and then downwards, and where each sum's entries begin."""
        parts, counts = [], np.zeros(self.capacity + 1, dtype=np.int64)
        for x in a[::-1]:
            sums = x + (b[b <= self.capacity - x] if both else b[b <= min(x, self.capacity - x)])
            parts.append((np.full(len(sums), x, dtype=np.int32), sums.astype(np.int32)))
            counts[sums] += 1
        if not parts:
            return np.zeros(0, dtype=np.int32), np.zeros(self.capacity + 2, dtype=np.int64)
        larger, total = (np.concatenate(c) for c in zip(*parts, strict=True))
        return larger[np.argsort(total, kind="stable")], np.concatenate(([0], np.cumsum(counts)))

    def has(self, *lengths: int) -> bool:
        return all(self.free[n] >= lengths.count(n) for n in lengths)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.free[total] > 0 else None

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The pair of that sum with the largest length, while the lengths ``beside`` are taken too."""
        for i in range(self.pair_at[total], self.pair_ends[total + 1]):
            high = int(self.high[i])
            if self.has(high, total - high, *beside):
                return high, total - high
            if not self.has(high, total - high) and i == self.pair_at[total]:
                self.pair_at[total] += 1
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        while (i := self.triple_at[total]) < self.triple_ends[total + 1]:
            first = int(self.first[i])
            if self.free[first] > 0 and (rest := self.pair(total - first, (first,))):
                return (first, *rest)
            self.triple_at[total] += 1
        return None

    def filling(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to ``total``."""
        return self.single(total) or self.pair(total) or self.triple(total)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Packs pieces given as counts by length into few sequences. The result depends on the counts alone."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    patterns, residue, index = [], {}, Combinations(free)
    for length in range(capacity, 0, -1):
        while free[length] > 0:
            gap = capacity - length
            free[length] -= 1
            filling = index.filling(gap) if gap else ()
            free[length] += 1
            if filling is None:
                residue[length] = int(free[length])
                free[length] = 0
                break
            pattern = (length, *filling)
            times = min(int(free[n]) // pattern.count(n) for n in set(pattern))
            for n in pattern:
                free[n] -= times
            patterns.append((pattern, times))
    return Plan(patterns + _best_fit(residue, capacity))


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: open sequences of equal content are kept as one group."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # by gap

    def put(pattern: tuple[int, ...], times: int) -> None:
        group = groups.setdefault(capacity - sum(pattern), {})
        group[pattern] = group.get(pattern, 0) + times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            gap = min((g for g in groups if g >= length and groups[g]), default=None)
            if gap is None:
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            pattern, times = groups[gap].popitem()
            use = min(n, times)
            if times > use:
                groups[gap][pattern] = times - use
            put((*pattern, length), use)
            n -= use
    return [(pattern, times) for group in groups.values() for pattern, times in group.items()]


def pack(pieces: DataFrame, capacity: int = 2048, *, order_by: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece, of ``length`` 1 to ``capacity``, lies.

    Every piece has one place, offsets in a sequence are gapless from 0, and rows that are alike get
    different places. ``order_by`` must tell apart all rows but those that are alike.
    An empty table gives an empty result; a null or impossible length raises an error.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    row = pieces.select(
        F.struct(*columns).alias("row"),
        F.when(F.col("length").between(1, capacity), F.col("length").cast("int")).otherwise(F.raise_error(F.lit("a piece's length is not between 1 and the capacity")).cast("int")).alias("n"),
        F.struct(*[F.col(c) for c in order_by]).alias("by"),
    )
    hashed = F.xxhash64(*[F.col(f"by.{c}") for c in order_by])
    fine = row.groupBy("n").agg(F.count("*").alias("c"))
    counts = {r["n"]: r["c"] for r in fine.collect()}  # at most ``capacity`` rows
    made = plan(counts, capacity)
    salts = max(LEAST_SALTS, max(counts.values(), default=0) // PIECES_PER_SALT)
    salted = row.withColumn("salt", F.pmod(hashed, F.lit(salts)).cast("int"))
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("n", "salt").agg(F.count("*").alias("c")).select("n", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("n", "salt").orderBy("by"))
    ranked = salted.withColumn("k", within).join(bases, ["n", "salt"]).select("row", "n", (F.col("base") + F.col("k") - 1).alias("rank"))
    places = spark.sparkContext.broadcast(made.places())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = places.value
        keys = length << 40 | first
        for batch in batches:
            rank = batch.column(2).to_numpy()
            at = np.searchsorted(keys, batch.column(1).to_numpy().astype(np.int64) << 40 | rank, side="right") - 1
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*columns, "sequence_id", "offset"])

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return pack(written(token_pieces(docs, vocabulary_path, capacity), "pieces"), capacity)
