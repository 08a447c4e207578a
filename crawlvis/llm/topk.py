"""Exact top-k search by columnar branch and bound.

Queries and candidates are dealt into a grid of blocks. In a cell, components lie dimension by dimension, those of most mass
first; scores accumulate over blocks of dimensions. After each block a candidate stays only for queries of which its partial
score and the most that the remaining dimensions can add (the product of the remaining norms) reach the k-th best score
known. Queries that point the same way are taken together, and candidates that none of them needs are compacted away; once
few are left to each query, every query goes on with its own. Each query's k-th best score in a first cell is carried to all
others. How much the bounds save depends on the vectors: where mass lies in few dimensions, nearly all; where all dimensions
weigh the same, little before the last ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.llm.store import written

#: Rows of a grid cell: queries and candidates, about.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Queries that share one set of survivors, and dimensions that are added at a step.
TOGETHER, STEP = 64, 8
#: Part of the candidates below which survivors are compacted, and below which each query goes on with its own.
COMPACT, ALONE = 0.8, 0.2
#: Vectors shorter than this have inner products that 64-bit floats hold exactly.
EXACT = 2.0**26


def quantized(vectors: DataFrame, scale: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: floor(scale * component) of each vector. Vectors that are null or have a null, NaN or infinite component go, as do null ids."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _bounded(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray, seen: list | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and places and scores of its best candidates. seen: gets the dimensions added and the share of pairs that are left, at each step."""
    dims = np.argsort(-np.abs(c).sum(axis=0) * np.abs(q).sum(axis=0), kind="stable")
    columns, q = np.ascontiguousarray(c.T[dims]), q[:, dims]
    d = len(dims)
    cuts = [*range(0, d, STEP), d] if d else [0]
    rest = lambda a: np.sqrt(np.maximum(np.cumsum((a * a)[::-1], axis=0)[::-1], 0))  # noqa: E731  norms of the dimensions from each on
    left_c, left_q = np.vstack([rest(columns), np.zeros(len(cid))]), np.vstack([rest(q.T), np.zeros(len(qid))])
    strong = np.argsort(-left_c[0], kind="stable")[: 8 * k]
    alike = np.lexsort([q[:, j] > 0 for j in range(min(d, 8))][::-1]) if d else np.arange(len(qid))
    for at in range(0, len(qid), TOGETHER):
        group = alike[at : at + TOGETHER]
        some, ids = q[group], qid[group]
        least = floor[group].copy()
        known = some @ columns[:, strong]
        known[ids[:, None] == cid[strong][None, :]] = -np.inf
        if known.shape[1] >= k:
            least = np.maximum(least, np.partition(known, known.shape[1] - k, axis=1)[:, -k])
        edge = least - 1e-6 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        alive, held, score, mask = np.arange(len(cid)), columns, np.zeros((len(group), len(cid))), None
        b = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            score += some[:, a:b] @ held[a:b]
            mask = score + left_q[b, group, None] * left_c[b, alive][None, :] >= edge[:, None]
            keep = mask.any(axis=0)
            share = mask.sum() / max(1, len(group) * len(cid))
            if seen is not None:
                seen.append((b, share))
            if b < d and keep.mean() < COMPACT:
                alive, held, score, mask = alive[keep], held[:, keep], score[:, keep], mask[:, keep]
            if share < ALONE:
                break
        for i, number in enumerate(group):
            place = np.flatnonzero(mask[i]) if mask is not None else np.arange(len(alive))
            mine = score[i, place]
            for a, e in zip(cuts[cuts.index(b) :], cuts[cuts.index(b) + 1 :], strict=False):
                mine = mine + some[i, a:e] @ held[a:e, place]
                good = mine + left_q[e, number] * left_c[e, alive[place]] >= edge[i]
                place, mine = place[good], mine[good]
            other = cid[alive[place]] != ids[i]
            place, mine = alive[place[other]], mine[other]
            best = _best(cid[place], mine, k)
            yield int(number), place[best], mine[best]


def _exact(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``_bounded``, in whole numbers of any size. Scores beyond 64 bits count as the nearest number of 64 bits."""
    bound = max((int(np.abs(x).max(initial=0)) for x in (q, c)), default=0) ** 2 * max(1, q.shape[1])
    kind = np.int64 if bound < 2**63 and np.abs(q).max(initial=0) < 2**62 and np.abs(c).max(initial=0) < 2**62 else object
    wide = c.astype(kind)
    for i in range(len(qid)):
        score = wide @ q[i].astype(kind)
        if kind is object:
            score = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in score.tolist()], dtype=np.int64)
        place = np.flatnonzero(cid != qid[i])
        best = place[np.lexsort((cid[place], -np.maximum(score[place], -(2**63) + 1)))[:k]]
        yield i, best, score[best]


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query by inner product of whole numbers, ties to the smaller id, never one of the query's own id.

    Each row is a candidate, also where its id repeats. Queries of an id that repeats are one query, whose score with a
    candidate is the largest. floor: scores, by query row, that k other candidates are known to reach.
    """
    qid, q, cid, c = np.asarray(qid), np.asarray(q, dtype=np.int64), np.asarray(cid), np.asarray(c, dtype=np.int64)
    floor = np.full(len(qid), -np.inf) if floor is None else floor
    norm = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))
    small_q, small_c = norm(q) < EXACT, norm(c) < EXACT
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for rows, others, search in ((small_q, small_c, _bounded), (small_q, ~small_c, _exact), (~small_q, np.ones(len(cid), dtype=bool), _exact)):
        if not rows.any() or not others.any():
            continue
        number, place = np.flatnonzero(rows), np.flatnonzero(others)
        if search is _bounded:
            # The floor holds for the best of all candidates, so it holds for these too: what lies below it is not among the k best.
            results = _bounded(qid[rows], q[rows].astype(np.float64), cid[others], c[others].astype(np.float64), k, floor[rows], seen)
        else:
            results = _exact(qid[rows], q[rows], cid[others], c[others], k)
        for i, some, score in results:
            found.setdefault(int(qid[number[i]]), []).append((place[some], score.astype(np.int64)))
    out = []
    for own in sorted(found):
        parts = found[own]
        place, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:  # the same candidate for queries of one id: its best score counts
            order = np.lexsort((-np.maximum(score, -(2**63) + 1), place))
            place, score = place[order], score[order]
            first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=bool)
            place, score = place[first], score[first]
            best = np.lexsort((cid[place], -np.maximum(score, -(2**63) + 1)))[:k]
            place, score = place[best], score[best]
        out.append((np.full(len(place), own), cid[place], score))
    if not out:
        return qid[:0], cid[:0], np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for tables of ``id`` and whole-number vectors ``v``.

    Vectors of another length than the query's are not its candidates. A query has fewer than k rows if it has fewer
    candidates, and none if it has none; either table may be empty. Each row of an id that repeats is a candidate of its
    own, but none of that id's query; queries of one id are one, whose score with a candidate is the largest. Scores are
    exact; one that 64 bits can't hold counts as the nearest number that they can.
    """
    n_queries, n = queries.count(), candidates.count()
    across, down = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    size = F.size("v").alias("d")
    left = queries.select("id", "v", size, block(across).alias("a"))
    right = candidates.select("id", "v", size, block(down).alias("b"))
    first = F.pmod("a", F.lit(down)).cast("int")  # a cell of each block of queries, whose scores are carried to the others
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return t["id"].to_numpy(), flat.reshape(len(t), -1) if len(flat) else np.zeros((len(t), 0), dtype=np.int64)

        if not len(a) or not len(b):
            return schema.empty_table()
        (qid, q), (cid, c) = matrix(a), matrix(b)
        found = search_block(qid, q, cid, c, k, a["least"].to_numpy(zero_copy_only=False).astype(np.float64) if "least" in a.column_names else None)
        return pa.table([pa.array(x.astype(np.int64)) for x in found], schema=schema)

    def searched(some: DataFrame, others: DataFrame) -> DataFrame:
        keys = ("a", "b", "d")
        return some.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    dealt = right.select("*", every(across).alias("a"))
    found = searched(left.withColumn("b", first), dealt.where(F.col("b") == first))
    if down > 1:
        found = written(found, "seeds")
        # The k-th best score of a query that repeats holds for its rows together only, so they get none.
        floor = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"), F.count("*").alias("n"))
        once = queries.groupBy("id").agg(F.count("*").alias("times")).where("times = 1")
        floor = floor.join(once.select(F.col("id").alias("own")), F.col("query_id") == F.col("own")).select("own", "least")
        rest = left.join(floor, F.col("id") == F.col("own"), "left").select(F.col("id").alias("id"), F.col("v").alias("v"), "d", "a", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"), every(down).alias("b"))
        found = found.union(searched(rest.where(F.col("b") != first), dealt.where(F.col("b") != first)))
    return ranked(found)
