"""N-gram Jaccard join of documents by a MinHash LSH forest with exact verification.

Equal texts form classes first. Each class's text has a MinHash signature of several levels in each of
several trees; a tree's trie is its signatures in sorted order, where texts that share a prefix stand
side by side and the levels that neighbours share are read off. One pass over the tries emits, for every
depth, a forest of edges between texts that share a prefix of that depth and whose sketches (a bit of
each level) don't rule the similarity out, so chance companions don't chain. The same pass measures how
many links a depth misses: a pair of similarity s shares a prefix of depth d in T s^d of T trees, so each
pair that is met stands for 1 / (T s^d) pairs, of which (1 - s^d)^T are met in no tree. The matched prefix
starts at its full depth and is shortened until the recall measured so reaches ``RECALL``. Texts that
these edges connect are candidate families; in a family pairs are verified on whole shingle sets, in
blocks of bounded size, so a family of any size is dealt over many tasks and no pair leaves a task: only
counts of links and a forest of edges do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.components import components
from crawlvis.llm.scan import ranges, scans
from crawlvis.llm.store import dropped, written

WORDS, SIMILARITY = 5, 0.8
#: Trees (a multiple of 8), levels of a tree's signature, the shortest prefix that may be matched, and the recall to reach.
TREES, LEVELS, LEAST_DEPTH, RECALL = 32, 8, 4, 0.9999
#: Longer runs of a shared prefix are connected without a look at their sketches.
RUN = 256
#: Standard errors by which a sketch's estimate may fall short of the similarity.
SLACK = 6
#: Texts of a family that one task holds of either side.
BLOCK = 256
#: Shingles that a verification spreads out at once.
SPREAD = 8192
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For some texts at a time: their range, 64-bit hashes of all shingles in order, and where each text's begin (and end).

    A shingle is ``words`` words in a row, in lower case, without what stands between them; a text of fewer words has one
    of all its words, and a text without words none.
    """
    for begin, end, scan in scans([t.lower() for t in texts]):
        cuts, is_word = scan.word_cuts()
        if not is_word.any():
            yield begin, end, np.zeros(0, dtype=np.uint64), np.zeros(end - begin + 1, dtype=np.int64)
            continue
        pieces = scan.strings(cuts).dictionary_encode()
        codes = pieces.indices.to_numpy()[is_word]
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces.dictionary.to_pylist()), dtype=np.uint64, count=len(pieces.dictionary))
        hashed = table[codes]
        first = np.searchsorted(cuts[:-1][is_word], scan.starts)
        count = np.diff(first)
        owner = np.repeat(np.arange(end - begin), count)
        place = np.arange(len(hashed)) - first[owner]
        left = count[owner] - place  # words from here on
        opens = (left >= words) | (place == 0)
        total = np.zeros(len(hashed), dtype=np.uint64)
        for k in range(words):
            part = np.zeros_like(total)
            part[: max(len(hashed) - k, 0)] = hashed[k:]
            total = total * ODD + np.where(left > k, part, np.uint64(k))
        yield begin, end, mixed(total[opens]), np.concatenate(([0], np.cumsum(np.bincount(owner[opens], minlength=end - begin))))


def signatures(hashes: np.ndarray, starts: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each tree, texts by two numbers a tree (a level has 16 bits), and the sketch, texts by numbers of 64 bits.

    Texts without shingles must not be asked for.
    """
    random = np.random.default_rng(20240607)
    n = trees * LEVELS
    turn, step = random.integers(0, 2**63, n, dtype=np.uint64), random.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1)
    keys, bits = np.zeros((len(starts), trees * 2), dtype=np.uint64), np.zeros((len(starts), n), dtype=bool)
    room = np.empty_like(hashes)
    for k in range(n):
        np.bitwise_xor(hashes, turn[k], out=room)
        np.multiply(room, step[k], out=room)
        level = mixed(np.minimum.reduceat(room, starts))
        bits[:, k] = level & np.uint64(1)
        keys[:, k // 4] |= (level >> np.uint64(48)) << np.uint64(48 - 16 * (k % 4))
    return keys, np.packbits(bits, axis=1).view(np.uint64).reshape(len(starts), n // 64)


def _signed(batches: Iterator[pa.RecordBatch], words: int, trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = [t or "" for t in batch.column(2).to_pylist()], []
        for begin, end, hashes, bounds in shingle_hashes(texts, words):
            full = np.flatnonzero(np.diff(bounds) > 0)
            width = trees * 2 + trees * LEVELS // 64
            rows = np.hstack(signatures(hashes, bounds[:-1][full], trees)).view(np.int64) if len(full) else np.zeros((0, width), dtype=np.int64)
            ends = np.zeros(end - begin + 1, dtype=np.int32)
            ends[1:][full] = width
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(rows.ravel())))
        signed = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], names=["node", "rank", "signature"])


def estimates(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The similarity of pairs by their sketches, of which a pair of similarity s shares (1 + s) / 2 of the bits."""
    apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
    return 1 - 2 * apart / (64 * sketches.shape[1])


class Trie:
    """Reads the sorted signatures of a task: edges by depth, what its outer runs have in common with other tasks', and its share of the measure.

    A run is texts in a row that share ``LEAST_DEPTH`` levels. In a short run all pairs' sketches are compared. Long runs and
    the first and last of a task are connected as they are, each text to the first that shares as many levels with it.
    """

    def __init__(self, similarity: float, trees: int):
        self.similarity, self.trees = similarity, trees
        self.depths = np.arange(LEAST_DEPTH, LEVELS + 1)
        agree = (1 + similarity) / 2
        self.error = 2 * np.sqrt(agree * (1 - agree) / (trees * LEVELS))
        self.met, self.missed = np.zeros(len(self.depths)), np.zeros(len(self.depths))
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # depth, and the nodes, as numbers in the pool

    def measure(self, estimate: np.ndarray, depth: np.ndarray) -> None:
        near = estimate >= self.similarity - self.error
        s, depth = np.maximum(estimate[near], self.similarity), depth[near]
        for k, d in enumerate(self.depths):
            share = s[depth >= d] ** d
            each = 1 / (self.trees * share)
            self.met[k] += each.sum()
            self.missed[k] += (each * (1 - share) ** self.trees).sum()

    def pairs(self, shared: np.ndarray, begin: np.ndarray, end: np.ndarray, sketches: np.ndarray) -> None:
        """Edges of the short runs between ``begin`` and ``end``; shared: the levels that each row shares with the row before."""
        some = end - begin > 1
        begin, size = begin[some], (end - begin)[some]
        last, i = np.repeat(begin + size, size), ranges(begin, size)
        depth, found = np.full(len(i), LEVELS), []
        for step in range(1, int(size.max(initial=0))):
            go = i + step < last
            i, depth, last = i[go], np.minimum(depth[go], shared[i[go] + step]), last[go]
            estimate = estimates(sketches, i, i + step)
            self.measure(estimate, depth)
            good = estimate >= self.similarity - SLACK * self.error
            found.append((i[good], i[good] + step, depth[good]))
        if not found:
            return
        a, b, depth = (np.concatenate(x) for x in zip(*found, strict=True))
        label = np.arange(len(shared))
        for d in self.depths[::-1]:
            x, y = a[depth == d], b[depth == d]
            while len(x):
                p, q = label[x], label[y]
                apart = p != q
                x, y, low, high = x[apart], y[apart], np.minimum(p, q)[apart], np.maximum(p, q)[apart]
                if not len(x):
                    break
                parent = np.arange(len(label))
                np.minimum.at(parent, high, low)
                moved = np.flatnonzero(parent != np.arange(len(label)))
                self.edges.append((np.full(len(moved), d), moved, parent[moved]))
                while (parent != parent[parent]).any():
                    parent = parent[parent]
                label = parent[label]

    def star(self, shared: np.ndarray, begin: int, end: int, sketches: np.ndarray, held: dict[int, int]) -> dict[int, int]:
        """Edges of the run from row ``begin``, whose first texts by depth are ``held``; and those of its last row."""
        row = np.arange(begin + 1, end)
        if len(row):
            self.measure(estimates(sketches, row - 1, row), shared[row])
        firsts = {}
        for d in self.depths:
            starts = np.where(shared[begin:end] < d, np.arange(begin, end), -1)
            starts[0] = -1
            first = np.maximum.accumulate(starts)
            first = np.where(first < 0, held[d], first)
            of = shared[row] == d
            self.edges.append((np.full(int(of.sum()), d), row[of], first[1:][of]))
            firsts[d] = int(first[-1])
        return firsts


FOREST = "depth int, tree int, hi long, lo long, u binary, v binary, met array<double>, missed array<double>"


def _levels(x: np.ndarray) -> np.ndarray:
    """How many of its four levels, from the first on, are zero."""
    return sum(((x >> np.uint64(s)) == 0).astype(np.int64) for s in (48, 32, 16, 0))


def _forest(batches: Iterator[pa.RecordBatch], similarity: float, trees: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by tree, signature and node: edges, a task's outer texts by prefix (without ``v``), and its share of the measure."""
    trie = Trie(similarity, trees)
    numbers, nodes = np.zeros((0, 3 + trees * LEVELS // 64), dtype=np.uint64), pa.array([], pa.binary())
    first, held, reps = True, None, []  # held: the first texts, as numbers in reps, of a long run that goes on
    schema = pa.schema([("depth", pa.int32()), ("tree", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("u", pa.binary()), ("v", pa.binary()), ("met", pa.list_(pa.float64())), ("missed", pa.list_(pa.float64()))])

    def told(depth, u, v=None, key=None) -> pa.RecordBatch:
        n = len(u)
        key = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())] if key is None else [pa.array(key[:, 0].astype(np.int32)), pa.array(key[:, 1].view(np.int64)), pa.array(key[:, 2].view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), *key, u, pa.nulls(n, pa.binary()) if v is None else v, pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.float64()))], schema=schema)

    def outer(row: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        """The prefixes of a row, by depth, and the first texts that have them."""
        keep = [np.uint64(((1 << 64) - 1) & ~((1 << (64 - 16 * min(max(int(d) - 4 * part, 0), 4))) - 1)) for part in (0, 1) for d in trie.depths]
        key = np.stack([np.full(len(trie.depths), row[0]), row[1] & np.array(keep[: len(trie.depths)]), row[2] & np.array(keep[len(trie.depths) :])], axis=1)
        return told(trie.depths, texts, key=key)

    def settle(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal numbers, nodes, first, held, reps
        n = len(numbers)
        if not n:
            return
        same = np.concatenate(([False], numbers[1:, 0] == numbers[:-1, 0]))
        x = np.concatenate((numbers[:1, 1:3] * 0, numbers[1:, 1:3] ^ numbers[:-1, 1:3]))
        high = _levels(x[:, 0])
        shared = np.where(same, high + np.where(high == 4, _levels(x[:, 1]), 0), 0)
        begin = np.flatnonzero(shared < LEAST_DEPTH)
        end = np.append(begin[1:], n)
        sketches = numbers[:, 3:]
        pool = pa.concat_arrays([nodes, *reps])
        own = lambda row: dict.fromkeys(map(int, trie.depths), row)
        if first:
            yield outer(numbers[0], pa.concat_arrays([nodes.slice(0, 1)] * len(trie.depths)))
        small = end - begin <= RUN
        small[0] &= not first and held is None
        small[-1] = False
        trie.pairs(shared, begin[small], end[small], sketches)
        going = None
        for k in np.flatnonzero(~small):
            a, b, is_last = int(begin[k]), int(end[k]), k == len(begin) - 1
            if is_last and not final and b - a <= RUN and not (k == 0 and (held is not None)):
                going = (a, None)  # to be told later whether it is short
                break
            start = {d: n + i for i, d in enumerate(map(int, trie.depths))} if k == 0 and held is not None else own(a)
            firsts = trie.star(shared, a, b, sketches, start)
            if is_last:
                going = (b - 1, firsts)
        if trie.edges:
            depth, u, v = (np.concatenate(c) for c in zip(*trie.edges, strict=True))
            trie.edges = []
            if len(depth):
                yield told(depth, pool.take(pa.array(u)), pool.take(pa.array(v)))
        at, firsts = going
        first = first and at == 0 and firsts is None
        held = firsts
        reps = [pool.take(pa.array([firsts[int(d)] for d in trie.depths]))] if firsts else []
        if final:
            yield outer(numbers[-1], reps[0])
        numbers, nodes = numbers[at:], nodes.slice(at)

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in range(3)]
        sketch = np.stack([batch.column(4 + k).to_numpy().view(np.uint64) for k in range(trees * LEVELS // 64)], axis=1)
        numbers = np.concatenate((numbers, np.column_stack([*columns, sketch])))
        nodes = pa.concat_arrays([nodes, batch.column(3)])
        yield from settle(final=False)
    yield from settle(final=True)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(schema)[:6]] + [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (trie.met, trie.missed)], schema=schema)


def matched_depth(met: list[float], missed: list[float], recall: float = RECALL) -> int:
    """The longest prefix whose measured recall suffices. met, missed: links by depth from ``LEAST_DEPTH`` on, estimated in all, and of them in no tree."""
    for depth in range(LEVELS, LEAST_DEPTH, -1):
        k = depth - LEAST_DEPTH
        if missed[k] <= (1 - recall) * met[k]:
            return depth
    return LEAST_DEPTH


def candidate_edges(texts: DataFrame, *, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """u, v: edges that connect texts which share a long enough prefix in a tree, at most one for each text and tree. texts: node, signature.

    Sorted ranges of the tries are dealt to tasks; a run that goes over a border is joined through its tasks' outer texts.
    """
    spark, sketch = texts.sparkSession, trees * LEVELS // 64
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    at = lambda k: F.get("signature", k)
    rows = texts.where(F.size("signature") > 0).select("node", "signature", each).select(
        "tree", at(F.col("tree") * 2).alias("hi"), at(F.col("tree") * 2 + 1).alias("lo"), "node", *[at(F.lit(2 * trees + k)).alias(f"s{k}") for k in range(sketch)]
    )
    keys = ("tree", "hi", "lo", "node")
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = written(ranged.mapInArrow(lambda batches: _forest(batches, similarity, trees), FOREST), "forest")
    total = lambda name: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0.0)) for k in range(LEVELS - LEAST_DEPTH + 1)]).alias(name)
    depth = matched_depth(*found.where("met IS NOT NULL").agg(total("met"), total("missed")).first(), recall)
    border = found.where((F.col("depth") == depth) & F.col("hi").isNotNull())
    across = border.join(border.groupBy("tree", "hi", "lo").agg(F.min("u").alias("v0")), ["tree", "hi", "lo"]).select("u", F.col("v0").alias("v"))
    edges = written(found.where((F.col("depth") >= depth) & F.col("v").isNotNull()).select("u", "v").union(across).where("u != v").distinct(), "candidates")
    dropped(found)
    return edges


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        node = batch.column(0).to_pylist()
        fresh = [x != y for x, y in zip(node, [seen, *node], strict=False)]  # rows that repeat stand side by side, or else are told apart later
        seen = node[-1] if node else seen
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        lists = [np.unique(hashes[a:b]).view(np.int64) for _, _, hashes, bounds in shingle_hashes([t or "" for t in batch.column(4).to_pylist()], words) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.list_(pa.int64()))], names=["node", "family", "blocks", "n", "shingles"])


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of the sorted sets have that Jaccard similarity: a symmetric matrix, false on its diagonal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # others meet in no pair
    name = np.cumsum(shared) - 1
    row = np.repeat(np.arange(m), [len(s) for s in sets])[shared[code]]
    code = name[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((m, m))
    total = int(shared.sum())
    for a in range(0, total, SPREAD):
        i, j = np.searchsorted(code, (a, a + SPREAD))
        part = np.zeros((m, min(SPREAD, total - a)), dtype=np.float32)
        part[row[i:j], code[i:j] - a] = 1
        both += part @ part.T
    any_of = sizes[:, None] + sizes[None, :] - both
    out = both >= similarity * any_of - 1e-9 * any_of
    np.fill_diagonal(out, False)
    return out & (sizes > 0)[:, None] & (sizes > 0)[None, :]


def _verified(group: pa.Table, similarity: float) -> pa.Table:
    """Links of a pair of blocks: for each text how many texts and documents it links to here, and the least text that links reach."""
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("documents", pa.int64())])
    nodes, index = np.unique(np.array(group["node"].to_pylist(), dtype=object), return_index=True)
    a, b = group["a"][0].as_py(), group["b"][0].as_py()
    side, weight = group["block"].to_numpy()[index], group["n"].to_numpy()[index]
    lists = group["shingles"].combine_chunks()
    sets = [lists[int(i)].values.to_numpy() for i in index]
    link = linked(sets, similarity)
    if a != b:
        link &= side[:, None] != side[None, :]
    label = np.arange(len(nodes))
    while True:
        near = np.minimum(label, np.where(link, label[None, :], len(nodes)).min(axis=1))
        near = near[near]
        if (near == label).all():
            break
        label = near
    has = np.flatnonzero(link.any(axis=1))
    return pa.table([nodes[has].tolist(), nodes[label[has]].tolist(), link.sum(axis=1)[has], (link @ weight)[has]], schema=schema)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per distinct text: node (its MD5), rank (its least id), n (its rows), label (struct of the class's least id and its node), texts and documents it links to.

    A class is a connected component of links: equal texts, and texts whose shingle sets have the Jaccard
    ``similarity`` or more. Null text counts as empty; texts without words link to their copies only. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), F.col(id_col).alias("rank"), text.alias("text"))
    signed = rows.mapInArrow(lambda batches: _signed(batches, words, trees), f"node binary, rank {kind}, signature array<long>")
    texts = written(signed.groupBy("node").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.first("signature").alias("signature")), "texts")
    node = F.struct("rank", "node")
    candidates = candidate_edges(texts.select("node", "signature"), similarity=similarity, trees=trees, recall=recall)
    families = components(candidates).withColumnRenamed("label", "family")
    sizes = written(families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    members = texts.select("node", "rank", "n").join(families.join(sizes, "family"), "node")
    first = rows.alias("r").join(members.alias("m"), (F.col("r.node") == F.col("m.node")) & F.col("r.rank").eqNullSafe(F.col("m.rank"))).select("r.node", "m.family", "m.blocks", "m.n", "r.text")
    shingled = first.mapInArrow(lambda batches: _shingled(batches, words), "node binary, family binary, blocks int, n long, shingles array<long>")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = shingled.select("node", "family", "n", "shingles", "blocks", block).select("node", "family", "n", "shingles", "block", other)
    dealt = dealt.select("node", "family", "n", "shingles", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    links = written(dealt.groupBy("family", "a", "b").applyInArrow(lambda t: _verified(t, similarity), "node binary, root binary, texts long, documents long"), "links")
    least = written(links.select("node", "root").join(texts.select("node", "rank"), "node").select(node.alias("u"), "root"), "linked")
    joined = components(least.join(texts.select(F.col("node").alias("root"), node.alias("v")), "root").select("u", "v")).select("node.node", "label")
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    zero = F.lit(0).cast("long")
    table = texts.select("node", "rank", "n").join(joined, "node", "left").join(counts, "node", "left").select(
        "node", "rank", "n", F.coalesce("label", F.struct("rank", "node")).alias("label"), F.coalesce("texts", zero).alias("texts"), F.coalesce("documents", zero).alias("documents")
    )
    done = written(table, "classes")
    dropped(texts, candidates, sizes, links, least)
    return done


def members(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links for every row.

    class_id: the least id of the class. n_links: other rows that the row links to, copies among them; n_text_links:
    distinct other texts. A row without links is a class of its own. Rows that repeat are copies of each other. A null
    id stays null; it gives way to others of an equal text, and is less than those of other texts.
    """
    table = classes(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"))
    return rows.join(table, "node").select("doc_id", F.col("label.rank").alias("class_id"), (F.col("documents") + F.col("n") - 1).alias("n_links"), F.col("texts").alias("n_text_links"))


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: that of the least id."""
    table = classes(docs, id_col=id_col, text_col=text_col, **options)
    first = table.where("label.node = node").select("node", F.col("rank").alias("least"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(text.cast("binary"))).alias("node"), F.col(id_col).alias("least"))
    joined = rows.join(first.withColumnRenamed("node", "n").withColumnRenamed("least", "l"), (F.col("node") == F.col("n")) & F.col("least").eqNullSafe(F.col("l")))
    return joined.dropDuplicates(["node", "least"]).select("row.*")
