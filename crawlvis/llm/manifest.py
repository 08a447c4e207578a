"""A Merkle manifest of a dataset: a tree of digests over its rows, with a proof for each row.

Leaves are numbered within their group in order, every ``FANOUT`` consecutive ones are hashed into
a parent, and so on, level by level, until a group has one node; the groups' nodes are the leaves of a second
tree with the dataset's root. Each level is a table of parents with their children in
order, an eighth of the one below. Proofs come down the same tables: a child's is what stands beside it,
then its parent's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.llm.store import written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes ahead, so that neighbouring fields can't run together; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with idx, their place from 0 in their group (nulls first), and size, the group's number of rows.

    No task sees a whole group: rows are sorted in ranges, numbered within their range, and a range adds what the ones
    before it have of the group that it begins with. Equal rows may take each other's place.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("range", F.shiftright("at", 33))
    runs = placed.groupBy(F.col("range").alias("r"), F.col(group).alias("g")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")
    earlier = F.coalesce(F.sum("n").over(whole.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("r", "g", (earlier - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    found = placed.join(runs, (F.col("range") == F.col("r")) & F.col(group).eqNullSafe(F.col("g")))
    return found.select(*[F.col(c) for c in rows.columns], (F.col("at") + F.col("shift")).alias("idx"), "size")


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The tree's tables from the leaves up: grp, idx, size and hash of each node, and its children in order.

    ``leaves`` has grp, idx, size, hash and a struct ``row`` that goes along with them.
    """
    tables, inner = [leaves], "row"
    size = leaves.agg(F.max("size")).first()[0] or 0
    while size > 1:
        below = tables[-1].where("size > 1")
        child = F.struct("idx", "hash", *([inner] if inner else []))
        nodes = below.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("size") / FANOUT).alias("size")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        tables.append(written(nodes.withColumn("hash", digest(F.array_join(F.transform("children", lambda c: c["hash"]), ""))), f"{name}-{len(tables)}"))
        size, inner = -(-size // FANOUT), None
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """grp and hash of each group's last node."""
    found = [t.where("size = 1").select("grp", "hash") for t in tables]
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    return whole


def _children(nodes: DataFrame, *more: str) -> DataFrame:
    """The children of ``nodes``, each with what stands left and right of it ahead of its parent's path."""
    side = lambda part: F.array_join(F.transform(part, lambda c: c["hash"]), "")
    at = F.col("pos") + 1
    left, right = F.slice("children", F.lit(1), F.col("pos")), F.slice("children", at + 1, F.greatest(F.size("children") - at, F.lit(0)))
    step = F.struct(side(left).alias("left"), side(right).alias("right"))
    rows = nodes.select("grp", "path", "subroot", "root", "children", F.posexplode("children").alias("pos", "c"))
    return rows.select("grp", "c.idx", "c.hash", F.concat(F.array(step), F.col("path")).alias("path"), "subroot", "root", *[f"c.{m}" for m in more])


def proved(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """hash, path, subroot, root and row of every leaf. ``above`` has grp, path, subroot and root of each group's last node.

    The path has one step for each level from the leaf up: the digests left and right of the node that leads to it.
    """
    above = above.select(F.col("grp").alias("g"), "path", "subroot", "root")
    topped = lambda nodes: nodes.where("size = 1").join(above, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    known = None
    for k in range(len(tables) - 1, 0, -1):
        nodes = topped(tables[k]).select("grp", "children", "path", "subroot", "root")
        if known is not None:
            ways = known.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "path", "subroot", "root")
            inner = tables[k].where("size > 1").join(ways, F.col("grp").eqNullSafe(F.col("g")) & (F.col("idx") == F.col("i")))
            nodes = nodes.unionByName(inner.select("grp", "children", "path", "subroot", "root"))
        known = _children(nodes, *(["row"] if k == 1 else []))
    alone = topped(tables[0]).select("hash", "path", "subroot", "root", "row")
    return alone if known is None else alone.unionByName(known.select("hash", "path", "subroot", "root", "row"))


def manifest(leaves: DataFrame, *, group: str, order: list[str]) -> DataFrame:
    """Every leaf with its proof: ``row`` (all its columns but the hash), leaf, path, subroot, root.

    ``leaves`` has a column ``hash``; those of a group (null is one) ascend by ``order`` and then by hash, nulls first; groups ascend
    by name, null first, bytewise. Rows that repeat are leaves of their own. No leaves give no rows.
    """
    carried = F.struct(*[c for c in leaves.columns if c != "hash"]).alias("row")
    rows = leaves.select(F.col(group).alias("grp"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "hash", carried)
    places = numbered(rows, "grp", [*[f"o{i}" for i in range(len(order))], "hash"], "leaves")
    tree = levels(places.select("grp", "idx", "size", "hash", "row"), "manifest")
    heads = tops(tree).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    heads = numbered(heads, "grp", ["name"], "subroots").select("grp", "idx", "size", "hash", F.struct("name").alias("row"))
    crown = levels(heads, "crown")
    start = tops(crown).select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    roots = proved(crown, start).select(F.col("row.name").alias("grp"), "path", F.col("hash").alias("subroot"), "root")
    return proved(tree, roots).select("row", F.col("hash").alias("leaf"), "path", "subroot", "root")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(path: Column, presented: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, presented, lambda h, s: digest(s["left"], h, s["right"]))


def row_leaf(text: Column | None = None) -> Column:
    """A document's leaf; with ``text``, the one that it would have if that were its text."""
    return leaf(*[text if c == "text" and text is not None else F.col(c) for c in FIELDS])


def tamper_test(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: which rows still prove that they belong to the dataset
    when the rows of ``tampered`` come with another ``text``.

    A null field is told from an empty one; a null id is the least; rows that repeat have leaves of their own; an empty
    table has no rows and no root; columns besides the five fields are not read.
    """
    presented = F.when(F.coalesce(tampered, F.lit(False)) & ~text.eqNullSafe(F.col("text")), row_leaf(text))
    leaves = docs.select("doc_id", "lang", row_leaf().alias("hash"), presented.alias("presented"))
    rows = manifest(leaves, group="lang", order=["doc_id"])
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("row.presented", "leaf")))
    return rows.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
