"""Regions, their media and links, and hidden blocks of tables of nodes, in windows over intervals.

A page's nodes stand in document order, so what lies below a node is the interval from it to ``last_id``. That another
of a set contains a node is a running maximum of ``last_id``; that a node contains one of a set, the next one of the set from it
on. Which region a node lies in is the last one begun, since regions are disjoint. Nothing is joined pair by pair, and
a page's nodes are shuffled once. nodes: key, node_id, parent_id, last_id, tag, attrs, x, y, width, height, hidden, texts
(array<struct<at, text, seen, breaks>>: a node's own texts, their place on the page, whether they show, and whether a block begins or ends ahead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions.fence import fenced
from crawlvis.operators import segmentation as S

FORWARD, BACKWARD = (Window.currentRow, Window.unboundedFollowing), (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def _among(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*sorted(values)), F.lit(False))


def _in_order(key: str, frame: tuple[int, int]):
    return Window.partitionBy(key).orderBy("node_id").rowsBetween(*frame)


def _outermost(chosen: Column, key: str) -> Column:
    """Of the chosen nodes, those that no other of them contains."""
    return chosen & (F.coalesce(F.max(F.when(chosen, F.col("last_id"))).over(_in_order(key, BEFORE)), F.lit(-1)) < F.col("node_id"))


def _holds(chosen: Column, key: str) -> Column:
    """Whether a node is, or has below it, one of the chosen."""
    following = F.min(F.when(chosen, F.col("node_id"))).over(_in_order(key, FORWARD))
    return F.coalesce(following <= F.col("last_id"), F.lit(False))


def regions(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, region_ord, node_id, last_id, tag, attrs, x, y, width, height of the elements to report, outermost ones only, in reading order."""
    page = Window.partitionBy(key)
    c = F.col
    rows = nodes.select(key, "node_id", "parent_id", "last_id", F.lower("tag").alias("tag"), "attrs", "x", "y", "width", "height", F.exists(F.coalesce("texts", F.array().cast(S.TEXTS)), lambda t: t["seen"] & F.rlike(t["text"], F.lit(rf"(?!{T.WS})[\s\S]"))).alias("told"))
    rows = rows.withColumns({"shown": (c("width") > 0) & (c("height") > 0), "area": c("width") * c("height"), "body": F.coalesce(F.min(F.when(c("tag") == "body", c("node_id"))).over(page), F.lit(0))})
    rows = rows.withColumn("main", F.coalesce(F.min(F.when(c("tag") == "main", c("node_id"))).over(page), c("body")))
    rows = rows.withColumn("main_last", F.max(F.when(c("node_id") == c("main"), c("last_id"))).over(page))
    within = (c("main") != c("body")) & c("node_id").between(c("main"), c("main_last"))
    rows = rows.withColumns({"edge": _among("tag", S.LANDMARKS) & c("shown") & ~within, "filled": _holds(c("told"), key)})
    rows = rows.withColumn("landmark", _outermost(c("edge"), key))
    reach = F.coalesce(F.max(F.when(c("landmark"), c("last_id"))).over(_in_order(key, BACKWARD)), F.lit(-1))
    semantic, container = _among("tag", S.SEMANTIC), _among("tag", S.CONTAINERS)
    tall = F.when(semantic, c("height") >= S.TALL_SEMANTIC).otherwise(c("height") >= S.TALL_CONTAINER)
    able = c("shown") & ~_among("tag", S.SKIPPED) & tall & (semantic | container | c("filled"))
    rows = rows.withColumn("free", able & (reach < c("node_id")) & ~_holds(c("landmark"), key))
    rows = rows.withColumns({"content": c("free") & (c("parent_id") == c("main")), "round": F.lit(0)})
    for k in range(1, S.MOST_DESCENTS + 1):
        # The largest element gives way to its children where there are few; a round that changes nothing leaves the later ones nothing to do.
        wide = F.when(c("content") & (c("last_id") > c("node_id")) & (c("area") > 0), F.struct(c("area").alias("area"), (-c("round")).alias("round"), (-c("node_id")).alias("node")))
        rows = rows.withColumns({"n": F.count_if(c("content")).over(page), "largest": F.max(wide).over(page)})
        rows = rows.withColumn("opened", F.coalesce(-c("largest.node"), F.when(c("n") == 0, c("main"))))
        rows = rows.withColumn("child", F.coalesce(c("free") & (c("parent_id") == c("opened")), F.lit(False)))
        opens = (c("n") < S.FEW_REGIONS) & (F.count_if(c("child")).over(page) > 0)
        rows = rows.withColumn("opens", opens)
        rows = rows.withColumns({"content": F.when(c("opens"), (c("content") & (c("node_id") != c("opened"))) | c("child")).otherwise(c("content")), "round": F.when(c("opens") & c("child"), F.lit(k)).otherwise(c("round"))})
    rows = rows.withColumn("outer", _outermost(c("landmark") | c("content"), key)).where("outer")
    place = (F.when(c("landmark"), F.lit(-1)).otherwise(c("round")), c("node_id"))
    rows = rows.withColumn("size", F.row_number().over(page.orderBy(F.desc("area"), *place))).where(c("size") <= S.MOST_REGIONS)
    rows = rows.withColumn("region_ord", F.row_number().over(page.orderBy("y", "x", *place)).cast("long"))
    return rows.select(key, "region_ord", "node_id", "last_id", "tag", "attrs", "x", "y", "width", "height")


def inside(nodes: DataFrame, found: DataFrame, number: str, key: str = "page_id") -> DataFrame:
    """Nodes that lie in one of the disjoint elements ``found`` (key, node_id, last_id and ``number``), itself included, with its number as ``within``, its node as ``top``."""
    marks = found.select(F.col(key).alias("k"), F.col("node_id").alias("i"), F.struct(F.col(number).alias("number"), F.col("node_id").alias("node"), F.col("last_id").alias("last")).alias("mark"))
    rows = nodes.join(marks, (F.col(key) == F.col("k")) & (F.col("node_id") == F.col("i")), "left").drop("k", "i")
    rows = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(_in_order(key, BACKWARD))).where(F.col("node_id") <= F.col("mark.last"))
    return rows.withColumns({"within": F.col("mark.number"), "top": F.col("mark.node")}).drop("mark")


def media_flags(nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, region_ord and the flags of regions: canvases, frames, images and tables in them, and whether they take most of the region."""
    c = F.col
    rows = inside(nodes, found, "region_ord", key).withColumns({"tag": F.lower("tag"), "area": c("width") * c("height"), "own": c("node_id") == c("top")})
    below = lambda tag: ~c("own") & (c("tag") == tag)
    given = lambda name: F.coalesce(F.when(F.rlike(c("attrs")[name], F.lit(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$")), c("attrs")[name].cast("double")), F.lit(0.0))
    side = lambda name: F.when(c(name) != 0, c(name)).otherwise(given(name))
    whole = F.greatest(F.lit(1.0), F.max(F.when(c("own"), c("area"))))
    frame = F.max(F.when(below("iframe"), F.struct("area", (-c("node_id")).alias("at"), c("attrs")["src"].alias("src"))))
    canvas, painted = F.coalesce(F.max(F.when(below("canvas"), c("area"))), F.lit(0.0)), F.coalesce(F.sum(F.when(below("img"), side("width") * side("height"))), F.lit(0.0))
    found = rows.groupBy(key, c("within").alias("region_ord")).agg(
        whole.alias("whole"), canvas.alias("canvas"), frame.alias("frame"), painted.alias("painted"), F.bool_or(below("table")).alias("has_table"),
        F.count_if(below("img")).alias("img_count"), F.count_if(below("img") & (T.trimmed(F.coalesce(c("attrs")["alt"], F.lit(""))) == "")).alias("img_without_alt_count"),
    )
    framed = F.coalesce(c("frame.area") > 0, F.lit(False))
    return found.select(
        key, "region_ord", (c("canvas") > 0).alias("has_canvas"), (c("canvas") / c("whole") > S.CANVAS_SHARE).alias("canvas_dominant"), framed.alias("has_iframe"), F.coalesce(c("frame.area") / c("whole") > S.IFRAME_SHARE, F.lit(False)).alias("iframe_dominant"),
        F.when(framed, c("frame.src")).alias("iframe_src"), "has_table", "img_count", "img_without_alt_count", (c("painted") / c("whole") > S.IMAGE_SHARE).alias("image_dominant"),
    )


def links(nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, region_ord, link_ord (from 0), href, is_client_route of the first links of each region."""
    rows = inside(nodes, found, "region_ord", key).where((F.col("node_id") != F.col("top")) & (F.lower("tag") == "a") & F.col("attrs")["href"].isNotNull())
    nth = F.row_number().over(Window.partitionBy(key, "within").orderBy("node_id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= S.MOST_LINKS)
    href = F.col("attrs")["href"]
    return rows.select(key, F.col("within").alias("region_ord"), (F.col("nth") - 1).cast("long").alias("link_ord"), href.alias("href"), urls.is_client_route(href).alias("is_client_route"))


def _joined(key: str, number: str, rows: DataFrame, piece: Column) -> DataFrame:
    texts = rows.select(key, F.col("within").alias(number), F.explode("texts").alias("t")).groupBy(key, number).agg(F.array_sort(F.collect_list(F.struct(F.col("t.at").alias("at"), piece.alias("text")))).alias("texts"))
    return texts.select(key, number, F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("text"))


def texts(nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, region_ord, text: what shows of each region, on one line in lower case. A region without text has no row."""
    shown = F.when(F.col("t.seen"), F.concat(F.when(F.col("t.breaks"), F.lit("\n")).otherwise(F.lit("")), F.col("t.text"))).otherwise(F.lit(""))
    rows = _joined(key, "region_ord", inside(nodes, found, "region_ord", key), shown)
    return rows.select(key, "region_ord", T.normalized(F.col("text")).alias("text"))


def hidden_blocks(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_ord, node_id, attrs, text of the first elements that style hides and that hold a good deal of text, outermost ones only.

    What lies in a hidden element has no more words than the element, so only outermost ones are read.
    """
    c = F.col
    page = Window.partitionBy(key)
    rows = nodes.withColumn("body", F.coalesce(F.min(F.when(F.lower("tag") == "body", c("node_id"))).over(page), F.lit(0)))
    visited = (c("node_id") > c("body")) & (c("node_id") <= c("body") + S.MOST_VISITED) & (c("node_id") <= c("body_last"))
    rows = rows.withColumn("body_last", F.max(F.when(c("node_id") == c("body"), c("last_id"))).over(page))
    able = F.coalesce("hidden", F.lit(False)) & ~_among("tag", S.SKIPPED | {"head"}) & visited
    outer = fenced(rows.withColumn("able", able).withColumn("outer", _outermost(c("able"), key))).where("outer")
    outer = outer.select(key, "node_id", "last_id", "attrs")
    told = _joined(key, "node", inside(nodes, outer.withColumn("node", c("node_id")), "node", key), c("t.text"))
    told = told.withColumn("text", T.trimmed(c("text"))).where(F.size(F.filter(F.split("text", rf"{T.WS}+"), lambda w: w != "")) >= S.HIDDEN_WORDS)
    joined = outer.join(told.select(F.col(key).alias("k"), "node", "text"), (c(key) == c("k")) & (c("node_id") == c("node")))
    joined = joined.withColumn("block_ord", F.row_number().over(page.orderBy("node_id")).cast("long")).where(c("block_ord") <= S.MOST_HIDDEN)
    return joined.select(key, "block_ord", "node_id", "attrs", "text")
