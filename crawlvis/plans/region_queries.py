"""Queries over the nodes of pages: regions, media in them and hidden blocks, by windows; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.operators import history, regions, segmentation
from crawlvis.plans import oracle
from crawlvis.plans.oracle import q
from crawlvis.sources.tables import cli_json, jpeg_dimensions, safe_id, save_screenshots, screenshot_store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def node_regions(spark, sf_dir):
    """Regions of tables of nodes, in windows."""
    nodes = segmentation.source_nodes(table(spark, sf_dir, "pages"))
    found = regions.regions(nodes)
    rows = found.join(regions.texts(nodes, found), ["page_id", "region_ord"], "left")
    return rows.select("page_id", "region_ord", F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("long").alias("y"), F.col("height").cast("long").alias("height"))


SQL["node_regions"] = f"SELECT page_id, region_ord, text, y, height FROM ({oracle.SQL['static_regions']})"

# Sections with media, by a number; each filled up by a text whose length goes by the page.
CANVAS, TABLE = "<canvas>" + "x" * 60 + "</canvas>", "<table><tr><td>one</td></tr></table>"
FRAMES = ('<iframe src="https://maps.example.com/a"></iframe>', '<iframe src="/b">' + "z" * 90 + "</iframe>")
IMAGES = ('<img src="/1.png">', '<img src="/2.png" alt=" ">', '<img alt="A picture of some length" src="/3.png">')
LINKS = '<a href="#/start">a</a><a href="javascript:go()">b</a><a href="/c">c</a><a name="d">d</a>'
HEAD, TAIL = '<section id="media">', "<p>{fill}</p></section>"
MEDIA = ("", CANVAS, "".join(FRAMES), "".join(IMAGES), TABLE + LINKS, CANVAS + IMAGES[0])


def _with_media(spark, sf_dir) -> DataFrame:
    fill = F.repeat(F.lit("y"), (F.pmod(F.col("page_id"), F.lit(50)) * 3 + 30).cast("int"))
    kind = F.element_at(F.array(*[F.lit(m) for m in MEDIA]), (F.pmod(F.col("page_id"), F.lit(len(MEDIA))) + 1).cast("int"))
    section = F.concat(F.lit(HEAD), kind, F.replace(F.lit(TAIL), F.lit("{fill}"), fill))
    return table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<footer>"), F.concat(section, F.lit("<footer>"))).alias("html"))


@query
def region_media(spark, sf_dir):
    """What media are in a section of each page, and whether they take most of it. The section is told by its id, since it may be too small to be reported."""
    nodes = segmentation.source_nodes(_with_media(spark, sf_dir))
    found = nodes.where(F.col("attrs")["id"] == "media").withColumn("region_ord", F.lit(1).cast("long"))
    routes = regions.links(nodes, found).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if("is_client_route").alias("n_routes"))
    rows = found.select("page_id", F.col("height").cast("long").alias("height")).join(regions.media_flags(nodes, found).drop("region_ord"), "page_id").join(routes, "page_id", "left")
    return rows.fillna(0, ["n_links", "n_routes"])


def _media_sql() -> str:
    fill = "(page_id % 50 * 3 + 30)"
    by_kind = lambda values: f"CASE page_id % {len(MEDIA)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    length = by_kind([len(HEAD) + len(m) + len(TAIL) - len("{fill}") for m in MEDIA])
    canvas = by_kind([len(CANVAS) if CANVAS in m else 0 for m in MEDIA])
    frame = by_kind([len(FRAMES[1]) if FRAMES[1] in m else 0 for m in MEDIA])
    painted = by_kind([sum(len(i) for i in IMAGES if i in m) for m in MEDIA])
    count = lambda values: by_kind([sum(v in m for v in values) for m in MEDIA])
    return f"""WITH p AS (SELECT page_id, {length} + {fill} AS height, {canvas} AS canvas, {frame} AS frame, {painted} AS painted, {count(IMAGES)} AS images, {count(IMAGES[:2])} AS bare, {by_kind([TABLE in m for m in MEDIA])} AS has_table FROM pages)
SELECT page_id, CAST(height AS BIGINT) AS height, canvas > 0 AS has_canvas, canvas / height > 0.4 AS canvas_dominant, frame > 0 AS has_iframe, frame / height > 0.5 AS iframe_dominant, CASE WHEN frame > 0 THEN '/b' END AS iframe_src, has_table,
  CAST(images AS BIGINT) AS img_count, CAST(bare AS BIGINT) AS img_without_alt_count, painted / height > 0.5 AS image_dominant, CAST(CASE WHEN has_table THEN 3 ELSE 0 END AS BIGINT) AS n_links, CAST(CASE WHEN has_table THEN 2 ELSE 0 END AS BIGINT) AS n_routes FROM p"""


SQL["region_media"] = _media_sql()

# What style hides, by a number: ids and texts of the blocks that are found.
WORDS = " ".join(f"w{i}" for i in range(30))
HIDDEN = (
    ('<div style="display: none" id="gone">{w}</div>', ["gone"]),
    ('<div hidden id="outer"><p hidden id="inner">{w}</p></div>', ["outer"]),
    ('<div hidden id="few">some words</div><p style="visibility:hidden" id="late">{w}</p>', ["late"]),
    ('<script hidden>{w}</script><div style="color:red" id="shown">{w}</div>', []),
    ("".join(f'<div hidden id="h{i}">{{w}}</div>' for i in range(10)), [f"h{i}" for i in range(8)]),
)


@query
def page_hidden_blocks(spark, sf_dir):
    """Blocks that pages hide by style: from sources, and with what the raw response has of them."""
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    block = F.element_at(F.array(*[F.lit(h) for h, _ in HIDDEN]), (F.pmod(F.col("page_id"), F.lit(len(HIDDEN))) + 1).cast("int"))
    words = F.concat(F.lit(f"{WORDS} page"), F.col("page_id").cast("string"))
    rows = rows.select("page_id", F.replace("html", F.lit("<nav>"), F.concat(F.replace(block, F.lit("{w}"), words), F.lit("<nav>"))).alias("html"))
    found = regions.hidden_blocks(segmentation.source_nodes(rows))
    return found.select("page_id", "block_ord", F.col("attrs")["id"].alias("id"), F.md5("text").alias("text_md5"))


_ids = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN CAST([{', '.join(map(q, ids))}] AS VARCHAR[])" for i, (_, ids) in enumerate(HIDDEN)) + " END"
SQL["page_hidden_blocks"] = f"SELECT page_id, unnest(range(1, len(ids) + 1)) AS block_ord, unnest(ids) AS id, md5({q(WORDS + ' page')} || page_id) AS text_md5 FROM (SELECT page_id, {_ids} AS ids FROM pages)"


@query
def changed_regions(spark, sf_dir):
    """Regions of a later scan with the change of their selector, as shown beside them."""
    from crawlvis.plans.queries import _halves  # the same parts as the other queries of rescans

    prev, next_ = _halves(spark, sf_dir)
    rows = history.regions_with_change(next_, history.region_changes(prev, next_))
    return rows.select("pair_id", "region_ord", "selector", "status", "change")


SQL["changed_regions"] = f"""WITH c AS ({oracle.SQL['rescan_changes']}), l AS (SELECT pair_id, selector, arg_max(change, change_ord) AS change FROM c GROUP BY ALL),
n AS (SELECT p_partkey // 16 AS pair_id, p_partkey AS region_ord, '#' || replace(lower(p_brand), '#', '-') AS selector, ['ok', 'warn', 'bad'][p_size % 3 + 1] AS status FROM part WHERE p_partkey % 2 <> 0)
SELECT pair_id, region_ord, selector, status, change FROM n LEFT JOIN l USING (pair_id, selector)"""


def _jpeg(width, height, whole):
    """The head of a JPEG file of a size, cut if it isn't ``whole``."""
    number = lambda v: F.lpad(F.hex(v), 4, "0")
    head = F.unhex(F.concat(F.lit("FFD8FFE00004ABCDFFC0001108"), number(height), number(width), F.lit("0311")))
    return F.when(whole, head).otherwise(F.substring(head, 1, 9))


@query
def saved_screenshots(spark, sf_dir):
    """Screenshots of pages, every fifth of which is broken, saved, some of them again, and read by the ids of all pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("../scan "), F.col("page_id").cast("string"), F.lit("/x")).alias("scan_id"))
    n = F.col("page_id")
    store = screenshot_store(spark)
    told = save_screenshots(rows.select("scan_id", F.lit(1).cast("long").alias("version"), _jpeg(n % 1280 + 1, n % 7000 + 1, n % 5 != 0).alias("data")), store)
    save_screenshots(rows.where("page_id % 3 = 0").select("scan_id", F.lit(2).cast("long").alias("version"), _jpeg(n % 640 + 1, n % 900 + 1, n % 4 != 0).alias("data")), store)
    kept = store.newest().select(F.col("scan_id").alias("file"), "version", jpeg_dimensions(F.col("data")).alias("d"))
    found = rows.join(told, "scan_id").withColumn("file", safe_id(F.col("scan_id"))).join(kept, "file", "left")
    return found.select("page_id", "file", "saved", "version", F.col("d.width").cast("long").alias("width"), F.col("d.height").cast("long").alias("height"))


SQL["saved_screenshots"] = """WITH p AS (SELECT page_id, page_id % 5 <> 0 AS saved, CASE WHEN page_id % 3 = 0 AND page_id % 4 <> 0 THEN 2 WHEN page_id % 5 <> 0 THEN 1 END AS version FROM pages)
SELECT page_id, 'scan' || page_id || 'x' AS file, saved, version, CASE version WHEN 2 THEN page_id % 640 + 1 WHEN 1 THEN page_id % 1280 + 1 END AS width, CASE version WHEN 2 THEN page_id % 900 + 1 WHEN 1 THEN page_id % 7000 + 1 END AS height FROM p"""


@query
def cli_documents(spark, sf_dir):
    """Results as the command line prints them, with the length of the raw text in its place."""
    result = F.struct("url", F.col("page_id").alias("score"), F.col("html").alias("raw_text"), F.array(F.lit("a"), F.lit("b")).alias("regions"))
    return table(spark, sf_dir, "pages").select("page_id", cli_json(result).alias("json"))


SQL["cli_documents"] = """SELECT page_id, '{"url":"' || url || '","score":' || page_id || ',"regions":["a","b"],"raw_text_chars":' || length(html) || '}' AS json FROM pages"""
