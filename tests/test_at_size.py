"""What holds only once tables are large: lines that grow, batches of several files, tasks that hold a batch."""

import time

import pytest
from pyspark.sql import functions as F

from crawlvis.operators import admission
from crawlvis.streaming import scans, stateful


def test_a_long_line_takes_time_by_its_scans():
    began = time.time()
    done = admission.simulate([(0, 1000)] * 100_000)
    assert time.time() - began < 10
    assert done[0] == done[1] == (0, 1000, 0) and [d[2] for d in done[2:]] == list(range(1, 99_999)) and done[-1][0] == 49_999_000


def test_positions_count_those_that_still_wait():
    scans, naive = [(k * 7 % 50 + k * 3, k * 13 % 40) for k in range(500)], []
    scans.sort()
    done = admission.simulate(scans)
    for k, (at, _) in enumerate(scans):
        naive.append(sum(start > at for start, _, _ in done[: k + 1]) if done[k][0] > at else 0)
    assert [d[2] for d in done] == naive and max(naive) > 5


def test_queues_are_read_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if k % 3 == 2 else f"q{k % 3}", k, k * 5, k * 37 % 50) for k in range(120)]
        got = admission.queued(spark.createDataFrame(rows, "queue string, scan_id long, arrival_ms long, duration_ms long").repartition(5)).collect()
        for queue in ("q0", "q1", None):
            own = [r for r in rows if r[0] == queue]
            expected = [(r[1], *d) for r, d in zip(own, admission.simulate([r[2:] for r in own]), strict=True)]
            assert sorted((r["scan_id"], r["start_ms"], r["end_ms"], r["position"]) for r in got if r["queue"] == queue) == expected
        asked = spark.createDataFrame([(k, f"ip{k % 2}", k * 1000) for k in range(200)], "req_id long, ip string, ms long").withColumn("ts", F.timestamp_millis("ms"))
        found = admission.rate_limited(asked.repartition(5)).collect()
        for ip in ("ip0", "ip1"):
            stamps: list[int] = []
            own = sorted((r for r in found if r["ip"] == ip), key=lambda r: r["ts_ms"])
            assert len(own) == 100 and [(r["allowed"], r["retry_after"]) for r in own] == [admission.admit(stamps, r["ts_ms"]) for r in own]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def hours(spark):
    """An hour of requests in as many files as a large table comes in, each of the whole time."""
    rows = spark.range(3600).select(F.col("id").alias("req_id"), F.concat(F.lit("ip"), F.pmod("id", F.lit(3)).cast("string")).alias("ip"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    return rows.orderBy(F.xxhash64("req_id")).repartition(8)


def test_a_part_of_the_time_is_a_batch(spark, hours):
    with stateful.rocks(spark):
        stream = stateful.rate_limited(stateful.in_order(hours, "ts", 3, "hours"))
        got = scans.completed(stream, "hours-limit").collect()
    assert len(got) == 3600  # none came too late
    assert {tuple(r) for r in got} == {tuple(r) for r in admission.rate_limited(hours).collect()}


def test_a_part_has_no_more_than_a_batch_may_bring(spark, hours):
    stream = stateful.in_order(hours, "ts", 1, "hours", 500)
    batches = []
    query = stream.writeStream.foreachBatch(lambda batch, epoch: batches.append(batch.agg(F.count("*"), F.min("req_id"), F.max("req_id")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [tuple(b) for b in batches]
    assert len(batches) == 8 and sum(n for n, _, _ in batches) == 3600 and max(n for n, _, _ in batches) <= 500
    assert all(a[2] < b[1] for a, b in zip(batches, batches[1:], strict=False))


def test_pages_are_read_few_at_a_time():
    import pyarrow as pa

    from crawlvis.operators import segmentation

    pages = [None if k == 3 else "x" * (5 << 20 if k == 7 else 10) for k in range(450)]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(450)), "html": pa.array(pages)})
    parts = list(segmentation.few(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for part in parts for i in part.column(0).to_pylist()] == list(range(450))
    assert [p.num_rows for p in parts] == [7, 1, 200, 200, 42, 0]


def test_nodes_are_handed_over_in_pieces(spark, monkeypatch):
    from crawlvis.sources import html

    pages = spark.createDataFrame([(1, "<ul>" + "<li>a<b>c</b>d" * 40 + "</ul>"), (2, None), (3, "<p>x<p>y")], "page_id long, html string").coalesce(1)
    whole = html.node_table(pages).collect()
    monkeypatch.setattr(html, "NODES_PER_BATCH", 7)
    assert html.node_table(pages).collect() == whole and len(whole) == 83
    assert [(r["tag"], r["nth_of_type"], r["text"]) for r in whole if r["page_id"] == 3] == [("p", 1, "x"), ("p", 2, "y")]
    assert max(r["nth_of_type"] for r in whole) == 40 and [r["text"] for r in whole[:3]] == ["", "ad", "c"]


def test_likest_regions_are_taken_in_turn_in_any_batches(spark):
    from crawlvis.operators import history

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        side = lambda first: spark.createDataFrame([(pair, 2 * k + first, " ".join(f"w{(k * j + pair + first * k) % 3}" for j in range(3))) for pair in range(6) for k in range(7)], "pair_id long, region_ord long, name string")
        prev, next_ = side(0), side(1)
        pairs = [tuple(r) for r in history.name_pairs(prev, next_).collect() if r["similarity"] >= history.SIMILAR_NAMES]
        expected, taken = [], set()
        for pair, after in sorted({(p[0], p[2]) for p in pairs}):
            free = [p for p in pairs if (p[0], p[2]) == (pair, after) and (pair, p[1]) not in taken]
            if free:
                best = min(free, key=lambda p: (-p[3], p[1]))
                taken.add((pair, best[1]))
                expected.append(best[:3])
        assert sorted(tuple(r) for r in history.name_matches(prev, next_).collect()) == expected and len(expected) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_urls_are_trimmed_once_for_each_request(spark):
    import re

    from crawlvis.functions import text as T

    rows = spark.createDataFrame([(1, " 　a b﻿\x0b", None), (2, "​", True), (3, "  ", True), (4, None, False), (5, "x" * 2049 + " ", None)], "req_id long, url string, force boolean")
    found = admission.valid_requests(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "a b", False), (2, "​", True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1 and "regexp_replace" not in plan
    blank = re.compile(T.WS.replace("\\x{feff}", "﻿").replace("\\x{a0}", "\xa0").replace("\\x{", "\\u").replace("}", ""))
    assert {c for c in map(chr, range(0x10000)) if blank.fullmatch(c)} == set(T.BLANKS)


def test_pages_of_one_row_group_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from crawlvis.operators import segmentation
    from crawlvis.sources import shared

    rows = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.expr("repeat(uuid(), 40)")).alias("html"), F.lit("<p>x").alias("raw_html"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    monkeypatch.setattr(segmentation, "EACH", 2_000)
    spark.conf.set(shared.SPREAD_BELOW, "1000")  # the table counts as a larger one
    try:
        read = segmentation.read_pages(pages)
        sizes = [len(part) for part in read.select("page_id").rdd.glom().collect()]
        nodes = segmentation.source_nodes(pages)
        assert len(sizes) > 8 and max(sizes) < 100 and sum(sizes) == 400
        assert nodes.rdd.getNumPartitions() > 8 and nodes.select("page_id").distinct().count() == 400
        spark.conf.set(shared.SPREAD_BELOW, "0")
        assert shared.spread(pages, 1000) is pages
    finally:
        spark.conf.unset(shared.SPREAD_BELOW)
