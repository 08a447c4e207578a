"""Stores of versions: what a lookup reads, that updates win, and that nothing is shuffled without need."""

import re

import pytest
from pyspark.sql import functions as F

from crawlvis.sources.store import Store, last_done


@pytest.fixture
def store(spark):
    rows = lambda begin, end, version, status: spark.range(begin, end).select(F.col("id").alias("scan_id"), F.lit(version).alias("version"), F.lit(status).alias("status"))
    made = Store.made(rows(0, 20_000, 1, "queued"), "test_scans", buckets=8)
    made.append(rows(0, 10_000, 2, "done").withColumn("extra", F.lit(1)))
    made.append(rows(30_000, 30_001, 1, "queued").unionByName(spark.createDataFrame([(None, 1, "lost")], "scan_id long, version int, status string")))
    yield made
    made.drop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """What the scan of the executed plan put out."""
    df.collect()
    tree = df._jdf.queryExecution().executedPlan()
    stack, found = [tree], []
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_a_lookup_reads_one_bucket(spark, store):
    one = store.row(77)
    assert [tuple(r) for r in one.collect()] == [(77, 2, "done")]
    assert re.search(r"SelectedBucketsCount: 1 out of 8", one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert rows_read(store.row(77)) < 10_000 and rows_read(store.newest()) > 30_000
    assert store.row(25_000).count() == 0 and store.row(30_000).first()["status"] == "queued"


def test_newest_rows_without_a_shuffle(spark, store):
    assert "Exchange" not in plan(store.newest())
    assert store.newest().groupBy("status").count().orderBy("status").collect() == [("done", 10_000), ("queued", 10_001)]
    asked = spark.createDataFrame([(5, "a"), (15_000, "b"), (99_999, "c"), (5, "d"), (None, "e")], "scan_id long, who string")
    assert sorted((r["scan_id"], r["who"], r["status"]) for r in store.rows_of(asked).collect()) == [(5, "a", "done"), (5, "d", "done"), (15_000, "b", "queued")]


def test_compaction_keeps_the_newest(store):
    small = store.compacted("test_compacted")
    assert small.versions().count() == 20_001 and sorted(small.newest().collect()) == sorted(store.newest().collect())
    small.drop()


def test_last_done_scan(spark):
    rows = spark.createDataFrame([("u", 1, 1, "done", 5, 10), ("u", 2, 2, "done", 7, 20), ("u", 3, 3, "error", 9, 30), ("v", 1, 4, "done", 1, None), ("w", 1, 5, "done", 2, 20), ("w", 2, 6, "done", 3, 20)], "normalized_url string, version int, scan_id long, status string, score long, f long")
    store = Store.made(rows.withColumn("finished_at", F.timestamp_seconds("f")).drop("f"), "test_urls", key="normalized_url", buckets=4)
    found = last_done(store, "u", "v", "w", "x")
    assert sorted((r["normalized_url"], r["scan_id"], r["score"]) for r in found.collect()) == [("u", 2, 7), ("w", 6, 3)]
    store.drop()
