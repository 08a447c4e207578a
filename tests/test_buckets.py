"""State of many keys, read and written by buckets."""

import pytest
from pyspark.sql import functions as F

from crawlvis.streaming import scans, stateful

MINUTE = 60_000


@pytest.fixture
def few(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 3)
    with stateful.rocks(spark):
        yield


def stream(spark, kinds, rows, parts):
    return stateful.in_order(spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000)), "ts", parts, "buckets").drop("ms")


def told(df, path):
    """The rows of a stream, and how many states it leaves."""
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    spark = df.sparkSession
    states = spark.read.format("statestore").option("stateVarName", "count").load(f"{path}/state").select("key").distinct().count()
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(f"{path}/out").collect()], states


def test_many_scans_share_a_state_and_are_numbered_each(spark, few, tmp_path):
    scan = lambda k: None if k % 41 == 0 else 2**60 + k % 41
    rows = [(scan(k), k, "done" if k % 7 == 3 else "error" if k % 11 == 5 else "fetching", k * 2500) for k in range(1200)]
    got, states = told(stateful.event_log(stream(spark, "scan_id long, event_id long, status string, ms long", rows, 4)), tmp_path)
    expected, kept = [], {}
    for number, event, status, at in rows:
        seq, ended = kept.get(number, (0, None))
        if ended is not None and at - ended >= 5 * MINUTE:
            seq, ended = 0, None
        kept[number] = (seq + 1, at if ended is None and status != "fetching" else ended)
        expected.append((number, event, at + 1_700_000_000_000, status, seq + 1))
    assert sorted(got, key=lambda r: r[1]) == expected and len({r[0] for r in expected}) == 41
    assert 1 <= states <= 4  # three buckets, and null's own


def test_urls_of_a_bucket_keep_scans_of_their_own(spark, few):
    rows = [(k, None if k % 23 == 0 else f"u{k % 23}", k * 20_000) for k in range(900)]
    both = stream(spark, "number long, normalized_url string, ms long", rows, 4)
    asked = both.where("number % 3 = 0").select(F.col("number").alias("req_id"), "normalized_url", "ts", (F.col("number") % 2 == 0).alias("force"))
    done = both.where("number % 3 != 0").select(F.col("number").alias("scan_id"), "normalized_url", F.col("ts").alias("finished_at"))
    got = {r["req_id"]: (r["normalized_url"], r["cached_scan_id"], r["age_seconds"]) for r in scans.completed(stateful.reused(asked, done), "buckets-reuse").collect()}
    expected, last = {}, {}
    for number, url, at in rows:
        if number % 3:
            last[url] = (number, at)
        else:
            hit = url in last and at - last[url][1] < 10 * MINUTE and number % 2
            expected[number] = (url, *((last[url][0], (at - last[url][1] + 500) // 1000) if hit else (None, None)))
    assert got == expected and any(v[1] for v in got.values())


def test_clients_of_a_bucket_get_their_own_events(spark, few):
    rows = [(scan, seq, "done" if seq == 4 + scan % 3 else "fetching", seq * 1000) for scan in range(60) for seq in range(1, 9)]
    clients = spark.createDataFrame([(f"c{k}", k % 60, k % 4) for k in range(150)], "client_id string, scan_id long, last_event_id long")
    got = scans.completed(stateful.delivered(stream(spark, "scan_id long, seq long, status string, ms long", rows, 4).drop("ts"), clients), "buckets-frames").collect()
    assert sorted((r["client_id"], r["seq"]) for r in got) == sorted((f"c{k}", seq) for k in range(150) for seq in range(k % 4 + 1, 5 + k % 60 % 3))


def test_a_stream_opens_few_partitions_of_state_a_batch(spark, tmp_path, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(stateful, "PARTITIONS", 3, raising=False)
    try:
        spark.conf.set(name, "2")  # fewer stay
        with stateful.rocks(spark):
            assert spark.conf.get(name) == "2"
        spark.conf.set(name, "40")
        with stateful.rocks(spark):
            rows = [(scan, seq, "done" if seq == 5 else "fetching", seq * 1000) for scan in range(50) for seq in range(1, 8)]
            clients = spark.createDataFrame([(k, k, k % 3) for k in range(50)], "client_id long, scan_id long, last_event_id long")
            got = stateful.delivered(stream(spark, "scan_id long, seq long, status string, ms long", rows, 3).drop("ts"), clients)
            query = got.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    kept = spark.read.format("state-metadata").load(f"{tmp_path}/state").select("numPartitions").distinct().collect()
    assert [r[0] for r in kept] == [3]
    sent = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["client_id"], r["seq"]) for r in sent) == [(k, seq) for k in range(50) for seq in range(k % 3 + 1, 6)]
