"""Streams whose state ends, and the sink that commits."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlvis.streaming import stateful
from crawlvis.streaming.delivery import FramesWriter, Written, committed


@pytest.fixture
def rocks(spark):
    with stateful.rocks(spark):
        yield


def batches(spark, path, kinds, parts):
    """A stream that takes each of ``parts`` as a batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{path}/in/part={k}")
    schema = spark.createDataFrame([], kinds).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in").withColumn("ts", F.timestamp_millis(F.col("ms") + BEGIN)).drop("ms")


def run(stream, path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out").collect()


def held(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/state").select("key").distinct().count()


HOUR, BEGIN = 3_600_000, 1_700_000_000_000


def test_addresses_are_forgotten(spark, rocks, tmp_path):
    first = [(k, f"ip{k % 50}", 1000 + k) for k in range(600)]  # ten of twelve requests of each address pass
    later = [(1000, "ip0", HOUR), (1001, "late", HOUR - 1000), (1002, "x", 2 * HOUR), (1003, "x", 2 * HOUR + 1)]
    stream = batches(spark, tmp_path, "req_id long, ip string, ms long", [first, later[:2], later[2:3], later[3:], [(1004, "gone", HOUR)]])
    rows = run(stateful.rate_limited(stream), tmp_path)
    assert sum(r["allowed"] for r in rows) == 50 * 10 + 4 and len(rows) == 604
    assert 1004 not in {r["req_id"] for r in rows}  # came an hour later than the watermark allows
    assert held(spark, tmp_path, "stamps") == 1  # of 53 addresses all but the last are forgotten


def test_logs_end_and_begin_anew(spark, rocks, tmp_path):
    parts = [[(7, 1, "fetching", 0), (7, 2, "done", 1000), (7, 3, "done", 2000), (8, 4, "fetching", 0)], [(7, 5, "fetching", 301_000), (9, 6, "done", 302_000)], [(7, 7, "fetching", HOUR)], [(8, 8, "error", 2 * HOUR)]]
    rows = run(stateful.event_log(batches(spark, tmp_path, "scan_id long, event_id long, status string, ms long", parts)), tmp_path)
    assert {r["event_id"]: r["seq"] for r in rows} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 1, 7: 2, 8: 2}
    assert held(spark, tmp_path, "count") == 2  # scan 9 is forgotten; 7 hasn't ended again, 8 has just ended


def test_scans_are_reused_for_ten_minutes(spark, rocks, tmp_path):
    kinds = "number long, normalized_url string, side int, force boolean, ms long"
    parts = [[(1, "u", 0, None, 0), (2, "u", 1, None, 0), (3, "u", 1, True, 5000), (4, "u", 1, None, 599_500), (5, "v", 1, None, 0)], [(6, "u", 1, None, 600_000), (7, "v", 0, None, 599_000)], [(8, "v", 1, False, HOUR)], [(9, "w", 1, None, 2 * HOUR)]]
    both = batches(spark, tmp_path, kinds, parts)
    asked = both.where("side = 1").select(F.col("number").alias("req_id"), "normalized_url", "ts", "force")
    done = both.where("side = 0").select(F.col("number").alias("scan_id"), "normalized_url", F.col("ts").alias("finished_at"))
    rows = run(stateful.reused(asked, done), tmp_path)
    assert {r["req_id"]: (r["cached_scan_id"], r["age_seconds"]) for r in rows} == {2: (1, 0), 3: (None, None), 4: (1, 600), 5: (None, None), 6: (None, None), 8: (None, None), 9: (None, None)}
    assert held(spark, tmp_path, "last") == 0


def test_clients_get_each_event_once(spark, rocks, tmp_path):
    parts = [[(7, 1, "fetching", 0), (7, 2, "fetching", 0)], [(7, 2, "fetching", 0), (7, 3, "done", 0)], [(7, 4, "fetching", 0), (8, 1, "fetching", 0)]]
    stream = batches(spark, tmp_path, "scan_id long, seq long, status string, ms long", parts).drop("ts")
    clients = spark.createDataFrame([(1, 7, 0), (2, 7, 2), (3, 8, None), (4, 9, 0)], "client_id long, scan_id long, last_event_id int")
    rows = run(stateful.delivered(stream, clients), tmp_path)
    assert sorted((r["client_id"], r["seq"]) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 1)]
    assert {r["frame"] for r in rows if r["seq"] == 3} == {'id: 3\ndata: {"status":"done"}\n\n'}


def test_a_batch_counts_once(spark, tmp_path):
    writer = FramesWriter(f"file://{tmp_path}")
    rows = lambda *values: iter([pa.RecordBatch.from_pydict({"x": pa.array(values, pa.int64())})])
    read = lambda: sorted(r["x"] for r in committed(spark, str(tmp_path), "x long").collect())
    assert read() == []
    first = [writer.write(rows(1, 2)), writer.write(rows()), writer.write(iter([])), None]
    assert first[1] == first[2] == Written(None, 0)
    assert read() == []  # nothing counts before it is in the log
    writer.commit(first, 0)
    again = [writer.write(rows(1, 2))]  # the batch comes again after a failure
    writer.commit(again, 0)
    lost = [writer.write(rows(9)), None]
    writer.abort(lost, 1)
    writer.commit([writer.write(rows(3))], 1)
    writer.commit([], 2)
    assert read() == [1, 2, 3]
    assert len(list((tmp_path / "data").iterdir())) == 2 and json.loads((tmp_path / "log" / f"{0:012d}.json").read_text())["rows"] == 2
