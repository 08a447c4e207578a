"""Request and event streams: event numbering, admission and reuse of cached scans, with state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlvis.operators.admission import WINDOW_MS, admit, simulate
from crawlvis.operators.events import KEPT_MS, TERMINAL
from crawlvis.operators.history import cached_scans
from crawlvis.sources.shared import new_path


def _clock(forget: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout


def event_log(events: DataFrame, *, forget: bool = True) -> DataFrame:
    """scan_id, event_id, ts_ms, status, seq of a stream of events (scan_id, event_id, ts, status): numbered from 1 in each scan.

    A scan's count is forgotten some minutes after it ends, when no event of it comes any more. Such clocks keep a query
    running batches, so one that is to end with its input must not ``forget``.
    """
    rows = events.select("scan_id", "event_id", F.unix_millis("ts").alias("ts_ms"), "status")
    kind = dict(rows.dtypes)["scan_id"]

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (seq,) = state.get if state.exists else (0,)
        some = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"])
        out = some.assign(seq=range(seq + 1, seq + 1 + len(some)))
        state.update((seq + len(some),))
        if forget and some.status.isin(TERMINAL).any():
            state.setTimeoutDuration(KEPT_MS)
        yield out

    return rows.groupBy("scan_id").applyInPandasWithState(number, f"scan_id {kind}, event_id long, ts_ms long, status string, seq long", "seq long", "append", _clock(forget))


def rate_limited(requests: DataFrame, *, forget: bool = True) -> DataFrame:
    """ip, req_id, ts_ms, allowed, retry_after of a stream of requests (req_id, ip, ts). The state of an address is the times that passed, ten at most."""
    rows = requests.select("ip", "req_id", F.unix_millis("ts").alias("ts_ms"))
    kind = dict(rows.dtypes)["ip"]

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = list(state.get[0]) if state.exists else []
        some = pd.concat(list(batches)).sort_values(["ts_ms", "req_id"])
        decided = [admit(stamps, int(t)) for t in some.ts_ms]
        state.update((stamps,))
        if forget:
            state.setTimeoutDuration(WINDOW_MS)
        yield some.assign(allowed=[a for a, _ in decided], retry_after=[w for _, w in decided])

    return rows.groupBy("ip").applyInPandasWithState(decide, f"ip {kind}, req_id long, ts_ms long, allowed boolean, retry_after long", "stamps array<long>", "append", _clock(forget))


def queued(requests: DataFrame) -> DataFrame:
    """queue, scan_id, arrival_ms, start_ms, end_ms of a stream of scans (queue, scan_id, arrival_ms, duration_ms), first come first served on two slots."""
    kind = dict(requests.dtypes)["queue"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy = list(state.get[0]) if state.exists else []  # ends of what runs
        some = pd.concat(list(batches)).sort_values(["arrival_ms", "scan_id"])
        floor = min(busy, default=0)
        before = [(min(floor, 0), end - min(floor, 0)) for end in busy]
        done = simulate(before + list(zip(some.arrival_ms.astype(int), some.duration_ms.astype(int), strict=True)))[len(before) :]
        state.update((sorted([*busy, *(d[1] for d in done)])[-2:],))
        yield some[["queue", "scan_id", "arrival_ms"]].assign(start_ms=[d[0] for d in done], end_ms=[d[1] for d in done])

    schema = f"queue {kind}, scan_id long, arrival_ms long, start_ms long, end_ms long"
    return requests.select("queue", "scan_id", "arrival_ms", "duration_ms").groupBy("queue").applyInPandasWithState(run, schema, "ends array<long>", "append", GroupStateTimeout.NoTimeout)


def reuse(scans: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that writes each batch of requests with the scan it may reuse."""

    def write(batch: DataFrame, epoch: int) -> None:
        cached_scans(batch, scans).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


def frames_sink(clients: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that writes frames of numbered events to ``out``, each to every client once.

    What has been written tells what a client has: events up to its last are left out, also if a batch comes again after
    a failure, whose own output is replaced.
    """
    from crawlvis.operators.events import frames

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        asked = clients
        if epoch:
            sent = spark.read.parquet(*[f"{out}/epoch={e}" for e in range(epoch)]).groupBy("client_id").agg(F.max("seq").alias("_sent"))
            asked = clients.join(sent, "client_id", "left").withColumn("last_event_id", F.greatest("last_event_id", "_sent")).drop("_sent")
        frames(batch, asked).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


def delivered(stream: DataFrame, sink: Callable[[str], Callable[[DataFrame, int], None]], name: str) -> DataFrame:
    """Runs a stream over all that is there now into a sink that is made for a folder, and reads what the sink wrote there."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = stream.writeStream.foreachBatch(sink(path)).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/epoch=*")


def completed(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and reads it."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
