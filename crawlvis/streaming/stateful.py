"""Streams whose state comes to an end: admission, event logs and reuse on ``transformWithState``.

Clocks are event time. A key's state is cleared by a timer once the watermark says that nothing that still comes can need
it, and rows that come later than the watermark are left out, as Spark does. State lies in RocksDB, so it need not fit memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from crawlvis.operators.admission import WINDOW_MS, admit
from crawlvis.operators.events import KEPT_MS, TERMINAL, frame
from crawlvis.operators.history import DEDUPE_MS
from crawlvis.sources.shared import new_path

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How late events may come.
LATENESS = "1 minute"
#: Rows of a batch, about, where a few keys have them all: a task holds what a batch brings of a key.
MOST_ROWS = 2_000_000
#: Buckets over which keys are dealt whose state is read and written together. Each takes some 10 ms a batch, however few its rows.
BUCKETS = 1024
#: Partitions of a stream's state at most: each is opened, written and committed in every batch, however few its rows, and can't be coalesced.
PARTITIONS = 64
LONGS = lambda *names: StructType([StructField(n, LongType()) for n in names])


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store and the partitions that such streams need, and as it was afterwards."""
    name, provider = ROCKS
    shuffled = "spark.sql.shuffle.partitions"
    before = {n: spark.conf.get(n) for n in (name, shuffled)}
    spark.conf.set(name, provider)
    spark.conf.set(shuffled, str(min(int(before[shuffled]), PARTITIONS)))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """What a batch brings of a key, in order; a batch's size is bounded by what a trigger reads."""
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


def _until(handle: StatefulProcessorHandle, before: int | None, at: int) -> None:
    """The key's only timer, moved from ``before`` to ``at``. What it was is told by the state, as each call is a way to the store and back."""
    if before != at:
        if before is not None:
            handle.deleteTimer(before)
        handle.registerTimer(at)


class Limiter(StatefulProcessor):
    """The times of an address's requests that passed, until a window after the last of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stamps = handle, handle.getListState("stamps", LONGS("ts_ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = [t for (t,) in self.stamps.get()] if self.stamps.exists() else []
        before = stamps[-1] + WINDOW_MS if stamps else None
        some = _sorted(rows, "ts_ms", "req_id")
        decided = [admit(stamps, int(t)) for t in some.ts_ms]
        if stamps:
            self.stamps.put([(t,) for t in stamps])
            _until(self.handle, before, stamps[-1] + WINDOW_MS)
        yield some[["ip", "req_id", "ts_ms"]].assign(allowed=[a for a, _ in decided], retry_after=[w for _, w in decided])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stamps.clear()
        return iter(())

    def close(self) -> None:
        pass


class Bucketed(StatefulProcessor):
    """State of many keys, that of a bucket of them at once: each call to the store is a way there and back, which keys one by one would take for each batch.

    ``kept`` is a dictionary of keys with their longs, of names as given. ``until`` tells of those of a key when it may be
    forgotten, if ever. A bucket has one timer, of the key that comes first.
    """

    names: tuple[str, ...] = ()

    def __init__(self, state: str, key: StructField):
        self.state, self.key = state, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        several = lambda kind: ArrayType(kind, True)
        self.handle, self.held = handle, handle.getValueState(self.state, StructType([StructField("keys", several(self.key.dataType)), *[StructField(n, several(LongType())) for n in self.names]]))

    def until(self, *values: int) -> int | None:
        return None

    def read(self) -> tuple[dict, int | None]:
        """What is kept, and when the timer is set to."""
        found = self.held.get()
        kept = {k: values for k, *values in zip(*found, strict=True)} if found else {}
        return kept, self._first(kept)

    def _first(self, kept: dict) -> int | None:
        return min((at for at in (self.until(*v) for v in kept.values()) if at is not None), default=None)

    def write(self, kept: dict, before: int | None, watermark: int) -> None:
        """Keeps all but the keys whose time is over by the watermark, and sets the timer, which stood at ``before``."""
        kept = {k: v for k, v in kept.items() if (at := self.until(*v)) is None or at > watermark}
        if kept:
            self.held.update((list(kept), *[list(x) for x in zip(*kept.values(), strict=True)]))
        else:
            self.held.clear()
        after = self._first(kept)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def keys_of(self, some: pd.DataFrame) -> list:
        """The key of each row. Null has a bucket of its own."""
        return [None if k is None or k != k else k for k in some[self.key.name].tolist()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.write(self.read()[0], None, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class Numberer(Bucketed):
    """How many events each scan has had, until some minutes after its first end. What comes after that is a log of its own."""

    names = ("seq", "ended")

    def until(self, seq: int, ended: int) -> int | None:
        return ended + KEPT_MS if ended >= 0 else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, before = self.read()
        some, numbers = _sorted(rows, "ts_ms", "event_id"), []
        for scan, at, status in zip(self.keys_of(some), some.ts_ms.tolist(), some.status.tolist(), strict=True):
            seq, ended = kept.get(scan, (0, -1))
            if 0 <= ended <= at - KEPT_MS:
                seq, ended = 0, -1
            kept[scan] = (seq + 1, at if ended < 0 and status in TERMINAL else ended)
            numbers.append(seq + 1)
        self.write(kept, before, timerValues.getCurrentWatermarkInMs())
        yield some[["scan_id", "event_id", "ts_ms", "status"]].assign(seq=numbers)


class Reuser(Bucketed):
    """The scan of each URL that finished last, as long as it may be reused."""

    names = ("finished_us", "scan_id")

    def until(self, finished_us: int, scan_id: int) -> int | None:
        return finished_us // 1000 + DEDUPE_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, before = self.read()
        some, out = _sorted(rows, "at_us", "side", "number"), []
        for url, at, side, number, force in zip(self.keys_of(some), *(some[c].tolist() for c in ("at_us", "side", "number", "force")), strict=True):
            if side == 0:
                kept[url] = (int(at), int(number))
                continue
            last = kept.get(url)
            age = at // 1000 - last[0] // 1000 if last else DEDUPE_MS
            hit = age < DEDUPE_MS and not force
            out.append((int(number), url, last[1] if hit else None, int(age + 500) // 1000 if hit else None))
        self.write(kept, before, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["req_id", "normalized_url", "cached_scan_id", "age_seconds"]).astype({"cached_scan_id": "Int64", "age_seconds": "Int64"})


class Deliverer(Bucketed):
    """The last event that each client has, and whether its scan has ended."""

    names = ("seq", "ended")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, before = self.read()
        some, fresh = _sorted(rows, "seq"), []
        for i, (client, seq, status, had) in enumerate(zip(self.keys_of(some), some.seq.tolist(), some.status.tolist(), some.last_event_id.fillna(0).tolist(), strict=True)):
            sent, ended = kept.get(client) or (int(had), 0)
            if seq > sent and not ended:
                fresh.append(i)
                sent = seq
            kept[client] = (sent, ended or int(status in TERMINAL))
        self.write(kept, before, timerValues.getCurrentWatermarkInMs())
        yield some.iloc[fresh].drop(columns=["last_event_id", "_bucket"], errors="ignore")


def _in_buckets(rows: DataFrame, key: str) -> GroupedData:
    """Rows by buckets of a key; null has one of its own."""
    dealt = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("_bucket", dealt).groupBy("_bucket")


def rate_limited(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ip, req_id, ts_ms, allowed, retry_after of a stream of requests (req_id, ip, ts). The state of an address is ten times at most, for a window."""
    rows = requests.withWatermark("ts", lateness).select("ip", "req_id", "ts", F.unix_millis("ts").alias("ts_ms"))
    ip, req = (dict(rows.dtypes)[c] for c in ("ip", "req_id"))
    return rows.groupBy("ip").transformWithStateInPandas(Limiter(), f"ip {ip}, req_id {req}, ts_ms long, allowed boolean, retry_after long", "Append", "EventTime")


def event_log(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """scan_id, event_id, ts_ms, status, seq of a stream of events (scan_id, event_id, ts, status): numbered from 1 in each scan, anew once its count is forgotten."""
    rows = events.withWatermark("ts", lateness).select("scan_id", "event_id", "ts", F.unix_millis("ts").alias("ts_ms"), "status")
    kind = dict(rows.dtypes)["scan_id"]
    return _in_buckets(rows, "scan_id").transformWithStateInPandas(Numberer("count", rows.schema["scan_id"]), f"scan_id {kind}, event_id long, ts_ms long, status string, seq long", "Append", "EventTime")


def reused(requests: DataFrame, scans: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """req_id, normalized_url, cached_scan_id, age_seconds of a stream of requests (req_id, normalized_url, ts, force) beside a stream of finished scans (scan_id, normalized_url, finished_at)."""
    asked = requests.select("normalized_url", F.col("ts").alias("at"), F.lit(1).alias("side"), F.col("req_id").cast("long").alias("number"), F.coalesce("force", F.lit(False)).alias("force"))
    done = scans.select("normalized_url", F.col("finished_at").alias("at"), F.lit(0).alias("side"), F.col("scan_id").cast("long").alias("number"), F.lit(False).alias("force"))
    both = asked.unionByName(done).withWatermark("at", lateness).withColumn("at_us", F.unix_micros("at"))
    return _in_buckets(both, "normalized_url").transformWithStateInPandas(Reuser("last", both.schema["normalized_url"]), "req_id long, normalized_url string, cached_scan_id long, age_seconds long", "Append", "EventTime")


def delivered(events: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, scan_id, seq, frame of a stream of numbered events (scan_id, seq, status, …), each to every client of its scan once, up to the end of the scan.

    clients: client_id, scan_id, last_event_id. What a client has is state, so a batch costs what it brings, and what is
    kept of the buckets that it touches.
    """
    rows = events.join(clients.select("client_id", "scan_id", F.col("last_event_id").cast("long").alias("last_event_id")), "scan_id")
    told = [c for c in events.columns if c not in ("scan_id", "seq")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "last_event_id")
    fresh = _in_buckets(rows, "client_id").transformWithStateInPandas(Deliverer("sent", rows.schema["client_id"]), kinds, "Append", "None")
    return fresh.select("client_id", "scan_id", "seq", frame(F.struct(*told), F.col("seq")).alias("frame"))


def in_order(rows: DataFrame, clock: str, parts: int, name: str, most: int | None = None) -> DataFrame:
    """A stream of a table in order of ``clock``: at least ``parts`` parts of about as many rows, more if one had more than ``most``. Each is a batch.

    A part is one file, since a batch takes one: of a part in several files, all that the first one's watermark has passed would come too late.
    """
    spark, path, at = rows.sparkSession, new_path(rows.sparkSession, name), F.unix_millis(clock)
    parts = max(parts, -(-rows.count() // most)) if most else parts
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array().cast("array<double>")
    cuts = (rows.agg(F.percentile_approx(at, shares).alias("c")).first()["c"] if parts > 1 else None) or []
    part = F.lit(0)
    for cut in sorted(set(cuts)):
        part = part + (at > cut).cast("int")
    cut_up = rows.where(at.isNotNull()).withColumn("time_part", part)
    cut_up.write.partitionBy("time_part").parquet(f"{path}-dealt")
    dealt = spark.read.schema(cut_up.schema).parquet(f"{path}-dealt")
    for k in range(len(set(cuts)) + 1):
        dealt.where(F.col("time_part") == k).drop("time_part").repartition(1).write.parquet(f"{path}/part={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return stream.parquet(path)
