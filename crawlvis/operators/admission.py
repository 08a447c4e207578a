"""Admission of requests: the sliding-log limiter, the two-slot queue, request filters."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import urls
from crawlvis.functions.fence import fenced
from crawlvis.sources.shared import written

# Requests per window and address, and scans that run at once.
LIMIT, WINDOW_MS, SLOTS = 10, 60_000, 2
#: Time by which a log is dealt to find where it pauses.
BUCKET_MS = 3_600_000
#: Requests of an address that a task folds, about.
ROWS_PER_RUN = 100_000

Step = Callable[[list[bool], pd.DataFrame], pd.DataFrame]


def admit(stamps: list[int], now: int, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> tuple[bool, int]:
    """Whether a request at ``now`` passes, and seconds to wait if not. stamps: those that passed; changed in place.

    Stamps a whole window old no longer count, and requests that are refused never do.
    """
    while stamps and stamps[0] <= now - window_ms:
        stamps.pop(0)
    if len(stamps) >= limit:
        return False, max(1, math.ceil((stamps[0] + window_ms - now) / 1000))
    stamps.append(now)
    return True, 0


def in_turn(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Callable[[], Step], schema: str) -> DataFrame:
    """Rows of each key in their order, a batch at a time: Spark sorts them, so that a task holds a batch and not a key's rows.

    ``fold`` makes a task's step, which takes a batch and, of each of its rows, whether a key begins with it.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, last = fold(), None
        for batch in batches:
            if len(batch):
                held = list(zip(*(batch[k].astype(object).where(batch[k].notna(), None).tolist() for k in keys), strict=True))
                yield step([a != b for a, b in zip(held, [last, *held], strict=False)], batch)
                last = held[-1]

    return dealt.mapInPandas(run, schema)


def rate_limited(requests: DataFrame) -> DataFrame:
    """ip, req_id, ts_ms, allowed, retry_after of requests (req_id, ip, ts), in order of time and id.

    Each decision depends on the ones before, so requests are folded in order. After a window without requests nothing
    is left to remember, and an address's log is cut there. Requests are dealt by address and ``BUCKET_MS`` of time to find
    the gaps; where a bucket's first request follows on the bucket before, buckets' ends tell, of which there is a row each.
    The pieces that begin in a bucket are folded together, so an address of many requests is dealt over many tasks; only one
    that never pauses for a window is a single sequence, which its task reads batch by batch.
    """
    rows = requests.select("ip", "req_id", F.unix_millis("ts").alias("ts_ms")).withColumn("bucket", F.floor(F.col("ts_ms") / BUCKET_MS))
    buckets = Window.partitionBy("ip").orderBy("bucket")
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("ip", "bucket").orderBy("ts_ms", "req_id")
    run = F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / ROWS_PER_RUN)  # of buckets, so that a task folds about as many rows as another
    ends = rows.groupBy("ip", "bucket").agg(F.max("ts_ms").alias("end"), F.count("*").alias("n")).select("ip", "bucket", F.lag("end").over(buckets).alias("before"), run.alias("run"))
    known = lambda right: (F.col("l.ip").eqNullSafe(F.col(f"{right}.ip"))) & (F.col("l.bucket") == F.col(f"{right}.bucket"))
    near = rows.alias("l").join(ends.alias("e"), known("e")).select("l.*", "e.before", "e.run")
    previous = F.coalesce(F.lag("ts_ms").over(inside), F.col("before"))
    cut = near.withColumn("opens", previous.isNull() | (F.col("ts_ms") - previous >= WINDOW_MS))
    # The last piece that begins in a bucket goes on into the next ones, up to one in which another begins.
    last = cut.groupBy("ip", "bucket").agg(F.max(F.when(F.col("opens"), F.col("run"))).alias("last")).select("ip", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    begun = F.max("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    pieces = cut.withColumn("begun", begun).alias("l").join(last.alias("c"), known("c")).select("l.ip", "l.req_id", "l.ts_ms", F.when(F.col("begun"), F.col("l.run")).otherwise(F.col("c.carried")).alias("run"))
    ip, req = (dict(rows.dtypes)[c] for c in ("ip", "req_id"))

    def limiter() -> Step:
        stamps: list[int] = []

        def step(opens: list[bool], batch: pd.DataFrame) -> pd.DataFrame:
            allowed, wait = [], []
            for new, at in zip(opens, batch.ts_ms.tolist(), strict=True):
                if new:
                    stamps.clear()
                passes, seconds = admit(stamps, at)
                allowed.append(passes)
                wait.append(seconds)
            return batch[["ip", "req_id", "ts_ms"]].assign(allowed=allowed, retry_after=wait)

        return step

    return in_turn(pieces, ("ip", "run"), ("ts_ms", "req_id"), limiter, f"ip {ip}, req_id {req}, ts_ms long, allowed boolean, retry_after long")


class Line:
    """Slots, and the line before them, of scans that come in order of arrival and are served first come first.

    Starts never go back, so what has begun by an arrival stands at the head of the line: each scan joins and leaves it once.
    """

    def __init__(self, slots: int = SLOTS, ends: Iterable[int] = ()):
        self.slots, self.ends = slots, sorted(ends)  # of what runs
        self.starts, self.begun = array("q"), 0  # of scans that had to wait, and how many of those have begun

    def come(self, at: int, lasts: int) -> tuple[int, int, int]:
        """Start, end and position on arrival (0: runs at once)."""
        starts = self.starts
        while self.begun < len(starts) and starts[self.begun] <= at:
            self.begun += 1
        if self.begun > len(starts) // 2:
            del starts[: self.begun]
            self.begun = 0
        start = at if len(self.ends) < self.slots else max(at, heapq.heappop(self.ends))
        heapq.heappush(self.ends, start + lasts)
        if start > at:
            starts.append(start)
        return start, start + lasts, len(starts) - self.begun if start > at else 0


def simulate(arrivals: Iterable[tuple[int, int]], slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """Start, end and position on arrival (0: runs at once) of scans that arrive in order with (arrival, duration), first come first served."""
    line = Line(slots)
    return [line.come(*scan) for scan in arrivals]


def queued(requests: DataFrame, queue: str = "queue") -> DataFrame:
    """queue, scan_id, arrival_ms, start_ms, end_ms, position of scans (queue, scan_id, arrival_ms, duration_ms) on two slots for each queue.

    A queue is one sequence by nature: queues are dealt over tasks, a queue isn't. A task holds the line, eight bytes a scan.
    """
    kind = dict(requests.dtypes)[queue]

    def served() -> Step:
        line = Line()

        def step(opens: list[bool], batch: pd.DataFrame) -> pd.DataFrame:
            nonlocal line
            done = []
            for new, at, lasts in zip(opens, batch.arrival_ms.tolist(), batch.duration_ms.tolist(), strict=True):
                line = Line() if new else line
                done.append(line.come(at, lasts))
            start, end, position = zip(*done, strict=True)
            return batch[[queue, "scan_id", "arrival_ms"]].assign(start_ms=start, end_ms=end, position=position)

        return step

    rows = requests.select(queue, "scan_id", F.col("arrival_ms").cast("long"), F.col("duration_ms").cast("long"))
    return in_turn(rows, (queue,), ("arrival_ms", "scan_id"), served, f"{queue} {kind}, scan_id long, arrival_ms long, start_ms long, end_ms long, position long")


def queue_positions(scans: DataFrame) -> DataFrame:
    """Scans (scan_id, state running or waiting or other, enqueued_at) with position: 0 if running, the place in line if waiting, else null.

    The line is sorted in ranges, which are counted; a place is that in its range after all that stands in the ranges before.
    """
    parts = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = scans.where("state = 'waiting'").repartitionByRange(parts, "enqueued_at", "scan_id").withColumn("_range", F.spark_partition_id())
    line = written(line, "line")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = line.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("enqueued_at", "scan_id"))
    waiting = line.join(F.broadcast(counts), "_range").withColumn("position", (F.col("_before") + place).cast("long")).drop("_range", "_before")
    others = scans.where("state != 'waiting' OR state IS NULL").withColumn("position", F.when(F.col("state") == "running", F.lit(0)).cast("long"))
    return waiting.unionByName(others)


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests whose trimmed url has 1 to 2048 characters, with force false where it is not given."""
    rows = fenced(requests, {"url": T.trimmed(F.col("url")), "force": F.coalesce("force", F.lit(False))})
    return rows.where(F.length("url").between(1, 2048))


def requested_by(forwarded: Column) -> Column:
    return urls.client_ip(forwarded)
