"""Queries over stores of versions and over streams whose state comes to an end; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.plans import oracle
from crawlvis.plans.oracle import NL
from crawlvis.sources.shared import new_path
from crawlvis.sources.store import Store, last_done
from crawlvis.sources.tables import table
from crawlvis.streaming import delivery, scans, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Parts of a table's time that its streams take one after the other.
BATCHES = 3


def query(function):
    QUERIES[function.__name__] = function
    return function


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stored_scans(spark, sf_dir):
    """Scans that are inserted, of which two thirds are updated once and a third twice: the rows of those asked for."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), F.col("event_type").alias("detail"))
    version = lambda n, status: rows.where(F.col("scan_id") % 3 >= n - 1).select("scan_id", F.lit(n).cast("long").alias("version"), F.lit(status).alias("status"), "detail")
    store = Store.made(version(1, "queued"), "stored_scans")
    store.append(version(2, "fetching"))
    store.append(version(3, "done"))
    asked = rows.where("scan_id % 100 = 0").select("scan_id").unionByName(rows.where("scan_id % 100 = 0").select(-F.col("scan_id") - 1).toDF("scan_id"))  # half of them aren't there
    return store.rows_of(asked)


SQL["stored_scans"] = "SELECT event_id AS scan_id, event_id % 3 + 1 AS version, ['queued', 'fetching', 'done'][event_id % 3 + 1] AS status, event_type AS detail FROM events WHERE event_id % 100 = 0"


@query
def last_done_scans(spark, sf_dir):
    """The last done scan of the twenty URLs of the greatest names, from a store by URL."""
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("normalized_url"), F.lit(1).alias("version"), F.col("event_id").alias("scan_id"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("done")).alias("status"), F.floor("value").cast("long").alias("score"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("finished_at"),
    )
    names = [r[0] for r in rows.groupBy("normalized_url").agg(F.count("*")).select("normalized_url").orderBy(F.desc("normalized_url")).limit(20).collect()]
    store = Store.made(rows, "scans_by_url", key="normalized_url")
    return last_done(store, *names, "u").select("normalized_url", "scan_id", "score")


SQL["last_done_scans"] = """WITH e AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS normalized_url, event_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts FROM events),
t AS (SELECT DISTINCT normalized_url FROM e ORDER BY normalized_url DESC LIMIT 20),
k AS (SELECT normalized_url, event_id AS scan_id, CAST(floor(value) AS BIGINT) AS score, row_number() OVER (PARTITION BY normalized_url ORDER BY ts DESC, event_id DESC) AS n FROM e SEMI JOIN t USING (normalized_url) WHERE event_type <> 'error' AND event_id % 7 <> 0)
SELECT normalized_url, scan_id, score FROM k WHERE n = 1"""


@query
def expiring_rate_limit(spark, sf_dir):
    """Admission on a stream in several batches, whose addresses are forgotten a window after their last request."""
    with stateful.rocks(spark):
        rows = stateful.in_order(_events(spark, sf_dir).select(F.col("event_id").alias("req_id"), F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(5)).cast("string")).alias("ip"), "ts"), "ts", BATCHES, "requests", stateful.MOST_ROWS)
        return scans.completed(stateful.rate_limited(rows), "expiring-limit")


# The plain limiter in SQL: all that passed are known only one after the other, so they are folded.
SQL["expiring_rate_limit"] = """WITH RECURSIVE e AS (SELECT event_id AS req_id, event_type || '-' || (user_id % 5) AS ip, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_ms, req_id) AS k FROM e),
r AS (
  SELECT ip, req_id, ts_ms, k, [ts_ms] AS stamps, TRUE AS allowed, 0 AS retry_after FROM n WHERE k = 1
  UNION ALL
  SELECT ip, req_id, ts_ms, k, CASE WHEN len(live) < 10 THEN live || [ts_ms] ELSE live END, len(live) < 10, CASE WHEN len(live) < 10 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 60000 - ts_ms) / 1000) AS BIGINT)) END
  FROM (SELECT n.*, list_filter(r.stamps, lambda s: s > n.ts_ms - 60000) AS live FROM r JOIN n ON n.ip = r.ip AND n.k = r.k + 1)
)
SELECT ip, req_id, ts_ms, allowed, CAST(retry_after AS BIGINT) AS retry_after FROM r"""


@query
def expiring_event_log(spark, sf_dir):
    """Numbers of events on a stream in several batches; a log ends some minutes after its scan, and what follows is another."""
    with stateful.rocks(spark):
        rows = stateful.in_order(_events(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "event_id", "ts", F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_id") % 3 == 0, F.lit("done")).otherwise(F.lit("fetching")).alias("status")), "ts", BATCHES, "events")
        return scans.completed(stateful.event_log(rows), "expiring-log")


SQL["expiring_event_log"] = """WITH RECURSIVE e AS (SELECT user_id AS scan_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ts_ms, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'done' ELSE 'fetching' END AS status FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts_ms, event_id) AS k FROM e),
r AS (
  SELECT scan_id, event_id, ts_ms, status, k, CAST(1 AS BIGINT) AS seq, CASE WHEN status <> 'fetching' THEN ts_ms ELSE -1 END AS ended FROM n WHERE k = 1
  UNION ALL
  SELECT scan_id, event_id, ts_ms, status, k, CASE WHEN anew THEN 1 ELSE seq + 1 END, CASE WHEN (anew OR ended < 0) AND status <> 'fetching' THEN ts_ms WHEN anew THEN -1 ELSE ended END
  FROM (SELECT n.*, r.seq, r.ended, r.ended >= 0 AND n.ts_ms - r.ended >= 300000 AS anew FROM r JOIN n ON n.scan_id = r.scan_id AND n.k = r.k + 1)
)
SELECT scan_id, event_id, ts_ms, status, seq FROM r"""


@query
def stream_reuse_of_streams(spark, sf_dir):
    """Requests of a stream with scans of another that they may reuse."""
    rows = _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("normalized_url"), "ts")
    with stateful.rocks(spark):
        both = stateful.in_order(rows, "ts", BATCHES, "reuse")
        asked = both.where("event_id % 3 = 0").select(F.col("event_id").alias("req_id"), "normalized_url", "ts", (F.col("event_id") % 2 == 0).alias("force"))
        done = both.where("event_id % 3 != 0").select(F.col("event_id").alias("scan_id"), "normalized_url", F.col("ts").alias("finished_at"))
        return scans.completed(stateful.reused(asked, done), "reuse")


SQL["stream_reuse_of_streams"] = oracle.SQL["dedupe_cached"]


@query
def delivered_frames(spark, sf_dir):
    """Frames of a stream's events in several batches, taken by a sink that commits."""
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scan_id"), (F.col("turn") + 1).cast("long").alias("seq"), F.when(F.col("turn") >= 5, F.lit("done")).otherwise(F.lit("fetching")).alias("status"), F.timestamp_seconds("turn").alias("ts"))
    clients = log.select("scan_id").distinct().select(F.col("scan_id").alias("client_id"), "scan_id", F.pmod("scan_id", F.lit(3)).cast("long").alias("last_event_id"))
    with stateful.rocks(spark):
        return delivery.drained(stateful.delivered(stateful.in_order(log, "ts", BATCHES, "log").drop("ts"), clients), new_path(spark, "delivered"))


SQL["delivered_frames"] = f"""WITH l AS (SELECT conv_id, turn + 1 AS seq, CASE WHEN turn >= 5 THEN 'done' ELSE 'fetching' END AS status FROM conversations)
SELECT conv_id AS client_id, conv_id AS scan_id, seq, 'id: ' || seq || {NL} || 'data: {{"status":"' || status || '"}}' || {NL} || {NL} AS frame FROM l WHERE seq > conv_id % 3 AND seq <= 6"""
