"""The event log of scans: numbering, replay, closing, state and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions.template import looked_up
from crawlvis.operators.history import PROGRESS, progress

TERMINAL = ("done", "error")
# How long a finished scan's log is kept, and the wording of phases.
KEPT_MS = 300_000
PHASES = {"queued": "Waiting for a scanner slot…", "fetching": "Fetching raw HTML…", "rendering": "Rendering in headless browser…", "diffing": "Diffing crawler view vs rendered DOM…", "classifying": "Classifying regions…"}


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """Events with seq, from 1 in each scan."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("scan_id").orderBy(*order)).cast("long"))


def replayed(events: DataFrame, clients: DataFrame) -> DataFrame:
    """What each client (client_id, scan_id, last_event_id) still gets: later events up to the first that ends the scan."""
    ends = events.where(F.col("status").isin(*TERMINAL)).groupBy("scan_id").agg(F.min("seq").alias("_end"))
    rows = clients.join(events, "scan_id").join(ends, "scan_id", "left")
    return rows.where((F.col("seq") > F.coalesce("last_event_id", F.lit(0))) & ((F.col("seq") <= F.col("_end")) | F.col("_end").isNull())).drop("_end")


def finished_events(clients: DataFrame, scans: DataFrame) -> DataFrame:
    """For clients of finished scans, one event made from the scan's row: client_id, scan_id, seq, status, score, error_type, error_message."""
    done = scans.where(F.col("status").isin(*TERMINAL)).select("scan_id", "status", "score", "error_type", "error_message")
    return clients.join(done, "scan_id").select("client_id", "scan_id", (F.coalesce("last_event_id", F.lit(0)) + 1).cast("long").alias("seq"), "status", "score", "error_type", "error_message")


def latest_status(events: DataFrame) -> DataFrame:
    """scan_id, status, seq and progress of each scan's last event."""
    last = events.groupBy("scan_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return last.withColumn("progress", progress(F.col("status")))


def status_json() -> Column:
    """What a client that polls gets of a scan's row, as JSON; what is null is left out.

    Needs scan_id, input_url, normalized_url, status, queue_position, error_type, error_message, score, created_at, finished_at.
    """
    c = F.col
    stamp = lambda ts: F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(
        c("scan_id").cast("string").alias("id"), c("input_url").alias("url"), c("normalized_url").alias("normalizedUrl"), c("status").alias("status"), progress(c("status")).alias("progress"),
        F.when(c("status") == "queued", c("queue_position")).alias("queuePosition"), c("error_type").alias("errorType"), c("error_message").alias("message"), c("score").alias("score"),
        stamp(c("created_at")).alias("createdAt"), stamp(c("finished_at")).alias("finishedAt"),
    ))


def kept_log(events: DataFrame, now: Column) -> DataFrame:
    """Events of scans that haven't ended, or that ended within the time a log is kept."""
    ended = events.where(F.col("status").isin(*TERMINAL)).groupBy("scan_id").agg(F.min("ts").alias("_ended"))
    rows = events.join(ended, "scan_id", "left")
    return rows.where(F.col("_ended").isNull() | (F.unix_millis(now) - F.unix_millis("_ended") < KEPT_MS)).drop("_ended")


def frame(event: Column, seq: Column) -> Column:
    """An event as it goes over the wire."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\ndata: "), F.to_json(event), F.lit("\n\n"))


def frames(events: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, scan_id, seq, frame: what goes over the wire to each client (client_id, scan_id, last_event_id), in order of seq.

    Events up to the last one that a client has are left out, and so are those after the first that ends the scan. events:
    scan_id, seq, status and, optionally, further columns, which go along.
    """
    told = [c for c in events.columns if c not in ("scan_id", "seq")]
    return replayed(events, clients).select("client_id", "scan_id", "seq", frame(F.struct(*told), F.col("seq")).alias("frame"))


def phase_line(status: Column, telemetry: Column) -> Column:
    """What a phase tells: struct telemetry of url, status_code, bytes, blocked, request_count, region_count."""
    t = lambda name: telemetry[name].cast("string")
    blocked = F.when(F.coalesce(telemetry["blocked"], F.lit(False)), F.lit(" · crawler blocked — using browser view")).otherwise(F.lit(""))
    return (
        F.when(telemetry.isNull(), F.lit(""))
        .when(status == "fetching", F.coalesce(t("url"), F.lit("")))
        .when(status == "rendering", F.concat(F.lit("HTTP "), t("status_code"), F.lit(" · "), t("bytes"), F.lit(" bytes"), blocked))
        .when(status == "diffing", F.concat(t("request_count"), F.lit(" requests · "), t("region_count"), F.lit(" regions captured")))
        .when(status == "classifying", F.concat(t("region_count"), F.lit(" regions · applying issue taxonomy")))
        .otherwise(F.lit(""))
    )


def phase_text(status: Column, position: Column) -> Column:
    """The headline of a phase; the place in line while a scan waits."""
    ahead = F.concat(F.lit("Waiting — #"), position.cast("string"), F.lit(" in line"))
    return F.when((status == "queued") & (position > 0), ahead).otherwise(looked_up(PHASES, status, F.lit("Working…")))


def skeleton_verdict(verdicts: Column, i: Column) -> Column:
    """The verdict that tints bar ``i``: verdicts in turn, ok if there are none."""
    n = F.greatest(F.size(verdicts), F.lit(1))
    return F.coalesce(F.get(verdicts, F.pmod(i, n)), F.lit("ok"))


__all__ = ["PROGRESS", "TERMINAL", "finished_events", "frame", "frames", "kept_log", "latest_status", "numbered", "phase_line", "phase_text", "replayed", "skeleton_verdict", "status_json"]
