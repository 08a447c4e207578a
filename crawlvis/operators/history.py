"""Scans over time: previous scans, cached results, recent lists, comparison of rescans, sinks of scan rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions import text as T
from crawlvis.functions import wording as W
from crawlvis.functions.template import looked_up
from crawlvis.operators.admission import Step, in_turn
from crawlvis.operators.asof import last_before
from crawlvis.sources.shared import written

# The window of reuse, the recent list, the likeness of names, and states of a scan.
DEDUPE_MS = 600_000
RECENT_TAKEN, RECENT_SHOWN = 60, 8
SIMILAR_NAMES = 0.6
IN_FLIGHT = ("queued", "fetching", "rendering", "diffing", "classifying")
PROGRESS = {"queued": 0.0, "fetching": 0.2, "rendering": 0.45, "diffing": 0.7, "classifying": 0.9, "done": 1.0, "error": 1.0}
RAW_TEXT_CAP = 500_000


def milliseconds(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def score_deltas(scans: DataFrame) -> DataFrame:
    """Done scans with prev_scan_id, prev_score and score_delta, from the done scan of the same URL that finished last before.

    scans: scan_id, normalized_url, status, score, finished_at. The first scan of a URL has nulls.
    """
    done = scans.where("status = 'done' and finished_at is not null")
    done = last_before(done, "normalized_url", milliseconds(F.col("finished_at")), ("finished_at", "scan_id"), F.struct("scan_id", "score"), "_before")
    return done.withColumns({"prev_scan_id": F.col("_before.scan_id"), "prev_score": F.col("_before.score"), "score_delta": F.col("score") - F.col("_before.score")}).drop("_before")


def is_recent(finished: Column, now: Column, window_ms: int = DEDUPE_MS) -> Column:
    """Finished within the window before now: not in the future, and less than the whole window ago."""
    age = milliseconds(now) - milliseconds(finished)
    return (age >= 0) & (age < window_ms)


def cached_scans(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Requests with the scan they may reuse, cached_scan_id, and its age_seconds; null where there is none or reuse is refused.

    requests: req_id, normalized_url, ts, force. scans: scan_id, normalized_url, finished_at of done scans. An as-of join as a union and a
    running last value, so a URL with very many rows is never paired, and is sorted day by day.
    """
    asked = requests.select("normalized_url", F.col("ts").alias("at"), F.lit(1).alias("side"), F.struct("req_id", "force").alias("req"), F.lit(None).cast("struct<scan_id:bigint,finished_at:timestamp>").alias("scan"))
    made = scans.where("finished_at is not null").select("normalized_url", F.col("finished_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["req"].dataType).alias("req"), F.struct(F.col("scan_id").cast("long").alias("scan_id"), F.col("finished_at").cast("timestamp").alias("finished_at")).alias("scan"))
    rows = last_before(asked.unionByName(made), "normalized_url", milliseconds(F.col("at")), ("at", "side", "scan"), F.col("scan"), "last").where("side = 1")
    good = ~F.coalesce("req.force", F.lit(False)) & is_recent(F.col("last.finished_at"), F.col("at"))
    age = F.floor((milliseconds(F.col("at")) - milliseconds(F.col("last.finished_at"))) / 1000 + 0.5).cast("long")
    return rows.select("req.req_id", "normalized_url", F.when(good, F.col("last.scan_id")).alias("cached_scan_id"), F.when(good, age).alias("age_seconds"))


def recent_scans(scans: DataFrame, shown: int = RECENT_SHOWN, taken: int = RECENT_TAKEN) -> DataFrame:
    """The latest scan of each URL, newest first, among the newest done scans. What the first limit leaves out isn't looked for."""
    newest = scans.where("status = 'done'").orderBy(F.col("finished_at").desc_nulls_last(), F.col("scan_id").desc()).limit(taken)
    first = F.row_number().over(Window.partitionBy("normalized_url").orderBy(F.desc("finished_at"), F.desc("scan_id")))
    latest = newest.where("score is not null and finished_at is not null").withColumn("_n", first).where("_n = 1").drop("_n")
    return latest.orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(shown)


def change_kind(before: Column, after: Column) -> Column:
    a, b = looked_up(W.VERDICT_RANK, before), looked_up(W.VERDICT_RANK, after)
    return F.when(b > a, F.lit("improved")).when(b < a, F.lit("regressed")).otherwise(F.lit("unchanged"))


def name_similarity(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two names' sets of words; 0 if either has none."""
    x, y = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(T.fraction(common, F.size(x) + F.size(y) - common))


def selector_matches(prev: DataFrame, next_: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Regions of two scans with equal selectors, the k-th of one with the k-th of the other: pair, prev_ord, next_ord."""
    nth = lambda df, name: df.select(pair, "selector", F.col("region_ord").alias(name), F.row_number().over(Window.partitionBy(pair, "selector").orderBy("region_ord")).alias("k"))
    return nth(prev, "prev_ord").join(nth(next_, "next_ord"), [pair, "selector", "k"]).select(pair, "prev_ord", "next_ord")


def _taking(pair: str) -> Step:
    """Of candidates in order of the next region, their likeness and the previous region, those of which neither region is taken."""
    prev_taken, next_taken = set(), set()

    def step(opens: list[bool], batch: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for new, before, after in zip(opens, batch.prev_ord.tolist(), batch.next_ord.tolist(), strict=True):
            if new:
                prev_taken.clear()
                next_taken.clear()
            free = before not in prev_taken and after not in next_taken
            kept.append(free)
            if free:
                prev_taken.add(before)
                next_taken.add(after)
        return batch.loc[kept, [pair, "prev_ord", "next_ord"]]

    return step


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one pair that are taken."""
    rows = group.assign(unlike=-group.similarity).sort_values(["next_ord", "unlike", "prev_ord"])
    return _taking(group.columns[0])([False] * len(rows), rows)


def name_pairs(prev: DataFrame, next_: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair, prev_ord, next_ord, similarity of the regions of two scans whose names have a word in common; others are never paired."""
    words = lambda df, name: df.select(pair, F.col("region_ord").alias(name), F.array_distinct(T.tokens(F.col("name"))).alias("w"))
    a, b = words(prev, "prev_ord"), words(next_, "next_ord")
    parts = lambda df, name: df.select(pair, name, F.size("w").alias(f"n_{name}"), F.explode("w").alias("word"))
    common = parts(a, "prev_ord").join(parts(b, "next_ord"), [pair, "word"]).groupBy(pair, "prev_ord", "next_ord", "n_prev_ord", "n_next_ord").agg(F.count("*").alias("common"))
    return common.select(pair, "prev_ord", "next_ord", (F.col("common") / (F.col("n_prev_ord") + F.col("n_next_ord") - F.col("common"))).alias("similarity"))


def name_matches(prev: DataFrame, next_: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Likeness matches of regions that are left: pair, prev_ord, next_ord. Candidates share a word of their names within a pair.

    Each next region in order takes the likest region that is left, the first of several that are alike. Candidates come
    in that order, so what a task holds of a pair is which regions are taken.
    """
    kind = dict(prev.dtypes)[pair]
    scored = name_pairs(prev, next_, pair).where(F.col("similarity") >= SIMILAR_NAMES).withColumn("unlike", -F.col("similarity"))

    return in_turn(scored, (pair,), ("next_ord", "unlike", "prev_ord"), lambda: _taking(pair), f"{pair} {kind}, prev_ord long, next_ord long")


def region_changes(prev: DataFrame, next_: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair, change_ord, selector, name, change, and status and issue before and after. Matched regions come first, then new, then removed ones.

    prev, next_: pair, region_ord, selector, name, status, issue_type.
    """
    by_selector = selector_matches(prev, next_, pair)
    left_prev = prev.join(by_selector.select(pair, F.col("prev_ord").alias("region_ord")), [pair, "region_ord"], "left_anti")
    left_next = next_.join(by_selector.select(pair, F.col("next_ord").alias("region_ord")), [pair, "region_ord"], "left_anti")
    by_name = written(name_matches(left_prev, left_next, pair), "name_matches")  # read three times
    matched = by_selector.withColumn("part", F.lit(0)).unionByName(by_name.withColumn("part", F.lit(1)))
    fields = ("selector", "name", "status", "issue_type")
    side = lambda df, name: df.select(pair, F.col("region_ord").alias(f"{name}_ord"), F.struct(*fields).alias(name))
    pairs = matched.join(side(prev, "prev"), [pair, "prev_ord"]).join(side(next_, "next"), [pair, "next_ord"])
    none = F.lit(None).cast("string")
    both = pairs.select(pair, "part", F.col("next_ord").alias("ord"), F.col("next.selector").alias("selector"), F.col("next.name").alias("name"), change_kind(F.col("prev.status"), F.col("next.status")).alias("change"),
                        F.col("prev.status").alias("before_status"), F.col("prev.issue_type").alias("before_issue"), F.col("next.status").alias("after_status"), F.col("next.issue_type").alias("after_issue"))
    fresh = left_next.join(by_name.select(pair, F.col("next_ord").alias("region_ord")), [pair, "region_ord"], "left_anti").select(
        pair, F.lit(2).alias("part"), F.col("region_ord").alias("ord"), "selector", "name", F.lit("new").alias("change"), none.alias("before_status"), none.alias("before_issue"), F.col("status").alias("after_status"), F.col("issue_type").alias("after_issue"))
    gone = left_prev.join(by_name.select(pair, F.col("prev_ord").alias("region_ord")), [pair, "region_ord"], "left_anti").select(
        pair, F.lit(3).alias("part"), F.col("region_ord").alias("ord"), "selector", "name", F.lit("removed").alias("change"), F.col("status").alias("before_status"), F.col("issue_type").alias("before_issue"), none.alias("after_status"), none.alias("after_issue"))
    rows = both.unionByName(fresh).unionByName(gone)
    order = F.row_number().over(Window.partitionBy(pair).orderBy("part", "ord")).cast("long")
    return rows.withColumn("change_ord", order).drop("part", "ord")


def change_counts(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("improved", "regressed", "unchanged", "new", "removed")])


def regions_with_change(regions: DataFrame, changes: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Regions with the change of their selector; the last one where a selector has several, null where it has none."""
    last = changes.groupBy(pair, "selector").agg(F.max_by("change", "change_ord").alias("change"))
    return regions.join(last, [pair, "selector"], "left")


def swept(scans: DataFrame, now: Column) -> DataFrame:
    """Scans after a restart: those in flight have failed now, others are as they were."""
    hit = F.col("status").isin(*IN_FLIGHT)
    kind, message = W.SWEPT
    new = {"status": F.lit("error"), "error_type": F.lit(kind), "error_message": F.lit(message), "finished_at": now}
    return scans.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def capped_text(text: Column, cap: int = RAW_TEXT_CAP) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(W.TRUNCATED))).otherwise(text)


def new_scans(requests: DataFrame) -> DataFrame:
    """Rows to insert for requests that pass: status queued, the trimmed input and its key. Invalid ones have an error instead."""
    from crawlvis.functions import urls

    url = T.trimmed(F.col("url"))
    good = F.length(url).between(1, 2048) & urls.normalized(url).isNotNull()
    return requests.select(F.col("req_id").alias("scan_id"), url.alias("input_url"), urls.normalized(url).alias("normalized_url"), F.when(good, F.lit("queued")).otherwise(F.lit("error")).alias("status"), F.when(~good, F.lit("invalid_url")).alias("error_type"), F.col("ts").alias("created_at"))


def latest_rows(versions: DataFrame, key: str = "scan_id", at: str = "version") -> DataFrame:
    """The newest row of each key: a table that is only appended to, read as if rows had been updated."""
    other = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*other), at).alias("_row")).select(key, "_row.*")


def progress(status: Column) -> Column:
    return looked_up(PROGRESS, status, F.lit(0.0))


def time_ago(ts: Column, now: Column) -> Column:
    """A rough age in words, never in the future."""
    seconds = F.greatest(F.lit(0), F.floor((milliseconds(now) - milliseconds(ts)) / 1000 + 0.5))
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(seconds < 60, F.lit("just now")).when(minutes < 60, told(minutes, "min")).when(hours < 24, told(hours, "h")).otherwise(told(days, "d"))


def age_minutes(ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((milliseconds(now) - milliseconds(ts)) / 60000 + 0.5))
