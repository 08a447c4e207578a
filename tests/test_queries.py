"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from crawlvis.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(rows, columns):
    shown = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    frame = pd.DataFrame([[shown(v) for v in r] for r in rows], columns=columns)[sorted(columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    answer = sql.execute(ORACLE_SQL[name])
    expected = plain(answer.fetchall(), [d[0] for d in answer.description])
    pd.testing.assert_frame_equal(plain(df.collect(), df.columns), expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_streams_equal_batches(spark):
    rows = lambda name, columns: sorted(map(tuple, QUERIES[name](spark, DATA).select(*columns).collect()))
    limit = ("ip", "req_id", "ts_ms", "allowed", "retry_after")
    assert rows("stream_rate_limit", limit) == rows("rate_limit", limit)
    queue = ("queue", "scan_id", "arrival_ms", "start_ms", "end_ms")
    assert rows("stream_queue", queue) == rows("queue_simulation", queue)
    log = QUERIES["stream_event_log"](spark, DATA).toPandas()
    for _, some in log.groupby("scan_id"):
        assert some.sort_values(["ts_ms", "event_id"]).seq.tolist() == list(range(1, len(some) + 1))


def test_needles_are_found_on_either_way(spark, monkeypatch):
    from crawlvis.plans import queries

    rows = lambda: sorted(map(tuple, QUERIES["passage_coverage"](spark, DATA).collect()))
    handed_out = rows()
    monkeypatch.setattr(queries, "FEW_NEEDLES", 0)
    assert rows() == handed_out and handed_out


def test_small_inputs_are_dealt_as_the_option_says(spark):
    from crawlvis.sources.shared import SPREAD_BELOW, spread

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    dealt = spread(pages)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set(SPREAD_BELOW, "0")
    assert spread(pages) is pages
    spark.conf.unset(SPREAD_BELOW)


def test_parser_and_fast_reader_agree(spark):
    fast = {r["page_id"]: r["raw_text"] for r in QUERIES["raw_text"](spark, DATA).collect()}
    slow = {r["page_id"]: r["raw_text"] for r in QUERIES["parsed_pages"](spark, DATA).collect()}
    assert fast == slow


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"scan_id", "score", "n_regions"} and df.count() == 50
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
