"""The guarded data source against a server on this machine: what is asked, looked up and read."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from crawlvis.sources import web


@pytest.fixture
def server():
    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.headers["Host"].partition(":")[0], self.path))
            status = 404 if "missing" in self.path else 200
            body = b"x" * 1000
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    made.asked = asked
    yield made
    made.shutdown()


def urls_of(server):
    hosts = ("localhost", "127.0.0.1")
    return [f"http://{h}:{server.server_port}/{p}{i}" for h in hosts for i in range(30) for p in ("page", "missing")]


def test_partitions_hold_one_host(server):
    reader = web.Reader({"urls": "\n".join([*urls_of(server), "http://[", "ftp://x/"])})
    hosts = [{web.host_of(u) for u in p.urls} for p in reader.partitions()]
    assert all(len(h) == 1 for h in hosts) and sum(len(p.urls) for p in reader.partitions()) == 122 and max(len(p.urls) for p in reader.partitions()) <= web.URLS_PER_PARTITION


def test_hosts_are_looked_up_once(server):
    looked = []

    def lookup(host):
        looked.append(host)
        if host == "nowhere.example":
            raise OSError
        return ["127.0.0.1"]

    names = web.Names(lookup)
    urls = [f"http://{h}:{server.server_port}/page" for h in ("a.example", "a.example", "b.example", "nowhere.example", "nowhere.example", "a.example")]
    rows = [web.fetch(u, "bot", allow_local=True, names=names) for u in urls]
    assert looked == ["a.example", "b.example", "nowhere.example"]
    assert [r[3] for r in rows] == [200, 200, 200, None, None, 200] and [r[1] for r in rows] == ["a.example"] * 2 + ["b.example"] + ["nowhere.example"] * 2 + ["a.example"]
    assert web.fetch(urls[0], "bot", names=names)[-1] == "ssrf_blocked"


def test_filters_reach_the_source(spark, server):
    spark.dataSource.register(web.GuardedHttp)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda: spark.read.format("guarded_http").option("urls", "\n".join(urls_of(server))).option("allowLocal", "true").load()
    rows = read().where((F.col("host") == "localhost") & F.col("status").isin(200, 201) & (F.length("html") > 0)).collect()
    assert len(rows) == 30 and {r["host"] for r in rows} == {"localhost"} and {len(r["html"]) for r in rows} == {1000}
    assert {h for h, _ in server.asked} == {"localhost"} and len(server.asked) == 60
    server.asked.clear()
    assert read().where("host = 'no.example'").count() == 0 and not server.asked
    assert read().where("error_type is null").count() == 120


def test_bodies_of_other_statuses_are_not_read(server):
    row = web.fetch(f"http://localhost:{server.server_port}/missing", "bot", allow_local=True, wanted=lambda status: status == 200)
    assert row[3] == 404 and row[5] == 0
