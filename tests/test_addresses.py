"""Keys of URLs and forms of hosts, against results written by hand and Python's own coding of names."""

import pytest
from pyspark.sql import functions as F

from crawlvis.functions import hosts, urls
from crawlvis.operators import responses

NAMES = ["bücher.example", "faß.de", "例え.テスト", "пример.испытание", "ñandú.cl", "x😀y.com", "ÀÉÎ.fr", "a", "ليهمابتكلموشعربي؟", "他们为什么不说中文", "Pročprostěnemluvíčesky", "ab-ñ-cd-é.e", "ééé", "üüüaaa", "z" * 50 + "ÿ" * 9]
HOSTS = {
    "0x7f.1": "127.0.0.1", "192.168.0.1.": "192.168.0.1", "1.2.3.4.5": None, "256.1.1.1": None, "0300.0250.1": "192.168.0.1", "4294967295": "255.255.255.255", "4294967296": None, "1.2.3": "1.2.0.3", "0x": "0.0.0.0",
    "foo.0x4": None, "foo.1a": "foo.1a", "EXAMPLE.com": "example.com", "ex%41mple.com": "example.com", "a b": None, "a|b": None, "%zz": None, "": None, "1..2": None, "a..b": "a..b", "08": None, "9" * 25: None, "a+b.com": "a+b.com", "ｅｘ．com": "ex.com",
    "[::1]": "[::1]", "[2001:DB8:0:0:1:0:0:1]": "[2001:db8::1:0:0:1]", "[::ffff:1.2.3.4]": "[::ffff:102:304]", "[0:0:0:0:0:0:0:0]": "[::]", "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "[1:2:3:4:5:6:0:8]": "[1:2:3:4:5:6:0:8]", "[zz]": None, "[::1": None,
}
URLS = {
    "javascript:alert(1)": None, "data:text": None, "http://a:b:c/": None, "http://a:99999/": None, "http://a:65535/": "http://a:65535/", "http://a:/": "http://a/", "http://a:00080/x/": "http://a/x", "http://a b/": None, "": None, "https://": None,
    "x.com?b=1&B=2": "https://x.com/?b=1&B=2", "x.com?a1=1&a_1=2": "https://x.com/?a_1=2&a1=1", "x.com?z=1&é=2&f=3&e=4": "https://x.com/?e=4&%C3%A9=2&f=3&z=1", "x.com?B=1&a=2&b=3&A=4": "https://x.com/?a=2&A=4&b=3&B=1", "x.com?a=2&b=0&a=1": "https://x.com/?a=2&a=1&b=0",
    "http://Bücher.Example:80/ä ö?q=a b": "http://xn--bcher-kva.example/%C3%A4%20%C3%B6?q=a+b", "http://0x7f.1/": "http://127.0.0.1/", "http://256.256.256.256/": None, "http://[::1]:8080/": "http://[::1]:8080/", "localhost:3000/x": "https://localhost:3000/x",
    "http://x.com\\a?b\\c": "http://x.com/a?b%5Cc=", "http://u:p@x@h.com/": "http://u:p%40x@h.com/", "http://u:@h/": "http://u@h/", "http://:@h/": "http://h/", "ws://x:80/": "ws://x/", "http://x.com/a/../b/./c/": "http://x.com/b/c", "http://h/?utm_source=1&gclid=2&x": "http://h/?x=",
}


def column(spark, values, function):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", function(F.col("x")).alias("y"))
    return {r["x"]: r["y"] for r in rows.collect()}


def test_names_beyond_ascii(spark):
    coded = lambda label: "xn--" + label.encode("punycode").decode() if not label.isascii() else label
    assert column(spark, NAMES, hosts.ascii_name) == {n: ".".join(map(coded, n.lower().split("."))) for n in NAMES}


def test_hosts(spark):
    assert column(spark, HOSTS, hosts.canonical) == HOSTS


def test_keys_of_urls(spark):
    assert column(spark, URLS, urls.normalized) == URLS
    assert column(spark, URLS, urls.is_valid) == {u: k is not None for u, k in URLS.items()}


@pytest.mark.parametrize("host,error", [("0x7f.1", "ssrf_blocked"), ("192.168.0.1.", "ssrf_blocked"), ("[::ffff:a00:1]", "ssrf_blocked"), ("134744072", None), ("BÜCHER.example", None), ("no.example", "dns_or_network"), ("a b", "dns_or_network"), ("x.localhost", "ssrf_blocked")])
def test_hosts_are_judged_in_any_spelling(spark, host, error):
    dns = spark.createDataFrame([("bücher.example", "93.184.216.34", 4)], "host string, address string, family int")
    assert responses.host_verdicts(spark.createDataFrame([(host,)], "host string"), dns).first()["error_type"] == error
