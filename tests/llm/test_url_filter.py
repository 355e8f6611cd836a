from __future__ import annotations

import datetime as dt

from treeloom.llm import url_filter


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_filter(spark):
    log = spark.createDataFrame([
        ("bad.com", day(5), "on", "spam"), ("bad.com", day(10), "off", "spam"), ("bad.com", day(20), "on", "adult"), ("x.bad.com", day(8), "on", "malware"),
        ("tie.org", day(3), "off", "a"), ("tie.org", day(3), "on", "b"), (None, day(1), "on", "c"), ("n.org", None, "on", "c"),
    ], "pattern string, at date, action string, category string")
    urls = ["http://bad.com/a", "https://user@X.BAD.com:80/p?q", "http://notbad.com", "http://tie.org.", "nonsense", None, "http://n.org"]
    days = [4, 5, 9, 10, 19, 20, 400]
    captures = spark.createDataFrame([(100 * i + k, u, day(k) if k < 400 else None) for i, u in enumerate(urls) for k in days], "key long, url string, fetched_at date")
    got = {r["key"]: r for r in url_filter.filter_captures(captures, log).collect()}
    assert len(got) == captures.count()

    def active(hosts, k):
        spans = [("bad.com", 5, 10), ("bad.com", 20, 999), ("x.bad.com", 8, 999), ("tie.org", 3, 999)]
        return [p for p, a, b in spans if p in hosts and k != 400 and a <= k < b]

    hosts = [{"bad.com"}, {"bad.com", "x.bad.com"}, {"notbad.com"}, {"tie.org"}, set(), set(), {"n.org"}]
    for i, h in enumerate(hosts):
        for k in days:
            r, want = got[100 * i + k], active(h, k)
            assert r["n_active"] == len(want) and r["blocked"] == bool(want), (urls[i], k)
            assert r["pattern"] == (max(want, key=len) if want else None)
    assert got[104]["host"] == "x.bad.com" and got[404]["host"] is None


def test_empty(spark):
    log = spark.createDataFrame([], "pattern string, at date, action string, category string")
    captures = spark.createDataFrame([(1, "http://a.b", day(1))], "key long, url string, fetched_at date")
    assert url_filter.filter_captures(captures, log).first()["blocked"] is False
    assert url_filter.filter_captures(captures.filter("false"), log).count() == 0


def test_addresses(spark):
    from pyspark.sql import functions as F

    from treeloom.llm.url_filter import host_of, patterns_of

    rows = spark.createDataFrame([("http://[2001:db8::1]:80/x",), ("http://10.0.0.1/y",), ("http://u@a.b.c:1/",)], "url string")
    got = [[p["pattern"] for p in r["p"]] for r in rows.select(patterns_of(host_of("url")).alias("p"), F.monotonically_increasing_id().alias("i")).collect()]
    assert [set(g) for g in got] == [{"[2001:db8::1]"}, {"10.0.0.1"}, {"a.b.c", "b.c"}]
