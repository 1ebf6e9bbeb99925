"""Revisit resolution against a plain search."""

import datetime as dt
import random

import pytest

from loomspace.llm import warc
from pyspark.sql import functions as F

SCHEMA = "record_id long, kind string, url string, ts timestamp, status int, etag string, last_modified string, digest string, headers map<string,string>, body string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def clean(tag):
    return (tag.strip().removeprefix("W/") or None) if tag is not None else None


def brute(rows, canonical):
    full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[3] is not None and canonical[r[0]]]
    out = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        field = next((k for k in (5, 6, 7) if r[k] and (k != 5 or clean(r[k]))), None)
        agree = lambda x: (clean(x[5]) == clean(r[5])) if field == 5 else x[field] == r[field]
        met = [x for x in full if field and r[3] is not None and canonical[x[0]] == canonical[r[0]] and x[3] <= r[3]]
        latest = max(met, key=lambda x: (x[3], x[0]), default=None)
        out[r[0]] = latest[0] if latest and agree(latest) else None
    return out


@pytest.mark.parametrize("stretches", [1, 7, 256])
def test_against_search(spark, monkeypatch, stretches):
    monkeypatch.setattr(warc, "STRETCHES", stretches)
    r = random.Random(stretches)
    urls = ["http://A.example/x", "https://www.a.example:443/x#f", "http://a.example/x?utm_source=q", "http://b.example", "http://b.example/", None, "nonsense"]
    rows = []
    for k in range(400):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        pick = lambda *x: r.choice(x)
        rows.append((k, kind, r.choice(urls), r.choice([None] + [T0 + dt.timedelta(seconds=r.randrange(500)) for _ in range(8)]), pick(200, 200, 404) if kind == "response" else 304, pick('"1"', 'W/"1"', '"2"', None, None, ""), pick("m1", "m2", None), pick("d1", None), {"ETag": "e", "X": str(k)}, f"b{k}"))
    frame = spark.createDataFrame(rows, SCHEMA)
    canonical = {x.record_id: x.c for x in frame.select("record_id", warc.canonical_url(F.col("url")).alias("c")).collect()}
    got = warc.resolve_revisits(frame).collect()
    assert {x.record_id: x.response_id for x in got} == brute(rows, canonical)
    assert all(x.body == (None if x.response_id is None else f"b{x.response_id}") for x in got)


def test_canonical_url(spark):
    same = ["http://Example.com", "https://www.example.com/", "http://u:p@example.com:80/#x", "HTTP://EXAMPLE.com/?utm_source=a&gclid=b"]
    got = spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u")).alias("c")).distinct().collect()
    assert [x.c for x in got] == ["example.com/"]
    got = spark.createDataFrame([("http://e.x/p?b=2&a=1",), ("http://e.x/p?a=1&b=2#z",)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).distinct().collect()
    assert [x.c for x in got] == ["e.x/p?a=1&b=2"]


def test_headers_and_empty_table(spark):
    rows = [(1, "response", "http://a/x", T0, 200, '"q"', None, "d", {"Content-Type": "t", "Date": "1", "ETag": "old"}, "body"), (2, "revisit", "http://a/x", T0, 304, 'W/"q"', None, None, {"date": "2", "Content-Type": "no", "Server": "s"}, None), (2, "revisit", "http://a/x", T0, 304, 'W/"q"', None, None, {"date": "2"}, None)]
    got = warc.resolve_revisits(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert got[0].headers == {"content-type": "t", "date": "2", "etag": "old"} and got[0].body == "body" and got[0].age_s == 0
    assert len(warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()) == 2
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_latest_response_decides(spark):
    """A revisit for the first of two versions is refused once the second is captured; a body of any length comes along."""
    long = "x" * 2_000_000
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "response", "http://a/x", at(0), 200, '"1"', None, None, None, "one"), (2, "response", "http://a/x", at(10), 200, '"2"', None, None, None, long)]
    rows += [(3, "revisit", "http://a/x", at(5), 304, '"1"', None, None, None, None), (4, "revisit", "http://a/x", at(20), 304, '"1"', None, None, None, None), (5, "revisit", "http://a/x", at(20), 304, '"2"', None, None, None, None)]
    got = {x.record_id: (x.response_id, x.body) for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: (1, "one"), 4: (None, None), 5: (2, long)}


def test_repeated_records_and_other_columns(spark):
    """Repeated responses are one, repeated revisits each get their row, and columns of any name are ignored."""
    full = (1, "response", "http://a/x", T0, 200, '"q"', None, "d", {"A": "1"}, "body")
    ask = (2, "revisit", "http://a/x", T0, 304, '"q"', None, None, {"date": "2"}, None)
    rows = [full, full, full[:8] + ({"A": "0"}, "body"), ask, ask, ask[:8] + ({"date": "3"}, None), (3, None, None, None, None, None, None, None, None, None), (None,) + ask[1:]]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("canonical", "full", "latest", "response", "key", "at", "stretch", "response_id"):
        frame = frame.withColumn(name, F.lit(7))
    got = warc.resolve_revisits(frame).collect()
    assert sorted((x.record_id, x.response_id, x.headers["date"], x.headers["a"]) for x in got) == [(2, 1, "2", "0"), (2, 1, "2", "0"), (2, 1, "3", "0")]
