"""WARC: not-modified revisits resolved by an as-of join.

A revisit record carries no body. It is joined as of its date with the latest earlier full response of the same canonical
URL, and stands for that response if their validators agree: the revisit's ETag must equal the response's (weak tags compare
without `W/`), or, where it has none, its Last-Modified must, or its payload digest. A revisit whose latest response has
another validator is refused: the copy that it confirms is not the one at hand. The resolved record takes the response's body
and headers, with those headers replaced that a 304 answer may update.

Responses and revisits go by canonical URL and time. A URL with any share of all captures is split into stretches of time,
more of them the more captures there are; the last response of each stretch is carried over the stretches after it, which
are few rows, and the rest is a window within one stretch. Bodies are joined to their ids once, those of full responses alone.

Defined results: a revisit without a matching latest response, URL, date or validator stays unresolved (response_id null);
equal dates go by record id, a response before a revisit; repeated revisits each get their row, repeated responses of one id
are one (the least of their rows); bodies may be empty, null or of any length; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise

STRETCHES = 256  #: of time at least, in which the captures of a URL are joined
ROWS = 1_000_000  #: captures a stretch of time, about
# Header fields that a 304 answer sends and a cache updates (RFC 9110, 15.4.5).
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't change what is fetched.
TRACKING = "utm_[a-z]+|gclid|fbclid|sessionid|ref"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without `www.`, default port, user, fragment or tracking parameters; `/` for an empty path;
    http and https are one; parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(u, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)")))
    full = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", full)


def validator(etag: Column, modified: Column, digest: Column) -> Column:
    """What a revisit must share with its response: the ETag, else the date, else the digest."""
    tag = F.regexp_replace(F.trim(etag), "^W/", "")
    return F.coalesce(F.concat(F.lit("e:"), F.nullif(tag, F.lit(""))), F.concat(F.lit("m:"), F.nullif(F.trim(modified), F.lit(""))), F.concat(F.lit("d:"), F.nullif(digest, F.lit(""))))


def merge_headers(full: Column, sent: Column) -> Column:
    """The response's headers with those replaced that a 304 may update; names are compared in lower case."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    new = F.map_filter(low(sent), lambda k, _: k.isin(*UPDATED))
    return F.map_concat(F.map_filter(low(full), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, keep_body: bool = True) -> DataFrame:
    """Revisits of ``records`` (record_id long, kind, url, ts timestamp, status int, etag, last_modified, digest, headers
    map<string,string>, body) with their response: record_id, canonical, response_id, age_s, and merged headers and body."""
    names = ("etag", "last_modified", "digest")
    base = records.select(
        F.col("record_id").cast("long").alias("record_id"), (F.col("kind") == "response").alias("full"), canonical_url(F.col("url")).alias("canonical"),
        F.col("ts").cast("timestamp").alias("ts"), *names, "headers", *(["body"] if keep_body else []),
        F.coalesce(F.when(F.col("kind") == "response", F.col("status").cast("int") == 200).otherwise(F.col("kind") == "revisit"), F.lit(False)).alias("usable"),
    )
    base = base.filter("usable and record_id is not null")
    full = base.filter("full").drop("usable", "full")
    asked = validator(*(F.col(c) for c in names)).alias("asked")
    # rows of one revisit that are alike ask once and are each answered
    asking = base.filter("not full").select("record_id", "canonical", "ts", asked, F.xxhash64("canonical", "ts", *names).alias("key"), F.col("headers").alias("sent"))
    seconds = F.unix_micros("ts")
    at = F.struct(seconds.alias("t"), (~F.col("full")).alias("later"), F.col("record_id").alias("id"))
    dated = full.select("canonical", "ts", F.lit(True).alias("full"), "record_id", F.lit(0).cast("long").alias("key"))
    dated = dated.union(asking.filter("asked is not null").select("canonical", "ts", F.lit(False), "record_id", "key").distinct())
    rows = dated.filter("canonical is not null and ts is not null").withColumn("at", at)
    bounds = rows.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b"), F.count("*").alias("n")).first()
    stretches = max(STRETCHES, bounds.n // ROWS)
    low, wide = bounds.a or 0, max(1, ((bounds.b or 0) - (bounds.a or 0)) // stretches + 1)
    rows = rows.withColumn("stretch", F.floor((seconds - low) / wide)).select("canonical", "stretch", "at", "full", "record_id", "key", "ts")
    # at most a row a stretch and URL
    spans = rows.groupBy("canonical", "stretch").agg(F.max(F.when(F.col("full"), F.col("at"))).alias("own"))
    over = W.partitionBy("canonical").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select("canonical", "stretch", F.last("own", ignorenulls=True).over(over).alias("before"))
    within = W.partitionBy("canonical", "stretch").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.last(F.when(F.col("full"), F.col("at")), ignorenulls=True).over(within)).filter("not full")
    seen = seen.join(carried, ["canonical", "stretch"], "left").withColumn("met", F.coalesce("near", "before"))
    met = seen.select("record_id", "key", F.col("met.id").alias("latest"), ((seconds - F.col("met.t")) / 1e6).alias("age_s"))
    body = ["body"] if keep_body else []
    whole = full.select(F.col("record_id").alias("latest"), F.struct(*names, F.col("headers").alias("own"), *body).alias("response"), "ts")
    again = whole.groupBy("latest").agg(F.count("*").alias("n")).filter("n > 1").select("latest")
    if not again.isEmpty():  # one row a response: the least of equal ids
        again = materialise(again)
        alike = F.struct("ts", *(f"response.{n}" for n in names), F.to_json("response.own"), *(f"response.{c}" for c in body))
        least = whole.join(again, "latest", "left_semi").groupBy("latest").agg(F.min_by("response", alike).alias("response"))
        whole = whole.join(again, "latest", "left_anti").select("latest", "response").union(least)
    whole = whole.select("latest", "response")
    out = asking.join(met, ["record_id", "key"], "left").join(whole, "latest", "left")
    each = [validator(*(F.col(f"response.{n}") if n == name else F.lit(None).cast("string") for n in names)) for name in names]
    agrees = F.coalesce(F.array_contains(F.array(*each), F.col("asked")), F.lit(False))
    merged = merge_headers(F.col("response.own"), F.col("sent"))
    pick = lambda c, name: F.when(agrees, c).alias(name)
    body = [pick(F.col("response.body"), "body")] if keep_body else []
    return out.select("record_id", "canonical", pick(F.col("latest"), "response_id"), pick(F.col("age_s"), "age_s"), pick(merged, "headers"), *body)


CHANGED = "<!-- changed -->"


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of ``pages``: each page is fetched, every seventh again with another body after half an hour,
    and each revisited after an hour, which answers 304.

    Dealt over all pages by their id: servers that send ETags (weak at first, strong at the revisit), a date alone, or nothing
    but a body to digest; first fetches that fail; revisits that still ask for the first of two bodies, or ask for nothing.
    """
    p = F.col("page_id")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("other", F.concat("html", F.lit(CHANGED)))
    when = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + p + s)
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tagged, timed = p % 5 > 1, p % 5 == 0

    def response(number: int, late: int, body: str, status) -> DataFrame:
        return pages.select(
            (p * 4 + number).alias("record_id"), F.lit("response").alias("kind"), "url", when(late).alias("ts"), status.alias("status"),
            F.when(tagged, F.concat(F.lit('W/"'), F.md5(body), F.lit('"'))).alias("etag"), F.when(timed, text(when(late))).alias("last_modified"), F.md5(body).alias("digest"),
            F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text(when(late))).alias("headers"), F.col(body).alias("body"), "page_id",
        )

    first = response(0, 0, "html", F.when(p % 11 == 5, 404).otherwise(200))
    second = response(1, 1800, "other", F.lit(200)).filter(p % 7 == 3)
    newer, silent = (p % 7 == 3) & (p % 13 != 4), p % 17 == 6
    digest = F.when(~silent, F.md5(F.when(newer, F.col("other")).otherwise(F.col("html"))))
    again = pages.select(
        (p * 4 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), when(3600).alias("ts"), F.lit(304).alias("status"),
        F.when(tagged, F.concat(F.lit('"'), digest, F.lit('"'))).alias("etag"), F.when(timed & ~silent, text(F.when(newer, when(1800)).otherwise(when(0)))).alias("last_modified"),
        F.when(p % 5 == 1, digest).alias("digest"),
        F.create_map(F.lit("date"), text(when(3600)), F.lit("server"), F.lit("x")).alias("headers"), F.lit(None).cast("string").alias("body"), "page_id",
    )
    return first.unionByName(second).unionByName(again).drop("page_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl of ``pages``, with digests of the merged headers and the body."""
    found = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical", "response_id", F.col("age_s").cast("long").alias("age_s"), F.array_join(pairs, ";").alias("headers"), F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"))


#: The query over ``captures`` in SQL: each revisit with the latest response of its URL by then, and whether that has what it asks for.
SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
 regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
 list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]+|gclid|fbclid|sessionid|ref)(=|$)'))) AS kept FROM p),
c AS (SELECT page_id, html, html || '<!-- changed -->' AS other, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM h),
b AS (SELECT page_id, page_id * 4 AS id, canonical, page_id AS t, html AS body FROM c WHERE page_id % 11 <> 5
 UNION ALL SELECT page_id, page_id * 4 + 1, canonical, page_id + 1800, other FROM c WHERE page_id % 7 = 3),
f AS (SELECT id, canonical, t, body, CASE WHEN page_id % 5 > 1 THEN md5(body) END AS tag, CASE WHEN page_id % 5 = 0 THEN t END AS day, md5(body) AS dg FROM b),
n AS (SELECT *, page_id % 7 = 3 AND page_id % 13 <> 4 AS newer FROM c),
r AS (SELECT page_id, canonical, page_id + 3600 AS t, CASE WHEN page_id % 17 <> 6 THEN md5(CASE WHEN newer THEN other ELSE html END) END AS dg, CASE WHEN page_id % 17 <> 6 THEN page_id + CASE WHEN newer THEN 1800 ELSE 0 END END AS day FROM n),
m AS (SELECT r.page_id, f.id, r.t - f.t AS age, f.body,
 coalesce(CASE WHEN r.page_id % 5 > 1 THEN f.tag = r.dg WHEN r.page_id % 5 = 0 THEN f.day = r.day ELSE f.dg = r.dg END, false) AS agrees,
 row_number() OVER (PARTITION BY r.page_id ORDER BY f.t DESC, f.id DESC) AS nth
 FROM r JOIN f ON r.canonical = f.canonical AND f.t <= r.t)
SELECT r.page_id * 4 + 2 AS record_id, r.canonical, id AS response_id, age AS age_s,
 CASE WHEN id IS NOT NULL THEN 'content-type=text/html;date=' || strftime(to_timestamp(1700000000 + r.t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS headers,
 md5(body) AS body_md5, length(body) AS body_chars
FROM r LEFT JOIN m ON m.page_id = r.page_id AND nth = 1 AND agrees
"""
