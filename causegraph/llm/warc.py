"""Operator 6: resolution of not-modified revisit records in web archives.

A revisit stands for a full response captured earlier from the same canonical URL.
Each is matched with the latest earlier one (an as-of join in order of time, then
record id), their validators are compared, and the headers that a not-modified
response may update are merged over the stored ones.

A URL may hold any share of the records, in any stretch of time, so the records are
parted by ranges of (URL, time, record id) of about equal size and stored; a URL's records
in one range are a slice of its time line.  A window finds the latest full response within
a slice, a second one, over one row per URL and slice, carries it into later slices.
Bodies never move; the result names the record that has the body.

Verdicts: ``resolved``; ``unverified`` (no validator occurs in both); ``mismatch``
(they differ, refers_to still names the candidate); ``missing`` (no earlier full
response, no URL, or no time).  Resolved and unverified ones merge headers, the others
keep the revisit's own.  Responses without URL or time are nobody's candidates.  Header
names are compared in lower case; of names that differ only in case the first in the
order of their characters counts.  Null headers are none.  Repeated revisits are resolved
each for itself; of responses equal in URL, time and record id any may be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from causegraph.storage import stored

#: Headers that a 304 response must not change (RFC 9110, RFC 9111), hop-by-hop ones included.
KEPT_FROM_RESPONSE = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and www; path without a closing slash;
    query sorted without tracking parameters; no scheme or fragment. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^(?:[^/?@]*@)?([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*(/[^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|gclid=|fbclid=)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Headers by lower-case name; of several names that become one the first holds. Null: none."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    alone = F.size(F.array_distinct(names)) == F.size(names)
    return F.map_from_entries(F.when(alone, low).otherwise(F.filter(low, lambda e, i: F.array_position(names, e["key"]) == i + 1)))


def _get(headers: str, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(F.col(headers), lambda k, v: k == name)), F.lit(0))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts (long), kind ('response' or 'revisit'), headers (map), payload_digest.

    Returns per revisit: record_id, canonical_url, refers_to, verdict, headers.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", lower_names(F.col("headers")).alias("headers"), "payload_digest")
    lost = F.col("canonical_url").isNull() | F.col("ts").isNull()
    known = r.where(~lost).repartitionByRange("canonical_url", "ts", "record_id").withColumn("slice", F.spark_partition_id())
    known = stored(known, "records")  # a record's slice must not change when a task is run again
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "payload_digest"))
    within = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last(full, ignorenulls=True).over(within)).where("kind = 'revisit'")
    last = known.where("kind = 'response'").groupBy("canonical_url", "slice").agg(F.max_by(F.struct("record_id", "headers", "payload_digest"), F.struct("ts", "record_id")).alias("last"))
    slices = near.where("near is null").select("canonical_url", "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    both = last.unionByName(slices).groupBy("canonical_url", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("canonical_url", "slice", "carried")
    found = near.join(carried, ["canonical_url", "slice"], "left").withColumn("full", F.coalesce("near", "carried"))
    found = found.select("record_id", "canonical_url", "headers", "payload_digest", "full").unionByName(
        r.where(lost & (F.col("kind") == "revisit")).select("record_id", "canonical_url", "headers", "payload_digest"), allowMissingColumns=True
    )
    found = found.withColumns({"old": F.col("full.headers"), "old_digest": F.col("full.payload_digest")})
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [(weak(_get("headers", "etag")), weak(_get("old", "etag"))), (_get("headers", "last-modified"), _get("old", "last-modified")), (F.col("payload_digest"), F.col("old_digest"))]
    same = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    verdict = F.when(F.col("full").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_FROM_RESPONSE))
    held = F.map_filter("old", lambda k, v: ~F.map_contains_key(new, k))
    merged = F.when(F.col("verdict").isin("resolved", "unverified"), F.map_concat(held, new)).otherwise(F.col("headers"))
    return found.withColumn("verdict", verdict).select("record_id", "canonical_url", F.col("full.record_id").alias("refers_to"), "verdict", merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl that sees each of ``pages`` three times, under three spellings of its URL; every
    tenth page stands at one address, whose captures of different pages follow one another. By page_id modulo 4 the
    captures are: a revisit before any response, a response and a revisit of it; two responses and a revisit of the
    first; a response, a revisit without header validators and a later response; two responses and a revisit of the
    second by its date."""
    p, j, c = F.col("page_id"), F.col("j"), F.col("page_id") % 4
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    quoted = lambda x: text('"', F.md5(x.cast("binary")), '"')
    html = F.coalesce("html", F.lit(""))
    once = pages.select("page_id", F.when(p % 10 == 9, "https://front.example.org/").otherwise(F.col("url")).alias("url"), F.octet_length(html).alias("bytes"), quoted(html).alias("first"), quoted(F.concat(html, F.lit("2"))).alias("second"))
    seen = once.withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    url = F.when(j == 0, F.col("url")).when(j == 1, F.when(F.contains("url", F.lit("#")), F.col("url")).otherwise(text(F.col("url"), "#again"))).otherwise(F.regexp_replace("url", "^https?://", "http://user@"))
    response = ((c == 0) & (j == 1)) | ((c == 2) & (j != 1)) | ((c % 2 == 1) & (j < 2))
    changed = ((c % 2 == 1) & (j == 1)) | ((c == 2) & (j == 2))
    tag = F.when(response, F.when(changed, F.col("second")).otherwise(F.col("first"))).when(c < 2, F.when((c == 0) & (j == 2), text("W/", F.col("first"))).otherwise(F.col("first")))
    day = F.when(response, text("day ", (p + j) % 28)).when(c == 3, text("day ", (p + 1) % 28))
    pairs = {
        "ETag": tag, "Last-Modified": day, "Content-Length": F.when(response, F.col("bytes").cast("string")).otherwise("0"),
        "Content-Type": F.when(response, "text/html"), "Date": text("seen ", p, ".", j), "X-Cache": F.when(~response, "HIT"),
    }
    headers = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull()))
    digest = F.when(response | ((c == 2) & (p % 8 == 2)), F.when(changed, F.col("second")).otherwise(F.col("first")))
    kind = F.when(response, "response").otherwise("revisit")
    return seen.select((3 * p + j).alias("record_id"), url.alias("url"), (500 * j + p * 7919 % 1000).alias("ts"), kind.alias("kind"), headers.alias("headers"), digest.alias("payload_digest"))


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    shown = {name.replace("-", "_"): _get("headers", name) for name in ("date", "etag", "last-modified", "content-length", "content-type")}
    return out.select("record_id", "canonical_url", F.col("refers_to").cast("string").alias("refers_to"), "verdict", *[v.alias(k) for k, v in shown.items()], F.size("headers").cast("long").alias("n_headers"))


ORACLE = r"""
WITH o AS (SELECT page_id AS p, page_id % 4 AS c, CASE WHEN page_id % 10 = 9 THEN 'https://front.example.org/' ELSE url END AS url, strlen(coalesce(html, '')) AS bytes,
  '"' || md5(coalesce(html, '')) || '"' AS tag1, '"' || md5(coalesce(html, '') || '2') || '"' AS tag2 FROM pages),
s AS (SELECT *, unnest([0, 1, 2]) AS j FROM o),
k AS (SELECT *, (c = 0 AND j = 1) OR (c = 2 AND j <> 1) OR (c IN (1, 3) AND j < 2) AS whole, (c IN (1, 3) AND j = 1) OR (c = 2 AND j = 2) AS changed,
  CASE j WHEN 0 THEN url WHEN 1 THEN CASE WHEN contains(url, '#') THEN url ELSE url || '#again' END ELSE regexp_replace(url, '^https?://', 'http://user@') END AS spelt FROM s),
t AS (SELECT *, 3 * p + j AS id, (500 * j + p * 7919 % 1000) * 1000000000000 + 3 * p + j AS pos, 'seen ' || p || '.' || j AS date,
  CASE WHEN whole THEN CASE WHEN changed THEN tag2 ELSE tag1 END WHEN c < 2 THEN tag1 END AS tag,
  CASE WHEN c = 0 AND j = 2 THEN 'W/' ELSE '' END AS weak,
  CASE WHEN whole THEN 'day ' || ((p + j) % 28) WHEN c = 3 THEN 'day ' || ((p + 1) % 28) END AS day,
  CASE WHEN whole OR (c = 2 AND p % 8 = 2) THEN CASE WHEN changed THEN tag2 ELSE tag1 END END AS digest,
  regexp_replace(regexp_replace(spelt, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM k),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|gclid=|fbclid=)'))) AS qs FROM t),
r AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
  || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '') || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS site FROM q),
f AS (SELECT site, pos, id AS ref, tag AS rtag, day AS rday, digest AS rdigest, bytes AS rbytes FROM r WHERE whole),
m AS (SELECT r.*, f.* EXCLUDE (site, pos) FROM r ASOF LEFT JOIN f ON r.site = f.site AND r.pos > f.pos WHERE NOT r.whole),
v AS (SELECT *, CASE WHEN ref IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END
  WHEN day IS NOT NULL THEN CASE WHEN day = rday THEN 'resolved' ELSE 'mismatch' END
  WHEN digest IS NOT NULL THEN CASE WHEN digest = rdigest THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS verdict FROM m),
w AS (SELECT *, verdict IN ('resolved', 'unverified') AS merged FROM v)
SELECT id AS record_id, site AS canonical_url, ref::VARCHAR AS refers_to, verdict, date, coalesce(weak || tag, CASE WHEN merged THEN rtag END) AS etag, coalesce(day, CASE WHEN merged THEN rday END) AS last_modified,
  CASE WHEN merged THEN rbytes::VARCHAR ELSE '0' END AS content_length, CASE WHEN merged THEN 'text/html' END AS content_type,
  (CASE WHEN merged THEN 6 WHEN c = 2 THEN 3 ELSE 4 END)::BIGINT AS n_headers FROM w"""
