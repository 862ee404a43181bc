"""Not-modified revisits resolved to the response they stand for.

A crawl holds full responses and revisits that only say "not modified". A revisit is
resolved by an as-of join: the latest full response of the same canonical URL before it.
It is accepted if the validators agree (entity tags by weak comparison where both have
one, else modification dates), and the stored response's headers are then brought up to
date with those a not-modified answer may change; all others stay as stored.

The canonical form drops scheme, a leading ``www.`` or ``m.``, default ports, fragment,
trailing slash and tracking parameters, and lower-cases the host. The as-of join carries the last
response along each URL's records in time. A URL's records are cut into slices of time, so
that one that holds a third of all records is ordered by many tasks: first within each
slice, then over the last response of each slice. Bodies are not moved; a resolved revisit
names the record that holds its body.

Odd rows: a record without URL or time is never a candidate, and such a revisit has no
earlier response; of responses at one time the larger record id counts, and a response at
the revisit's own time is not earlier; missing headers are empty; repeated records are
resolved each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5) with the modification date.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not change what is served.
TRACKING = r"^(ref|utm_[a-z]+|session|sid)="
SLICE = 86_400


def canonical(url: Column) -> Column:
    """The form of a URL under which its records are one."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r"^(www\.|m\.)|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    parameters = F.filter(
        F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)
    )
    return F.concat(host, path, F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parameters), "&"))).otherwise(""))


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def resolve(records: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """One row per revisit: record_id, url, the record it resolves to, outcome and headers.

    ``records`` has record_id long, url string, at long (seconds), status int (200 or 304)
    and headers map<string,string> with lower-case names.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id",
        F.col("url").alias("given_url"),
        canonical(F.col("url")).alias("url"),
        "at",
        "status",
        F.coalesce("headers", empty).alias("headers"),
    ).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    known = F.col("url").isNotNull() & F.col("at").isNotNull()
    response = F.when(F.col("status") == 200, F.struct("at", "record_id", "headers"))
    placed = rows.filter(known)
    # Records at one time do not see each other: the frame ends one second before.
    within = Window.partitionBy("url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    latest = lambda c: F.max_by(c, F.when(F.col("status") == 200, F.struct("at", "record_id")))
    near = placed.filter("status IN (200, 304)").withColumn("_near", latest(response).over(within)).filter("status = 304")
    ends = (
        placed.filter("status = 200")
        .groupBy("url", "slice")
        .agg(F.max_by(F.struct("at", "record_id", "headers"), F.struct("at", "record_id")).alias("_last"))
    )
    # Slices with a revisit or a response, with the last response of any slice before.
    slices = placed.filter("status = 304").select("url", "slice").distinct().join(ends, ["url", "slice"], "full")
    order = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_far", F.last("_last", ignorenulls=True).over(order)).select("url", "slice", "_far")
    found = near.join(carried, ["url", "slice"], "left").withColumn("found", F.coalesce("_near", "_far"))
    lost = rows.filter(~known & (F.col("status") == 304)).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    columns = ["record_id", "url", "at", "headers", "found"]
    both = found.select(columns).unionByName(lost.select(columns)).withColumn("stored", F.coalesce("found.headers", empty))

    agreed = F.when(_tag("headers").isNotNull() & _tag("stored").isNotNull(), _tag("headers") == _tag("stored")).otherwise(
        F.element_at("headers", "last-modified") == F.element_at("stored", "last-modified")
    )
    outcome = (
        F.when(F.col("found").isNull(), "no earlier response")
        .when(agreed.isNull(), "no validator")
        .when(agreed, "resolved")
        .otherwise("validators differ")
    )
    updates = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return both.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "at",
        F.when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("response_id"),
        "outcome",
        F.when(F.col("outcome") == "resolved", listed).alias("headers"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl log from pages: each page is fetched in full and asked for again twice.

    The second asking spells the URL otherwise, and every seventh page has changed its
    validator by then; every fifth page sends only a modification date, every eleventh no
    validator.
    """
    p = F.col("page_id")
    dated = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + p * 60), "yyyy-MM-dd HH:mm:ss")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))

    def headers(*pairs: Column) -> Column:
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))

    sends_tag, sends_date = (p % 5 != 0) & (p % 11 != 0), p % 11 != 0
    full = headers(
        pair("content-type", F.lit("text/html")),
        pair("content-length", F.octet_length("html")),
        pair("etag", F.when(sends_tag, tag)),
        pair("last-modified", F.when(sends_date, dated)),
        pair("date", F.lit(0)),
    )
    again = lambda n, t: headers(
        pair("content-length", F.lit(0)), pair("etag", F.when(sends_tag, t)), pair("last-modified", F.when(sends_date, dated)), pair("date", F.lit(n))
    )
    changed = F.when(p % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    row = lambda n, url, at, status, h: F.struct(
        (p * 3 + n).alias("record_id"), url.alias("url"), at.cast("long").alias("at"), F.lit(status).alias("status"), h.alias("headers")
    )
    other = F.concat(F.col("url"), F.lit("#again"))
    return pages.select(
        F.explode(
            F.array(
                row(0, F.col("url"), p * 60, 200, full),
                row(1, F.col("url"), p * 60 + 30, 304, again(1, tag)),
                row(2, other, p * 60 + 200_000, 304, again(2, changed)),
            )
        ).alias("r")
    ).select("r.*")


#: The query over crawl_of(pages), in DuckDB's SQL.
ORACLE = """
WITH named AS (
  SELECT page_id, url, html,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain
  FROM pages
), parts AS (
  SELECT *,
         regexp_replace(lower(regexp_extract(plain, '^[^/?]*', 0)), '^(www\\.|m\\.)|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(plain, '\\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(ref|utm_[a-z]+|session|sid)='))) AS parameters
  FROM named
), base AS (
  SELECT page_id, html,
         host || path || CASE WHEN len(parameters) > 0 THEN '?' || array_to_string(parameters, '&') ELSE '' END AS url,
         CASE WHEN page_id % 5 <> 0 AND page_id % 11 <> 0 THEN '"' || md5(html) || '"' END AS tag,
         CASE WHEN page_id % 11 <> 0
           THEN strftime(make_timestamp((1700000000 + page_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') END AS dated
  FROM parts
), responses AS (
  SELECT url, page_id * 60 AS "at", page_id * 3 AS record_id, tag, dated, strlen(html) AS size FROM base
), latest AS (
  SELECT url, "at", max_by(record_id, record_id) AS record_id, max_by(struct_pack(tag := tag, dated := dated, size := size), record_id) AS s
  FROM responses GROUP BY url, "at"
), revisits AS (
  SELECT url, page_id * 60 + 30 AS "at", page_id * 3 + 1 AS record_id, tag, dated, '1' AS sent FROM base
  UNION ALL
  SELECT url, page_id * 60 + 200000, page_id * 3 + 2,
         CASE WHEN tag IS NULL THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE 'W/' || tag END, dated, '2' FROM base
), joined AS (
  SELECT r.*, l.record_id AS response_id, l.s.tag AS stored_tag, l.s.dated AS stored_dated, l.s.size AS size
  FROM revisits r ASOF LEFT JOIN latest l ON r.url = l.url AND r."at" > l."at"
), judged AS (
  SELECT *, CASE WHEN tag IS NOT NULL AND stored_tag IS NOT NULL
                 THEN regexp_replace(tag, '^W/', '') = regexp_replace(stored_tag, '^W/', '')
                 ELSE dated = stored_dated END AS agreed
  FROM joined
), told AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no earlier response' WHEN agreed IS NULL THEN 'no validator'
                 WHEN agreed THEN 'resolved' ELSE 'validators differ' END AS outcome
  FROM judged
)
SELECT record_id, url, "at", CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'content-length: ' || size, 'content-type: text/html',
         'date: ' || sent, 'etag: ' || coalesce(tag, stored_tag), 'last-modified: ' || coalesce(dated, stored_dated)) END AS headers
FROM told
"""
