"""Resolution of not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import require

#: Header fields that a not-modified answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Time units that one bucket of the as-of join spans: a URL's captures are never ordered in one group beyond a bucket.
BUCKET = 100_000


def canonical_url(url: Column) -> Column:
    """Host without www., path without closing slashes, sorted query without tracking parameters; no scheme, port or fragment. Null if there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def lowered(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ by case only, the last one's value."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Per revisit: record_id, canonical_url, ts, response_id, status and the merged ``headers``.

    records: record_id long, url, ts long, kind ('response' or 'revisit'), etag, last_modified, digest, headers (map).
    A revisit goes to the response with the largest (ts, record_id) whose ts is smaller than its own. Status: no_url
    (null or without host, or null ts), no_response, mismatch (a validator that both have differs; response_id stays),
    unchecked (no validator in common), resolved. Only resolved ones have headers: the response's, with the revisit's
    permitted fields over them. Weak entity tags equal their strong forms. Records of other or null kinds, and
    responses with a null record_id, take no part; revisits with a null record_id come out with it. Repeated revisits
    come out as often as they are there; repeated responses count once. Other columns are ignored.

    The as-of search is in two levels: by URL and time bucket, and over one row a bucket, so that a URL with a large
    share of all captures is spread over its buckets. Only ids travel through it; what they stand for is joined last.
    """
    require(records, "record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")
    every = records.where("kind in ('response', 'revisit')").select(
        "record_id", "kind", "etag", "last_modified", "digest", lowered(F.col("headers")).alias("own"), "ts", canonical_url(F.col("url")).alias("canonical_url"), F.floor(F.col("ts") / bucket).alias("bucket")
    )
    known = every.where("canonical_url is not null and ts is not null")
    at = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull(), F.struct("ts", "record_id"))
    before = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("near", F.max(at).over(before)).where("kind = 'revisit'")
    summary = known.groupBy("canonical_url", "bucket").agg(F.max(at).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("canonical_url", "bucket", F.max("last").over(earlier).alias("far")).where("far is not null")
    asked = inside.join(carried, ["canonical_url", "bucket"], "left").withColumn("response_id", F.coalesce("near.record_id", "far.record_id"))
    strong = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    full = every.where("kind = 'response' and record_id is not null").groupBy("record_id").agg(
        F.max(F.struct(strong("etag").alias("etag"), "last_modified", "digest", F.map_entries("own").alias("entries"))).alias("full")
    ).withColumnRenamed("record_id", "full_id")
    both = asked.join(full, F.col("response_id") == F.col("full_id"), "left")
    pairs = [(strong("etag"), F.col("full.etag")), (F.col("last_modified"), F.col("full.last_modified")), (F.col("digest"), F.col("full.digest"))]
    differ = F.greatest(*(F.coalesce(a != b, F.lit(False)) for a, b in pairs))
    same = F.greatest(*(F.coalesce(a == b, F.lit(False)) for a, b in pairs))
    status = F.when(F.col("response_id").isNull(), "no_response").when(differ, "mismatch").when(same, "resolved").otherwise("unchecked")
    new = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.map_from_entries("full.entries"), lambda k, v: ~F.map_contains_key(new, k))
    out = both.select("record_id", "canonical_url", "ts", "response_id", status.alias("status"), F.when(status == "resolved", F.map_concat(kept, new)).alias("headers"))
    lost = every.where("kind = 'revisit' and (canonical_url is null or ts is null)")
    none = F.lit(None)
    return out.unionByName(lost.select("record_id", "canonical_url", "ts", none.cast(records.schema["record_id"].dataType).alias("response_id"), F.lit("no_url").alias("status"), none.cast("map<string,string>").alias("headers")))


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of three captures of every page: a full response, a revisit, and a later one whose entity tag no longer fits for every fifth page.

    Captures of pages with one canonical URL interleave, as page ids give the times.
    """
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    log = pages.select("page_id", "url", F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16).alias("tag"), n)
    later = F.col("n") > 0
    etag = F.concat(F.lit('"'), F.when((F.col("n") == 2) & (F.col("page_id") % 5 == 0), "gone").otherwise(F.col("tag")), F.lit('"'))
    date = F.concat(F.lit("t"), F.col("page_id") + F.col("n") * 1_000_000)
    shared = [F.lit("ETag"), etag, F.lit("Date"), date]
    headers = F.when(later, F.create_map(*shared, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")))
    headers = headers.otherwise(F.create_map(*shared, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("no-cache")))
    return log.select(
        (F.col("page_id") * 3 + F.col("n")).alias("record_id"), "url", (F.col("page_id") + F.col("n") * 1_000_000).cast("long").alias("ts"), F.when(later, "revisit").otherwise("response").alias("kind"),
        F.when(later & (F.col("page_id") % 7 != 0) | ~later, etag).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), headers.alias("headers"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Revisits of the capture log of all pages, resolved; the headers as sorted text."""
    found = resolve_revisits(capture_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return found.select("record_id", "canonical_url", "ts", "response_id", "status", F.coalesce(text, F.lit("")).alias("headers"))


OP1_SQL = r"""
WITH page AS (
  SELECT page_id, substr(md5(coalesce(html, '')), 1, 16) AS tag,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))), '&') AS q
  FROM pages
), rec AS (
  SELECT page_id * 3 + n AS record_id, n, page_id, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url,
    page_id + n * 1000000 AS ts, '"' || CASE WHEN n = 2 AND page_id % 5 = 0 THEN 'gone' ELSE tag END || '"' AS etag
  FROM page, (VALUES (0), (1), (2)) AS c(n)
), res AS (SELECT * FROM rec WHERE n = 0),
asked AS (
  SELECT r.*, (SELECT max({'ts': s.ts, 'id': s.record_id}) FROM res AS s WHERE s.canonical_url = r.canonical_url AND s.ts < r.ts).id AS response_id FROM rec AS r WHERE n > 0
)
SELECT a.record_id, a.canonical_url, a.ts, a.response_id,
  CASE WHEN a.canonical_url IS NULL THEN 'no_url' WHEN a.response_id IS NULL THEN 'no_response' WHEN a.page_id % 7 = 0 THEN 'unchecked' WHEN a.etag <> s.etag THEN 'mismatch' ELSE 'resolved' END AS status,
  CASE WHEN a.response_id IS NOT NULL AND a.page_id % 7 <> 0 AND a.etag = s.etag THEN 'cache-control=max-age=60&content-type=text/html&date=t' || a.ts || '&etag=' || a.etag ELSE '' END AS headers
FROM asked AS a LEFT JOIN res AS s ON s.record_id = a.response_id
"""
