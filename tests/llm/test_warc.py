from tidemark.llm.warc import canonical_url, resolve_revisits
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, near int"
A = "http://www.Site.org:80/a/?b=2&utm_source=x&a=1#f"


def run(spark, rows, bucket=10):
    out = resolve_revisits(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), bucket)
    return sorted(((r.record_id or -1, r.response_id, r.status, r.headers) for r in out.collect()), key=str)


def test_canonical_url(spark):
    urls = [A, "https://site.org/a?a=1&b=2", "site.org/a", None, "ftp://x.y", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["site.org/a?a=1&b=2", "site.org/a?a=1&b=2", None, None, "x.y", None]


def test_resolution(spark):
    rows = [
        (1, A, 5, "response", '"e1"', "m1", None, {"Content-Type": "text", "Cache-Control": "a"}),
        (2, A, 7, "response", '"e2"', None, None, {"X": "y"}),
        (3, A, 7, "response", '"e3"', None, "d", None),
        (10, A, 5, "revisit", '"e1"', None, None, None),  # not later than the response
        (11, A, 6, "revisit", 'W/"e1"', None, None, {"ETag": "n", "Content-Length": "0"}),
        (12, A, 6, "revisit", '"e9"', "m1", None, None),
        (13, A, 99, "revisit", None, None, "d", {}),  # ties: the larger id; found over buckets
        (14, A, 99, "revisit", None, "m1", None, {}),
        (15, None, 99, "revisit", '"e1"', None, None, None),
        (16, "http://other/", 99, "revisit", '"e1"', None, None, None),
        (17, A, None, "revisit", '"e1"', None, None, None),
        (18, A, 6, "other", '"e1"', None, None, None),
        (13, A, 99, "revisit", None, None, "d", {}),
        (None, A, 99, "revisit", None, None, "d", {}),
    ]
    want = [
        (10, None, "no_response", None), (11, 1, "resolved", {"content-type": "text", "cache-control": "a", "etag": "n"}), (12, 1, "mismatch", None), (13, 3, "resolved", {}),
        (13, 3, "resolved", {}), (14, 3, "unchecked", None), (15, None, "no_url", None), (16, None, "no_response", None), (17, None, "no_url", None), (-1, 3, "resolved", {}),
    ]
    assert run(spark, rows) == sorted(want, key=str)
    assert run(spark, rows, 1000) == sorted(want, key=str)
    assert run(spark, []) == []
