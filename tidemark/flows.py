"""Queries of running streams, incremental jobs, nested documents and window components, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import oracles as O
from tidemark.operators import embedding as V
from tidemark.queries import bars_of, rounded
from tidemark.shared import shared_dir
from tidemark.sources import jobs
from tidemark.sources.documents import document_rows, documents_from
from tidemark.sources.ticks import table, ticks_from_events
from tidemark.streaming.bars import run_bars

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {O.BARS} SELECT symbol, ts, open, high, low, close, n FROM bars WHERE ts + INTERVAL 15 MINUTES <= (SELECT max(ts) FROM t) - INTERVAL 10 MINUTES")
def stream_bars_running(spark, sf_dir):
    """The events as a stream of files through a started query to its end: all bars that the watermark has passed."""
    schema = table(spark, sf_dir, "events").schema
    ticks = ticks_from_events(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet"))
    path = own_folder(spark, "bars")
    run_bars(ticks, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("symbol string, ts timestamp_ntz, open double, high double, low double, close double, n long").parquet(f"{path}/out")


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total, CASE WHEN year(o_orderdate) < 1998 THEN 1 ELSE 2 END AS fetched FROM orders GROUP BY ALL")
def jobs_incremental(spark, sf_dir):
    """Orders by year as parts: a first run keeps the years before 1998, a second all that are missing, a third finds nothing to do."""
    orders = table(spark, sf_dir, "orders").withColumn("part", F.year("o_orderdate").cast("string"))
    wanted = orders.select("part").distinct()
    path = own_folder(spark, "jobs")
    runs = []

    def fetch(left):
        runs.append(len(runs) + 1)
        return orders.join(F.broadcast(left), "part").select("part", "o_orderkey", "o_totalprice", F.lit(runs[-1]).alias("fetched"))  # a row a year

    for parts in (wanted.where("part < '1998'"), wanted, wanted):
        jobs.run_jobs(parts, fetch, path)
    return jobs.kept(spark, path).groupBy("part", "fetched").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH e AS (SELECT event_id, unnest([['event_type', NULL, NULL], ['who', 'user_id', NULL], ['who', 'props', 'k'], ['when', '0', NULL], ['when', '1', NULL]]) AS p,
  unnest(['"' || event_type || '"', CAST(user_id AS VARCHAR), json_extract_string(props, '$.k'), CAST(hour(ts) AS VARCHAR), CAST(day(ts) AS VARCHAR)]) AS value FROM events)
SELECT event_id, array_to_string(list_filter(p, lambda x: x IS NOT NULL), '/') AS path, value FROM e WHERE value IS NOT NULL""")
def event_document_rows(spark, sf_dir):
    """Events as nested documents, their properties parsed in place, put through rows, back, and through rows again."""
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct("event_type", F.struct("user_id", F.from_json("props", "k long").alias("props")).alias("who"), F.array(F.hour("ts"), F.day("ts")).alias("when")))
    rows = document_rows(e.select("event_id", doc.alias("doc")), "event_id", "doc")
    again = document_rows(documents_from(rows, "event_id"), "event_id", "document")
    return again.select("event_id", F.array_join(F.transform("path", lambda s: F.coalesce(s["key"], s["pos"].cast("string"))), "/").alias("path"), "value")


@query()
def window_components(spark, sf_dir):
    """Every window of 32 bars in six channels by its first eight principal components; the first 15 days are the development rows."""
    rows = V.channels(bars_of(spark, sf_dir), F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    model = V.components(rows.where("_dev"), V.CHANNELS, 32, 8)
    return rounded(V.embedded(rows, V.CHANNELS, 32, model))
