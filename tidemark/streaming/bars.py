"""Bars from a stream of ticks: event-time windows behind a watermark, and the running query that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars of a frame that has its watermark."""
    return ticks.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("n")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def stream_bars(ticks: DataFrame, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """Bars of a streaming (or static) frame of symbol, ts, price: emitted once the watermark passes their end; later ticks are left out."""
    return windowed(ticks.withWatermark("ts", late), minutes)


def run_bars(ticks: DataFrame, path: str, checkpoint: str, minutes: int = 15, late: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """Start a query that appends bars of a stream of symbol, ts, price and seq to Parquet files in ``path``.

    A tick that comes again within the watermark, told by symbol and seq, counts once; one later than the watermark is left
    out and counted, see ``late_rows``. State and progress are in ``checkpoint``: a query that stops, at any point, goes on
    there when started anew, and each bar is written once. With ``once`` it ends when all there is has been read. A watermark
    is on instants, so times without a zone are taken in the session's, which should be UTC.
    """
    fresh = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])
    writer = windowed(fresh, minutes).withColumn("ts", F.col("ts").cast("timestamp_ntz")).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Ticks that came after the watermark, in the steps that the query remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
