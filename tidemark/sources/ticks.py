"""Readers of tick and minute records, calendars and result documents, and their writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE_SCHEMA = "dt string, open double, high double, low double, close double, tickvol double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """symbol, ts, price and seq of an event stream; prices must be positive, so others are left out."""
    return events.where("value > 0").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))


def read_minutes(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Headerless ';' minute files: symbol, ts (as written, no zone) and prices."""
    raw = spark.read.schema(MINUTE_SCHEMA).option("sep", ";").csv(path)
    return raw.select(F.lit(symbol).alias("symbol"), F.to_timestamp_ntz("dt", F.lit("yyyyMMdd HHmmss")).alias("ts"), "open", "high", "low", "close", "tickvol")


def read_zipped_minutes(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """The first .csv member of each zip archive, unpacked in the tasks that read them."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if names:
                        yield pd.read_csv(z.open(names[0]), sep=";", header=None, names=["dt", "open", "high", "low", "close", "tickvol"], dtype={"dt": str})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, MINUTE_SCHEMA)
    return raw.select(F.lit(symbol).alias("symbol"), F.to_timestamp_ntz("dt", F.lit("yyyyMMdd HHmmss")).alias("ts"), "open", "high", "low", "close", "tickvol")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Event calendar from CSV: date, event, hour_est."""
    return spark.read.schema("date date, event string, hour_est int").option("header", "true").csv(path)


def first_fridays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The first Friday of every month from start to end."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias("m"))
    day = F.next_day(F.date_sub("m", 1), "FRI")
    return months.select(day.alias("date")).where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def html_headings(pages: DataFrame, tag: str = "h1") -> DataFrame:
    """page_id, position and words of every heading of a kind."""
    found = F.regexp_extract_all("html", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "heading"))


MONTHS = "January February March April May June July August September October November December"


def meeting_dates(pages: DataFrame, year: Column) -> DataFrame:
    """Last days of the meetings that panels of a page name: a month or two ("January/February") and days ("31-1").

    The second month and the second day count; days that no month has are left out.
    """
    months = F.regexp_extract_all("html", F.lit(r"(?s)month[^>]*>(?:<strong>)?\s*([A-Za-z/]+)"), F.lit(1))
    days = F.regexp_extract_all("html", F.lit(r"(?s)date[^>]*>\s*([0-9]{1,2}(?:-[0-9]{1,2})?)"), F.lit(1))
    rows = pages.select("page_id", year.alias("year"), F.posexplode(F.arrays_zip(months.alias("m"), days.alias("d"))).alias("position", "cell"))
    month = F.element_at(F.split("cell.m", "/"), -1)
    day = F.element_at(F.split("cell.d", "-"), -1)
    number = F.array_position(F.transform(F.split(F.lit(MONTHS), " "), lambda x: F.substring(x, 1, 3)), F.substring(F.initcap(month), 1, 3))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", "year", number.cast("int"), day.cast("int")), "yyyy-MM-dd")
    return rows.select("page_id", "position", date.alias("date")).where("date is not null")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars or features as Parquet, a folder for each symbol."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_document(row: DataFrame, path: str) -> None:
    """A small result as JSON lines."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_indexed(spark: SparkSession, path: str, index: str = "name", kind: str = "string") -> DataFrame:
    """A CSV whose first column, without a name in the header, is the index: that column as ``index``, all others as doubles."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    first, *rest = rows.columns
    return rows.select(F.col(f"`{first}`").cast(kind).alias(index), *(F.col(f"`{c}`").cast("double").alias(c) for c in rest))


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A report's lines (a string column ``line``) as text files."""
    lines.select("line").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, value: str) -> DataFrame:
    """JSON documents that map keys to records, such as years to thresholds: key and the fields of ``value`` (a schema), a row a key; files are read whole."""
    docs = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("document"))
    return docs.select(F.explode(F.from_json("document", f"map<string, struct<{value}>>")).alias("key", "_r")).select("key", "_r.*")
