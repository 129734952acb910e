"""From ticks to quality-checked fixed-interval bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(ticks: DataFrame, *key: str) -> DataFrame:
    """Of the rows with one key, the one with the largest seq; combined before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in ticks.columns if c not in key]
    return ticks.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*key, "_last.*").select(*ticks.columns)


def numbered(rows: DataFrame, by: str = "symbol", ts: str = "ts", unit: str = "day") -> DataFrame:
    """``rn``: place of each row in its series, from 1, without one group for a series.

    Rows are numbered inside (series, day) and shifted by the counts of the days before, one row a day.
    """
    day = F.date_trunc(unit, F.col(ts)).alias("_day")
    counted = rows.groupBy(by, day).agg(F.count("*").alias("_n"))
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = rows.withColumn("_day", F.date_trunc(unit, F.col(ts))).withColumn("_own", F.row_number().over(Window.partitionBy(by, "_day").orderBy(ts)))
    return local.join(before, [by, "_day"]).withColumn("rn", (F.col("_before") + F.col("_own")).cast("long")).drop("_day", "_before", "_own")


def chunked(rows: DataFrame, chunk_rows: int, halo: int, ahead: int = 0) -> DataFrame:
    """Rows with ``chunk`` and ``halo``: stretches of chunk_rows rows, each with the ``halo`` rows before it and the ``ahead`` rows after it again.

    Window functions over (symbol, chunk) whose frames reach back at most ``halo`` rows and on at most ``ahead`` are then
    right on rows that are not halo, and no task holds more than chunk_rows + halo + ahead rows of a series.
    """
    own = F.floor((F.col("rn") - 1) / chunk_rows).cast("int")
    back, on = -(-halo // chunk_rows), -(-ahead // chunk_rows)
    near = lambda c: (c == own) | ((c > own) & (F.col("rn") > c * chunk_rows - halo)) | ((c < own) & (c >= 0) & (F.col("rn") <= (c + 1) * chunk_rows + ahead))
    memberships = F.filter(F.transform(F.sequence(F.lit(-on), F.lit(back)), lambda k: own + k), near)
    return rows.withColumn("chunk", F.explode(memberships)).withColumn("halo", F.col("chunk") != own)


def by_stretch(rows: DataFrame, add: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0, chunk_rows: int = 20_000) -> DataFrame:
    """``add`` applied to (symbol, ts) rows in stretches; its windows over (symbol, chunk) may reach ``back`` and ``ahead`` that many rows.

    So a series of any length is spread over many tasks. Rows without symbol or ts don't come out.
    """
    own = rows.drop("chunk", "halo")
    out = add(chunked(own if "rn" in rows.columns else numbered(own), chunk_rows, back, ahead)).where("not halo").drop("chunk", "halo")
    return out if "rn" in rows.columns else out.drop("rn")


def previous(rows: DataFrame, x: str, name: str, by: str = "symbol", ts: str = "ts", then: str | None = None) -> DataFrame:
    """``name``: x of the row before in the series, without one group for a series; ``_day`` stays, for groupings after it.

    Rows look back inside (series, day); the last value of each day is handed to the next day that has rows, one row a day.
    Rows of one time are in the order of the column ``then``, if it is given.
    """
    day = F.to_date(ts).alias("_day")
    ends = rows.groupBy(by, day).agg(F.max_by(x, F.struct(ts, then) if then else ts).alias("_end"))
    carried = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(by).orderBy("_day")))
    w = Window.partitionBy(by, "_day").orderBy(*([ts, then] if then else [ts]))
    joined = rows.withColumn("_day", F.to_date(ts)).join(carried, [by, "_day"], "left")
    return joined.withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_end")).otherwise(F.lag(x).over(w))).drop("_end")


def last_known(rows: DataFrame, x: Column, name: str, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """``name``: the last value of x that isn't null, up to and with the row, without one group for a series.

    Rows look back inside (series, day); each day's last value is handed on, over days without one too, one row a day.
    """
    rows = rows.withColumns({"_x": x, "_day": F.to_date(ts)})
    ends = rows.groupBy(by, "_day").agg(F.max_by("_x", F.when(F.col("_x").isNotNull(), F.col(ts))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    here = F.last("_x", ignorenulls=True).over(Window.partitionBy(by, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(carried, [by, "_day"], "left").withColumn(name, F.coalesce(here, "_end")).drop("_x", "_day", "_end")


def carried(rows: DataFrame, columns: dict[str, tuple[str, bool]], chunk_rows: int, halo: int) -> DataFrame:
    """Adds the last known value of columns over a whole series of any length: new name -> (column, whether the row itself counts).

    rows are those of ``chunked``, with their halo. Inside a chunk the value is looked for in its rows; what precedes the
    chunk's halo comes from one row a chunk, so a value is carried over any stretch without one. All columns share the pass.
    """
    source = {x for x, _ in columns.values()}
    block = F.floor((F.col("rn") - 1 + halo) / chunk_rows).cast("int").alias("chunk")  # ends where a chunk's halo begins
    last = rows.where("not halo").groupBy("symbol", block).agg(*(F.max_by(x, F.when(F.col(x).isNotNull(), F.col("rn"))).alias(f"_l_{x}") for x in source))
    earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    handed = last.select("symbol", "chunk", *(F.last(f"_l_{x}", ignorenulls=True).over(earlier).alias(f"_c_{x}") for x in source))
    here = Window.partitionBy("symbol", "chunk").orderBy("ts")
    upto = {True: here.rowsBetween(Window.unboundedPreceding, 0), False: here.rowsBetween(Window.unboundedPreceding, -1)}
    new = {name: F.coalesce(F.last(x, ignorenulls=True).over(upto[own]), F.col(f"_c_{x}")) for name, (x, own) in columns.items()}
    return rows.join(handed, ["symbol", "chunk"], "left").withColumns(new).drop(*(f"_c_{x}" for x in source))


def resample(ticks: DataFrame, minutes: int = 15) -> DataFrame:
    """Bars of ``minutes`` minutes: open, high, low, close, n, rv, absret, up, down, range_sum, utc.

    ticks: symbol, ts, price, seq, or minute records with open, high, low, close. Changes are taken against the record
    before, across bars and gaps. Bars without records don't appear. Every record counts: those of one time are in the order
    of seq, where there is one; keep_last leaves one a time.
    """
    minute = ticks if "close" in ticks.columns else ticks.withColumns({c: F.col("price") for c in ("open", "high", "low", "close")})
    then = "seq" if "seq" in ticks.columns else None
    step = previous(minute, "close", "_c", then=then).withColumn("_d", F.log("close") - F.log("_c"))
    w = Window.partitionBy("symbol", "_day").orderBy(*(["ts", then] if then else ["ts"]))  # the window of previous
    at = lambda near: F.when(F.coalesce(near("ts").over(w) != F.col("ts"), F.lit(True)), F.col("ts"))
    step = step.withColumns({"_from": at(F.lag), "_to": at(F.lead)})  # the time, on the first and on the last record of it
    start = F.window("ts", f"{minutes} minutes")["start"]
    day = ["_day"] if 1440 % minutes == 0 else []  # bars that end with a day need no other exchange than the changes
    bars = step.groupBy("symbol", *day, start.alias("ts")).agg(
        F.min_by("open", "_from").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_to").alias("close"), F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("rv"), F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("absret"),
        F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).alias("down"), F.sum((F.col("high") - F.col("low")) / F.col("close")).alias("range_sum"),
    )
    return bars.drop("_day").withColumn("utc", F.col("ts") + F.expr("INTERVAL 5 HOURS"))


def quality(bars: DataFrame, outlier: float = 0.02) -> DataFrame:
    """One row a symbol: rows, first and last time, price-order violations, non-positive rows, outliers, weekend rows."""
    change = F.col("close") / F.col("_before") - 1
    day, hour = F.weekday("ts"), F.hour("ts")
    wrong = (F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))
    weekend = (day == 5) | ((day == 4) & (hour >= 17)) | ((day == 6) & (hour < 18))
    return previous(bars, "close", "_before").withColumn("_c", change).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(wrong).alias("violations"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("non_positive"), F.count_if(F.abs("_c") > outlier).alias("outliers"), F.count_if(weekend).alias("weekend_rows"),
    )


def coverage_holes(bars: DataFrame, unit: str = "day", share: float = 0.55) -> DataFrame:
    """Periods with fewer rows than ``share`` of the symbol's median period, with their share of that median."""
    n = bars.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period")).count()
    middle = n.groupBy("symbol").agg(F.percentile("count", 0.5).alias("median"))
    return n.join(middle, "symbol").where(F.col("count") < share * F.col("median")).select("symbol", "period", F.col("count").alias("n"), F.round(F.col("count") / F.col("median"), 6).alias("share"))


def quality_text(report: DataFrame) -> DataFrame:
    """The quality row of each symbol as a line of text."""
    return report.select(F.format_string("%s: %d rows, %d violations, %d non-positive, %d outliers, %d weekend rows", "symbol", "n_rows", "violations", "non_positive", "outliers", "weekend_rows").alias("line"))
