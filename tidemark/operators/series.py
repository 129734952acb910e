"""Running, daily and run-length views of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as R
from tidemark.operators.bars import by_stretch, numbered


def running(rows: DataFrame, x: str, how: str, out: str, stretch: int = 10_000) -> DataFrame:
    """Running max, min or sum of a numbered series (symbol, rn) from its start, in two levels.

    Rows run inside stretches of ``stretch`` rows; the stretches' totals, one row each, run over the series and are joined back.
    """
    f = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    rows = rows.withColumn("_s", F.floor((F.col("rn") - 1) / stretch))
    total = rows.groupBy("symbol", "_s").agg(f(x).alias("_t"))
    before = total.withColumn("_b", f("_t").over(Window.partitionBy("symbol").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    here = f(x).over(Window.partitionBy("symbol", "_s").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    both = {"max": F.greatest("_h", "_b"), "min": F.least("_h", "_b"), "sum": F.coalesce("_h", F.lit(0)) + F.coalesce("_b", F.lit(0))}[how]
    return rows.withColumn("_h", here).join(before, ["symbol", "_s"]).withColumn(out, both).drop("_s", "_h", "_b")


def drawdown(rows: DataFrame, equity: str, out: str = "drawdown") -> DataFrame:
    """Equity over its running peak, less one."""
    return running(rows, equity, "max", "_peak").withColumn(out, F.col(equity) / F.col("_peak") - 1).drop("_peak")


def daily(bars: DataFrame) -> DataFrame:
    """Last close and count of each trading day, which turns at 18:00."""
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 18 HOURS"))
    return bars.groupBy("symbol", day.alias("trading_day")).agg(F.max_by("close", "ts").alias("close"), F.count("*").alias("n"))


def sequences(rows: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """``steps``: the last n rows' values as an array of arrays, where there are n."""
    held = F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(R.frame(R.series("symbol", "chunk"), n))
    return by_stretch(rows, lambda b: b.withColumn("steps", held), n - 1).where(F.size("steps") == n)


def run_lengths(rows: DataFrame, state: str) -> DataFrame:
    """Number, longest and median length of the runs of each state."""
    turn = F.when(F.col(state) == F.lag(state).over(R.series("symbol", "chunk")), 0).otherwise(1)
    run = running(by_stretch(rows if "rn" in rows.columns else numbered(rows), lambda b: b.withColumn("_t", turn), 1), "_t", "sum", "_r")
    length = run.groupBy("symbol", F.col(state).alias("state"), "_r").agg(F.count("*").alias("_n"))
    return length.groupBy("symbol", "state").agg(F.count("*").alias("n_runs"), F.max("_n").alias("longest"), F.percentile("_n", 0.5).alias("median"))


def histogram(rows: DataFrame, x: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in equal bins of [low, high]; what is outside goes to the end bins."""
    b = F.least(F.greatest(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def conditioned(rows: DataFrame, x: str, groups: dict[str, object], least: int = 10) -> DataFrame:
    """Count, mean and 1.96 standard errors of x in overlapping groups of rows."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items())), lambda g: g.isNotNull())
    g = rows.withColumn("condition", F.explode(names)).groupBy("condition")
    return g.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))).alias("margin")).where(F.col("n") >= least)
