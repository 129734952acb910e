"""The screen of formula columns: two halves choose, later periods test, in one melted pass of rank correlations each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.shared import written


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of the columns are numbers."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows


def screen(values: DataFrame, names: Sequence[str], target: str, begin: str, cut: str, end: str, period: str = "year", top: int = 20, least: int = 500, level: float = 0.05, size: float = 0.01) -> DataFrame:
    """name, ic_a, ic_b, n_periods, oos_ic, t, p and accepted of the ``top`` columns.

    values: ts, the target and a column for each name. A column's rank correlation with the target is taken in the halves
    [begin, cut) and [cut, end); columns without ``least`` rows in both, constant ones and those whose signs differ are
    out. The ``top`` by the smaller of both magnitudes (ties by name) are tested by their correlations in the periods from
    ``end`` on, each of at least ``least`` rows: a t-test of a mean of zero, accepted if p is under ``level`` over the
    number tested, the mean is ``size`` or more from zero and has the sign of the first half.

    All columns are ranked together as (name, half) and (name, period) keys of one melted table, by ranges; what is joined
    by broadcast are the chosen names, ``top`` rows at most.
    """
    ts = values.schema["ts"].dataType.simpleString()
    at = lambda x: F.lit(x).cast(ts)
    long = finite(S.melted(values, names, ["ts", target]), "value", target)
    half = F.when(F.col("ts") < at(cut), "a").otherwise("b")
    dev = long.where((F.col("ts") >= at(begin)) & (F.col("ts") < at(end))).withColumn("half", half)
    ics = S.spearman(dev, "value", target, ["column", "half"], least)
    both = ics.groupBy("column").agg(*(F.max(F.when(F.col("half") == h, F.col("ic"))).alias(f"ic_{h}") for h in "ab"))
    same = both.where(F.signum("ic_a") == F.signum("ic_b")).withColumn("_score", F.least(F.abs("ic_a"), F.abs("ic_b")))
    best = written(same.orderBy(F.desc("_score"), "column").limit(top).select("column", "ic_a", "ic_b"), "chosen")  # top rows
    later = long.where(F.col("ts") >= at(end)).join(F.broadcast(best.select("column")), "column").withColumn("period", F.date_trunc(period, "ts"))
    tested = S.t_test(S.spearman(later, "value", target, ["column", "period"], least), "ic", ["column"])
    many = F.broadcast(best.agg(F.count("*").alias("_many")))
    fine = (F.col("p") < F.lit(level) / F.col("_many")) & (F.abs("oos_ic") >= size) & (F.signum("oos_ic") == F.signum("ic_a"))
    out = best.join(tested.withColumnsRenamed({"n": "n_periods", "mean": "oos_ic"}), "column", "left").join(many)
    return out.select(F.col("column").alias("name"), "ic_a", "ic_b", F.coalesce("n_periods", F.lit(0)).cast("long").alias("n_periods"), "oos_ic", "t", "p", F.coalesce(fine, F.lit(False)).alias("accepted"))
