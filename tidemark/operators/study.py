"""Tables of a study: data checks, subsets, alignments, folds, period sums, shares and curve statistics."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, share of nulls (and of NaN in numbers with a point), from one aggregate."""
    kinds = {f.name: f.dataType for f in rows.schema}
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if isinstance(kinds[c], T.FloatType | T.DoubleType) else F.col(c).isNull()
    one = rows.agg(*(F.avg(gone(c).cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))).alias("s")).select("s.*")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Each value of the column and how many rows have it."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def time_slice(rows: DataFrame, ts: str, begin: str, end: str) -> DataFrame:
    """Rows from begin (included) to end (left out); the bounds are constants, so they reach the scan."""
    kind = rows.schema[ts].dataType.simpleString()
    return rows.where((F.col(ts) >= F.lit(begin).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def of_years(rows: DataFrame, ts: str, years: Sequence[int]) -> DataFrame:
    """Rows of the listed years."""
    return rows.where(F.year(ts).isin(list(years)))


def without(rows: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The rows without the columns whose names match one of the patterns."""
    return rows.select(*(c for c in rows.columns if not any(fnmatch.fnmatchcase(c, p) for p in patterns)))


def columns_only_in(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of the one and not of the other, in order."""
    return [c for c in left.columns if c not in right.columns]


def standardised(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], fit: Column | None = None, most: float = 8.0) -> DataFrame:
    """Columns less their mean over their (population) standard deviation by key, cut to -most..most; both are learned from the rows of ``fit``."""
    own = rows.where(fit) if fit is not None else rows
    s = own.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
    joined = rows.join(s, list(keys), "left")
    return joined.withColumns({c: F.greatest(F.least(z(c), F.lit(most)), F.lit(-most)) for c in columns}).select(*rows.columns)


def imputed(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], fit: Column | None = None) -> DataFrame:
    """Nulls and NaN of the columns give way to the column's median by key, learned from the rows of ``fit``; where a key has none there, they stay null."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    own = rows.where(fit) if fit is not None else rows
    medians = own.groupBy(*keys).agg(*(F.percentile(known(c), 0.5).alias(f"_m_{c}") for c in columns))
    return rows.join(medians, list(keys), "left").withColumns({c: F.coalesce(known(c), F.col(f"_m_{c}")) for c in columns}).select(*rows.columns)


def gated(rows: DataFrame, gate: Column, columns: Sequence[str]) -> DataFrame:
    """The columns are null where the gate doesn't hold."""
    return rows.withColumns({c: F.when(gate, F.col(c)) for c in columns})


def reindexed(rows: DataFrame, index: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row for each row of the index, in which what ``rows`` lacks is null."""
    return index.select(*on).join(rows, list(on), "left")


def joined_later(rows: DataFrame, other: DataFrame, keys: Sequence[str], ts: str, shift: str, columns: Sequence[str], prefix: str = "r_") -> DataFrame:
    """Rows with the columns of the other table's row whose time is theirs plus ``shift`` (an interval), or nulls."""
    right = other.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col(ts) - F.expr(f"INTERVAL {shift}")).alias("_at"), *(F.col(c).alias(prefix + c) for c in columns))
    on = F.col(ts) == F.col("_at")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(right, on, "left").drop("_at", *(f"_{k}" for k in keys))


def looked_up(rows: DataFrame, key: Column, values: Mapping[int, float], out: str, other: float | None = None) -> DataFrame:
    """A value for each row by a small mapping, which is a constant of the plan."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return rows.withColumn(out, F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(other)) if pairs else F.lit(other))


def scenarios(rows: DataFrame, named: Mapping[str, float], name: str = "scenario", value: str = "cost") -> DataFrame:
    """Every row under each of a few named scenarios, which are constants of the plan."""
    return rows.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.lit(v).alias(value)) for k, v in named.items())))).select(*rows.columns, "_s.*")


def expanding_folds(rows: DataFrame, ts: str, first: int, last: int, validation: str = "90 DAYS") -> DataFrame:
    """fold (test year), part: test, or for what is before it train and, at its end, validation."""
    fold = rows.withColumn("fold", F.explode(F.sequence(F.lit(first), F.lit(last)))).where(F.year(ts) <= F.col("fold"))
    begin = F.make_date("fold", F.lit(1), F.lit(1)).cast(rows.schema[ts].dataType)
    part = F.when(F.year(ts) == F.col("fold"), "test").when(F.col(ts) >= begin - F.expr(f"INTERVAL {validation}"), "validation").otherwise("train")
    return fold.withColumn("part", part)


def halves(rows: DataFrame, ts: str, cut: str) -> DataFrame:
    """half: dev before the cut, oos from it; even: whether the year is even."""
    kind = rows.schema[ts].dataType
    return rows.withColumns({"half": F.when(F.col(ts) < F.lit(cut).cast(kind), "dev").otherwise("oos"), "even": F.year(ts) % 2 == 0})


def period_sums(rows: DataFrame, ts: str, x: str, keys: Sequence[str], period: str) -> DataFrame:
    """Sum, count and number of distinct days of x by key and period (year, month, day)."""
    at = F.date_trunc(period, ts).cast("date").alias(period)
    return rows.groupBy(*keys, at).agg(F.sum(x).alias("total"), F.count(x).alias("n"), F.count_distinct(F.to_date(ts)).alias("days"))


def filled_months(rows: DataFrame, ts: str, x: str, keys: Sequence[str]) -> DataFrame:
    """Sum of x for every month from a key's first to its last; 0 for those without rows."""
    sums = rows.groupBy(*keys, F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(F.sum(x).alias("total"))
    span = sums.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return span.join(sums, [*keys, "month"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def summary(rows: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, least and greatest of x by key."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))


def shares(rows: DataFrame, key: str, weight: str, top: int) -> DataFrame:
    """The ``top`` keys by their sum of weight, with their share of the whole; ties go to the smaller key."""
    total = rows.groupBy(key).agg(F.sum(weight).alias("gain"))
    whole = total.agg(F.sum("gain").alias("_all"))  # one row
    best = total.orderBy(F.desc("gain"), key).limit(top)
    return best.join(F.broadcast(whole)).select(key, "gain", (F.col("gain") / F.col("_all")).alias("share"))


def above_quantile(rows: DataFrame, x: str, q: float, keys: Sequence[str]) -> DataFrame:
    """Rows whose x is at or above its quantile by key."""
    cut = rows.groupBy(*keys).agg(F.percentile(x, F.lit(q)).alias("_q"))
    return rows.join(cut, list(keys)).where(F.col(x) >= F.col("_q")).drop("_q")


def daily_volatility(days: DataFrame, close: str, keys: Sequence[str], day: str, n: int = 21) -> DataFrame:
    """Standard deviation of the last n daily log returns, a year's (252 days); one row a day, so a key's days fit a task."""
    w = Window.partitionBy(*keys).orderBy(day)
    r = days.withColumn("_r", F.log(F.col(close) / F.lag(close).over(w)))
    last = w.rowsBetween(1 - n, 0)
    return r.withColumn("volatility", F.when(F.count("_r").over(last) == n, F.stddev_samp("_r").over(last) * F.sqrt(F.lit(252.0)))).drop("_r")


def curve(days: DataFrame, equity: str, keys: Sequence[str], day: str) -> DataFrame:
    """Yearly growth (365 days), largest drawdown and their ratio of a daily equity curve; one row a day."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    d = days.withColumn("_dd", F.col(equity) / F.max(equity).over(w) - 1)
    s = d.groupBy(*keys).agg(F.min_by(equity, day).alias("_a"), F.max_by(equity, day).alias("_b"), F.datediff(F.max(day), F.min(day)).alias("days"), F.min("_dd").alias("max_drawdown"))
    growth = F.when(F.col("days") > 0, F.pow(F.col("_b") / F.col("_a"), F.lit(365.0) / F.col("days")) - 1)
    return s.select(*keys, "days", growth.alias("cagr"), "max_drawdown", (growth / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).alias("mar"))


def judged(tests: DataFrame, p: str, level: float = 0.05, effect: str | None = None, size: float = 0.0, sign: str | None = None) -> DataFrame:
    """The tests with ``accepted``: p is under the level over the number of tests (Bonferroni), the ``effect`` is at least ``size`` from zero and has the sign of the column ``sign``."""
    n = tests.agg(F.count(p).alias("_n"))  # one row
    fine = F.col(p) < F.lit(level) / F.col("_n")
    if effect:
        fine = fine & (F.abs(effect) >= size)
    if effect and sign:
        fine = fine & (F.signum(effect) == F.signum(sign))
    return tests.join(F.broadcast(n)).withColumn("accepted", F.coalesce(fine, F.lit(False))).drop("_n")


def accepted(tests: DataFrame, p: str, level: float = 0.05, effect: str | None = None, size: float = 0.0, sign: str | None = None) -> DataFrame:
    """The tests that ``judged`` accepts."""
    return judged(tests, p, level, effect, size, sign).where("accepted").drop("accepted")


def drift_against(years: DataFrame, drift: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Era means and the correlation of a yearly drift with a yearly score, by key."""
    return years.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(drift).alias("drift"), F.avg(score).alias("score"), F.corr(drift, score).alias("correlation"))
