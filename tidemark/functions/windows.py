"""Window expressions with the null rules of rolling statistics: a value only where a whole frame of values is there."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Added to denominators that can be zero.
EPS = 1e-12


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """The value where the last n rows all have an x."""
    return F.when(F.count(x).over(frame(w, n)) == n, value)


def rolling(name: str, x: str | Column, w: WindowSpec, n: int) -> Column:
    """avg, sum, min, max, stddev_samp, var_samp or another aggregate of the last n rows."""
    x = col(x)
    return full(getattr(F, name)(x).over(frame(w, n)), x, w, n)


def zscore(x: str | Column, w: WindowSpec, n: int) -> Column:
    return (col(x) - rolling("avg", x, w, n)) / (rolling("stddev_samp", x, w, n) + EPS)


def skew(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness."""
    return rolling("skewness", x, w, n) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    return (rolling("kurtosis", x, w, n) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def slope(x: str | Column, row: str | Column, w: WindowSpec, n: int) -> Column:
    """Least-squares slope against the row number."""
    x = col(x)
    return full(F.regr_slope(x, col(row)).over(frame(w, n)), x, w, n)


def corr(x: str | Column, y: str | Column, over: WindowSpec | None = None) -> Column:
    """Correlation of the pairs without nulls, as an aggregate or over a frame; null where one of them is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    c, a, b = parts if over is None else (p.over(over) for p in parts)
    return c / F.nullif(a * b, F.lit(0.0))


def autocorr1(x: str | Column, before: str | Column, w: WindowSpec, n: int) -> Column:
    """Correlation of the frame's values with those one row earlier, both inside the frame; 0 where the frame is constant."""
    x = col(x)
    inner = corr(x, before, w.rowsBetween(-(n - 2), 0))
    return full(F.when(F.stddev_pop(x).over(frame(w, n)) == 0, F.lit(0.0)).otherwise(inner), x, w, n)


def share_below(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Share of the n - 1 rows before that are strictly below; 0 where x is null in a full frame of rows."""
    x = col(x)
    held = F.collect_list(x).over(w.rowsBetween(-(n - 1), -1))
    return F.when(F.count(x).over(frame(w, n)) == n, F.size(F.filter(held, lambda y: y < x)) / (n - 1))


def rank_share(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Average rank of x among the last n values over n."""
    x = col(x)
    held = F.collect_list(x).over(frame(w, n))
    below, same = F.size(F.filter(held, lambda y: y < x)), F.size(F.filter(held, lambda y: y == x))
    return full((below + (same + 1) / 2) / n, x, w, n)


def since_extreme(x: str | Column, w: WindowSpec, n: int, largest: bool) -> Column:
    """Place (from 0) of the first largest or smallest value among the last n."""
    x = col(x)
    held = F.collect_list(x).over(frame(w, n))
    return full(F.array_position(held, F.array_max(held) if largest else F.array_min(held)) - 1, x, w, n)


def mean_deviation(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Mean absolute deviation from the frame's mean."""
    x = col(x)
    held, mean = F.collect_list(x).over(frame(w, n)), F.avg(x).over(frame(w, n))
    return full(F.aggregate(held, F.lit(0.0), lambda a, y: a + F.abs(y - mean)) / n, x, w, n)


def filled(x: str | Column, w: WindowSpec) -> Column:
    """The last value so far."""
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def flag(condition: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
