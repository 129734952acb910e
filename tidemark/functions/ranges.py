"""Order over all rows without one task that holds them: rows by ranges of their order, one row of totals a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written


def in_ranges(rows: DataFrame, *order: str | Column, out: str = "_range") -> DataFrame:
    """The rows with the number of their range: cut points come from a sample, and all rows of a range precede those of the next.

    Rows that are equal in ``order`` share a range. The result is written, as a second sample could cut elsewhere.
    """
    return written(rows.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), "ranges")


def sums_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str], within: str = "_range") -> DataFrame:
    """Rows of ``in_ranges`` with, for each new column of ``sums``, the sum of a column over all rows of the key that precede the row.

    Sums run inside (keys, range); the ranges' totals, a row for each range that a key reaches into, run over the key.
    ``in_ranges`` must have been given the keys and ``order``, and no two rows of a key may be equal in it.
    """
    total = rows.groupBy(*keys, within).agg(*(F.sum(x).alias(f"_t_{new}") for new, x in sums.items()))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a range
    over = over.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(within).alias("_b_within"), *(F.coalesce(F.sum(f"_t_{new}").over(over), F.lit(0)).alias(f"_b_{new}") for new in sums))
    here = Window.partitionBy(*keys, within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(x).over(here), F.lit(0)).alias(f"_h_{new}") for new, x in sums.items()))
    on = F.col(within) == F.col("_b_within")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = rows.join(before, on).drop("_b_within", *(f"_k_{k}" for k in keys))
    return rows.withColumns({new: F.col(f"_h_{new}") + F.col(f"_b_{new}") for new in sums}).drop(within, *(f"_{p}_{new}" for new in sums for p in "hb"))
