"""Exponential smoothing and ranks of many columns in one pass over bounded stretches of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def smoothed(rows: DataFrame, specs: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = ("symbol", "chunk"), order: str = "ts", adjust: bool = False) -> DataFrame:
    """Adds a column for each of ``specs``: name -> (input, weight of the newest value, values needed before a result).

    The recursion starts at the first value. Rows are grouped by (symbol, chunk), see ``bars.chunked``; the halo before a
    chunk is long enough that what was before it has a weight below the precision of a double. The grouping is that of
    the windows around it, so no further exchange is made.
    """
    schema = T.StructType(rows.schema.fields + [T.StructField(n, T.DoubleType()) for n in specs])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        new = {n: group[x].astype(float).ewm(alpha=a, adjust=adjust, min_periods=least).mean() for n, (x, a, least) in specs.items()}
        return group.assign(**new)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def below(values: np.ndarray, n: int) -> np.ndarray:
    """Share of the n - 1 values before each that are strictly below it; NaN where the last n aren't all there.

    Counts for all rows at once: the ranks' bits, from the highest, part the rows stably in two, and each row's frame keeps its
    two ends in the part that its own rank goes to (a wavelet matrix). As many passes as the ranks have bits.
    """
    there = ~np.isnan(values)
    known = np.unique(values[there])
    rank = np.where(there, np.searchsorted(known, values), len(known))  # a missing value is below none
    high = np.arange(len(values))
    low = np.maximum(high - n + 1, 0)
    count, left = np.zeros(len(values), dtype=np.int64), rank.copy()
    for bit in range(int(len(known)).bit_length() - 1, -1, -1):
        one = (left >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        up = ((rank >> bit) & 1).astype(bool)
        count += np.where(up, zeros[high] - zeros[low], 0)
        low, high = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        left = np.concatenate([left[one == 0], left[one == 1]])
    held = np.concatenate([[0], np.cumsum(there)])
    at = np.arange(len(values))
    return np.where((at >= n - 1) & (held[at + 1] - held[np.maximum(at + 1 - n, 0)] == n), count / max(n - 1, 1), np.nan)


def ranked(rows: DataFrame, specs: dict[str, tuple[str, int]], keys: tuple[str, ...] = ("symbol", "chunk"), order: str = "ts") -> DataFrame:
    """Adds a column for each of ``specs``: name -> (input, n), the share of the n - 1 rows before that are strictly below.

    Long frames cost as many passes as a stretch's ranks have bits, see ``below``. The halo before a chunk
    must hold n - 1 rows or more.
    """
    schema = T.StructType(rows.schema.fields + [T.StructField(name, T.DoubleType()) for name in specs])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.assign(**{name: below(group[x].to_numpy(dtype=float, na_value=np.nan), n) for name, (x, n) in specs.items()})

    return rows.groupBy(*keys).applyInPandas(run, schema)


def span(n: int) -> float:
    """Weight of the newest value for a span of n."""
    return 2 / (n + 1)
