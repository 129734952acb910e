"""Principal components of sliding windows: a fixed-width vector for each place of a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS
from tidemark.operators.bars import chunked, numbered, previous

CHANNELS = ("r", "hl", "body", "rv", "imb", "act")


@dataclass
class Components:
    """mean and vectors (a row each) of windows flattened row by row; share: of the variance, of each vector."""

    mean: np.ndarray
    vectors: np.ndarray
    share: np.ndarray
    n: int


def channels(bars: DataFrame, development: Column, clip: float = 8.0) -> DataFrame:
    """symbol, ts and six channels of the bars, standardised by mean and deviation of the ``development`` rows, within the clip; 0 where null."""
    c = F.col("close")
    b = previous(bars, "close", "_c").select("symbol", "ts", development.alias("_dev"), F.log(c / F.col("_c")).alias("r"), ((F.col("high") - F.col("low")) / c).alias("hl"), ((c - F.col("open")) / c).alias("body"),
        F.sqrt("rv").alias("rv"), ((F.col("up") - F.col("down")) / (F.col("up") + F.col("down") + 1)).alias("imb"), F.col("absret").alias("act"))
    m = b.where("_dev").agg(*(f(x).alias(f"_{n}_{x}") for x in CHANNELS for n, f in (("m", F.avg), ("s", F.stddev_samp))))  # one row
    z = {x: F.coalesce(F.least(F.greatest((F.col(x) - F.col(f"_m_{x}")) / (F.col(f"_s_{x}") + EPS), F.lit(-clip)), F.lit(clip)), F.lit(0.0)) for x in CHANNELS}
    return b.join(F.broadcast(m)).withColumns(z).select("symbol", "ts", "_dev", *CHANNELS)


def views(group: pd.DataFrame, columns: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that end in the group's own rows, one flat row each, and where their last rows are."""
    x = np.ascontiguousarray(group[list(columns)].to_numpy(dtype=float))
    if len(x) < n:
        return np.zeros((0, n * len(columns))), np.zeros(0, dtype=int)
    last = np.flatnonzero(~group["halo"].to_numpy()[n - 1 :])
    return np.lib.stride_tricks.sliding_window_view(x, n, axis=0).transpose(0, 2, 1)[last].reshape(len(last), -1), last + n - 1


def components(rows: DataFrame, columns: Sequence[str], n: int, k: int, chunk_rows: int = 20_000) -> Components:
    """The k first components of all windows of n rows of (symbol, ts) series.

    Stretches sum their windows' values and outer products, in blocks; the driver gets (n * columns)^2 sums whatever the
    length of the series. A vector's largest entry is positive.
    """
    d = n * len(columns)
    own = chunked(numbered(rows.select("symbol", "ts", *columns)), chunk_rows, n - 1)

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        x, _ = views(group.sort_values("ts"), columns, n)
        total = np.zeros((d + 1, d + 1))
        for lo in range(0, len(x), 2000):
            one = np.hstack([x[lo : lo + 2000], np.ones((len(x[lo : lo + 2000]), 1))])
            total += one.T @ one
        return pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    total = np.zeros((d + 1) ** 2)
    for r in own.groupBy("symbol", "chunk").applyInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    total = total.reshape(d + 1, d + 1)
    count = max(total[d, d], 1.0)
    mean = total[d, :d] / count
    values, vectors = np.linalg.eigh(total[:d, :d] / count - np.outer(mean, mean))
    values, vectors = values[::-1], vectors[:, ::-1].T[:k]
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return Components(mean, vectors, values[:k] / max(values.sum(), 1e-300), int(total[d, d]))


def embedded(rows: DataFrame, columns: Sequence[str], n: int, model: Components, chunk_rows: int = 20_000) -> DataFrame:
    """symbol, ts and e0, e1, ... of every row that ends a window."""
    k = len(model.vectors)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        x, last = views(group, columns, n)
        e = (x - model.mean) @ model.vectors.T
        return pd.DataFrame({"symbol": group["symbol"].to_numpy()[last], "ts": group["ts"].to_numpy()[last], **{f"e{i}": e[:, i] for i in range(k)}})

    own = chunked(numbered(rows.select("symbol", "ts", *columns)), chunk_rows, n - 1)
    schema = f"symbol string, ts {rows.schema['ts'].dataType.simpleString()}, " + ", ".join(f"e{i} double" for i in range(k))
    return own.groupBy("symbol", "chunk").applyInPandas(run, schema)
