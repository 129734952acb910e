"""Gaussian hidden-Markov regimes: distributed fitting over stretches of series, and the causal filter as a prefix scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import last_known, numbered
from tidemark.shared import written

COLUMNS = ("x1", "x2")


def observations(bars: DataFrame) -> DataFrame:
    """x1: log return times 1000 (0 if none); x2: log of the realised variance, the last one where it is 0, -20 before any."""
    known = last_known(bars, F.log(F.nullif(F.col("rv"), F.lit(0.0))), "_logged")
    return known.withColumns({"x1": F.coalesce(F.col("lr") * 1e3, F.lit(0.0)), "x2": F.coalesce("_logged", F.lit(-20.0))}).drop("_logged")


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of each row in each state."""
    d = x[:, None, :] - model["mean"][None]
    return -0.5 * ((d * d / model["var"]).sum(axis=2) + np.log(2 * np.pi * model["var"]).sum(axis=1))


def fit(rows: DataFrame, states: int = 3, iterations: int = 60, keys: tuple[str, ...] = ("symbol", "chunk"), gain: float = 1e-2) -> dict:
    """Model shared by all series: start, transition, mean and var, by expectation maximisation.

    A stretch (symbol, chunk) is a sequence of its own, at most a chunk long; each iteration sums its expected counts in a
    grouped aggregate, so the driver sees as many numbers as the model has. It ends after ``iterations`` or when the log
    likelihood gains less than ``gain``. Rows are kept by the executors between iterations and made anew if one is lost.
    States are ordered by their second mean.
    """
    rows = rows.select(*keys, "ts", *COLUMNS).repartition(*keys).persist()
    try:
        return _maximised(rows, states, iterations, keys, gain)
    finally:
        rows.unpersist()


def _maximised(rows: DataFrame, states: int, iterations: int, keys: tuple[str, ...], gain: float) -> dict:
    q = [(i + 0.5) / states for i in range(states)]
    cuts = rows.agg(*(F.percentile(c, F.array(*map(F.lit, q))).alias(f"q_{c}") for c in COLUMNS), *(F.var_pop(c).alias(f"v_{c}") for c in COLUMNS)).first()
    model = {
        "start": np.full(states, 1 / states), "trans": np.full((states, states), 0.05) + np.eye(states) * (1 - 0.05 * states),
        "mean": np.array([[0.0 if c == "x1" else cuts[f"q_{c}"][k] for c in COLUMNS] for k in range(states)]), "var": np.array([[max(cuts[f"v_{c}"] or 1.0, 1e-3) for c in COLUMNS]] * states),
    }
    d = len(COLUMNS)
    width = states + states * states + states * (1 + 2 * d) + 1
    reached = -np.inf
    for _ in range(iterations):
        now = {k: v.copy() for k, v in model.items()}

        def expect(group: pd.DataFrame) -> pd.DataFrame:
            model = now
            x = group.sort_values("ts")[list(COLUMNS)].to_numpy()
            log_b = emissions(model, x)
            top = log_b.max(axis=1, keepdims=True)
            b = np.exp(log_b - top)
            alpha, scale = np.zeros_like(b), np.zeros(len(x))
            p = model["start"] * b[0]
            for t in range(len(x)):
                if t:
                    p = (alpha[t - 1] @ model["trans"]) * b[t]
                scale[t] = p.sum() or 1e-300
                alpha[t] = p / scale[t]
            beta = np.ones_like(b)
            move = np.zeros((states, states))
            for t in range(len(x) - 2, -1, -1):
                back = b[t + 1] * beta[t + 1] / scale[t + 1]
                move += alpha[t][:, None] * model["trans"] * back[None]
                beta[t] = model["trans"] @ back
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            flat = np.concatenate([gamma[0], move.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ (x * x)).ravel(), [np.log(scale).sum() + top.sum()]])
            return pd.DataFrame({"i": np.arange(width), "v": flat})

        got = rows.groupBy(*keys).applyInPandas(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        s = np.zeros(width)
        for r in got:
            s[r["i"]] = r["v"]
        start, move, n, first, second = np.split(s[:-1], np.cumsum([states, states * states, states, states * d]))
        mean = first.reshape(states, d) / n[:, None]
        model = {
            "start": start / start.sum(), "trans": (m := move.reshape(states, states) + 1e-9) / m.sum(axis=1, keepdims=True), "mean": mean,
            "var": np.maximum(second.reshape(states, d) / n[:, None] - mean**2, 1e-3),
        }
        if s[-1] - reached < gain:
            break
        reached = s[-1]
    order = np.argsort(model["mean"][:, 1])
    return {"start": model["start"][order], "trans": model["trans"][np.ix_(order, order)], "mean": model["mean"][order], "var": model["var"][order]}


def passed(model: dict, p: np.ndarray, x: np.ndarray, first: bool) -> np.ndarray:
    """The normalised state vectors after each row, from the vectors before the first, which run side by side; a series' ``first`` row has no transition before it."""
    log_b = emissions(model, x)
    b = np.exp(log_b - log_b.max(axis=1, keepdims=True))
    out = np.empty((len(x), *p.shape))
    for t in range(len(x)):
        p = (p if first and not t else p @ model["trans"]) * b[t]
        p = p / max(p.sum(), 1e-300)
        out[t] = p
    return out


def filtered(rows: DataFrame, model: dict, gate: float = 0.6, stretch: int = 20_000) -> DataFrame:
    """symbol, ts, the probability of each state given what was seen so far, and whether the highest state's is above ``gate``.

    A prefix scan in three steps, so that no series is one task. Each stretch of a series multiplies its rows' transition and
    emission matrices into one matrix, scaled as it goes; the matrices, one row a stretch, are chained over the series to the
    vector with which each stretch begins; the stretches' rows then run from there.
    """
    states = len(model["start"])
    own = rows.select("symbol", "ts", *COLUMNS)
    cut = written(numbered(own).withColumn("chunk", F.floor((F.col("rn") - 1) / stretch).cast("int")), "stretches")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("ts")[list(COLUMNS)].to_numpy()
        return pd.DataFrame({"symbol": group["symbol"].iloc[:1], "chunk": group["chunk"].iloc[:1], "m": [passed(model, np.eye(states), x, group["chunk"].iloc[0] == 0)[-1].ravel().tolist()]})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        p, begins = model["start"], []
        for m in group["m"]:
            begins.append(p.tolist())
            p = p @ np.asarray(m).reshape(states, states)
            p = p / max(p.sum(), 1e-300)
        return pd.DataFrame({"symbol": group["symbol"], "chunk": group["chunk"], "p": begins})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        p = passed(model, np.asarray(group["p"].iloc[0])[None], group[list(COLUMNS)].to_numpy(), group["chunk"].iloc[0] == 0)[:, 0]
        return pd.DataFrame({"symbol": group["symbol"], "ts": group["ts"], **{f"p{i}": p[:, i] for i in range(states)}, "gate": p[:, -1] > gate})

    matrices = cut.groupBy("symbol", "chunk").applyInPandas(product, "symbol string, chunk int, m array<double>")
    begin = matrices.groupBy("symbol").applyInPandas(chain, "symbol string, chunk int, p array<double>")  # one row a stretch
    schema = f"symbol string, ts {own.schema['ts'].dataType.simpleString()}, " + ", ".join(f"p{i} double" for i in range(states)) + ", gate boolean"
    return cut.join(begin, ["symbol", "chunk"]).groupBy("symbol", "chunk").applyInPandas(run, schema)
