import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import regimes as H

START = dt.datetime(2020, 1, 1)


def silent(n, quiet):
    """Bars with swings, gaps and breaks first, then ``quiet`` bars that each rise a little inside the last one's range, then a few more swings."""
    r, out, price = random.Random(3), [], 100.0
    for i in range(n):
        if 300 <= i < 300 + quiet:
            low, high = 90.0 + i * 1e-4, 120.0 + i * 1e-4  # no bar is the extreme of seven but the newest
            out.append((i, 100.0 + i * 1e-4, high, low, 100.00005 + i * 1e-4))
        else:
            o, price = price, price + r.gauss(0, 2)
            out.append((i, o, max(o, price) + r.random(), min(o, price) - r.random(), price))
    return [("s", START + dt.timedelta(minutes=15 * i), float(o), h, low, c, 1, 0.01, 0.01, 1, 0, 0.1) for i, o, h, low, c in out]


COLUMNS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, n long, rv double, absret double, up long, down long, range_sum double"


def test_structure_over_a_long_silence(spark):
    """Nothing happens for 30,000 bars: swings, breaks and gaps from before stay known, as in one task over the whole series."""
    df = spark.createDataFrame(silent(31_000, 30_000), COLUMNS).withColumn("utc", F.col("ts"))
    names = [c for c in X.FAMILIES["structure"]]
    some = lambda chunk, halo: {r.ts: r for r in X.structure(X.prepare(df, chunk, halo, "structure"), chunk, halo).where("not halo").select("ts", *names).collect()}
    whole, parts = some(10**6, 0), some(4_000, 500)
    assert whole.keys() == parts.keys() and len(whole) == 31_000
    for ts, r in whole.items():
        for c in names:
            assert r[c] == pytest.approx(parts[ts][c], rel=1e-9, abs=1e-9) if r[c] is not None else parts[ts][c] is None, (ts, c)
    last = parts[START + dt.timedelta(minutes=15 * 30_200)]
    assert last.dist_swing_high is not None and last.dist_fvg_bull is not None and last.bars_since_bos == 500


def test_last_known(spark):
    rows = [("a", START + dt.timedelta(hours=7 * i), v) for i, v in enumerate([None, 1.0, None, None, None, None, None, None, 2.0, None, None, None])] + [("b", START, None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").repartition(4)
    got = [r.y for r in B.last_known(df, F.col("x"), "y").where("symbol = 'a'").orderBy("ts").collect()]
    assert got == [None, *[1.0] * 7, *[2.0] * 4]
    assert B.last_known(df, F.col("x"), "y").where("symbol = 'b'").first().y is None


@pytest.mark.parametrize("stretch", [20_000, 37, 1])
def test_filter_equals_the_fold(spark, stretch):
    """The scan over stretches of any length gives what one pass over the series gives."""
    r = np.random.default_rng(2)
    model = {"start": np.array([0.5, 0.3, 0.2]), "trans": np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.02, 0.08, 0.9]]), "mean": np.array([[0.0, -2.0], [0.0, 0.0], [0.0, 2.0]]), "var": np.ones((3, 2))}
    series = {"a": r.normal(0, 2, (150, 2)), "b": r.normal(1, 3, (40, 2)), "c": r.normal(0, 1, (1, 2))}
    rows = [(s, START + dt.timedelta(minutes=15 * i), float(u), float(v)) for s, x in series.items() for i, (u, v) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x1 double, x2 double").repartition(3)
    got = {(q.symbol, q.ts): q for q in H.filtered(df, model, stretch=stretch).collect()}
    assert len(got) == len(rows)
    for s, x in series.items():
        p = None
        for i, row in enumerate(x):
            b = [math.exp(-0.5 * sum((row[k] - model["mean"][j][k]) ** 2 for k in range(2))) for j in range(3)]
            p = np.array(b) * (model["start"] if p is None else p @ model["trans"])
            p /= p.sum()
            q = got[s, START + dt.timedelta(minutes=15 * i)]
            assert [q.p0, q.p1, q.p2] == pytest.approx(p.tolist(), abs=1e-9) and q.gate == (p[-1] > 0.6)
