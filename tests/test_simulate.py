import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import simulate as M

T0 = dt.datetime(2024, 1, 3)
COLS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, a14 double, p_long double, p_short double, threshold double"


def run(spark, path, rules=M.Rules(cost_bp=0.0), gap_after=None):
    rows, t = [], T0
    for i, (o, h, low, c, p) in enumerate(path):
        rows.append(("s", t, float(o), float(h), float(low), float(c), 1.0, p, 0.0, 0.5))
        t += dt.timedelta(minutes=15 if i != gap_after else 600)
    df = spark.createDataFrame(rows, COLS)
    return M.simulate(M.with_context(df), rules).orderBy("exit_ts").collect()


FLAT = (100, 100.1, 99.9, 100, 0.0)
BUY = (100, 100.1, 99.9, 100, 0.9)


def test_market_exits(spark):
    (t,) = run(spark, [BUY, FLAT, (100, 101.6, 100, 101, 0.0), FLAT])
    assert (t.reason, t.exit, t.bars) == ("tp", 101.5, 1) and t.r_mult == pytest.approx(1.5)
    (t,) = run(spark, [BUY, FLAT, (100, 101.6, 98.9, 101, 0.0), FLAT])
    assert (t.reason, t.exit) == ("sl", 99.0) and t.r_mult == pytest.approx(-1)
    (t,) = run(spark, [BUY, *[FLAT] * 20])
    assert (t.reason, t.bars) == ("timeout", 15)


def test_gap_and_flatten(spark):
    path = [BUY, FLAT, FLAT, (97, 97, 97, 97, 0.0), FLAT]
    (t,) = run(spark, path, gap_after=2)
    assert (t.reason, t.exit) == ("gap", 97.0)
    (t,) = run(spark, path, M.Rules(cost_bp=0.0, flatten_before_gap=True), gap_after=2)
    assert (t.reason, t.exit) == ("pre_gap", 100.0)


def test_limit_fills_cancels_and_brackets(spark):
    rules = M.Rules(entry="limit", cost_bp=0.0)
    (t,) = run(spark, [BUY, (100, 100, 99.7, 100, 0.0), (100, 101.3, 100, 101, 0.0), FLAT], rules)
    assert (t.entry, t.reason, t.filled) == (99.75, "tp", True)
    (t,) = run(spark, [BUY, *[FLAT] * 8], rules)
    assert (t.reason, t.filled, t.r_mult) == ("cancel", False, 0.0)
    bracket = M.Rules(entry="bracket", offset=0.5, cost_bp=0.0)
    out = run(spark, [FLAT, (100, 100.6, 99.4, 100, 0.0), FLAT], bracket)
    assert out[0].reason == "whipsaw" and out[0].r_mult == pytest.approx(-1, abs=0.02)


def test_equity_is_the_product_of_gains(spark):
    path = [BUY, FLAT, (100, 101.6, 100, 101, 0.0)] * 20
    rows, t = [], T0
    for o, h, low, c, p in path:
        rows.append(("s", t, float(o), float(h), float(low), float(c), 1.0, p, 0.0, 0.5))
        t += dt.timedelta(minutes=90)
    b = M.with_context(spark.createDataFrame(rows, COLS))
    trades = M.simulate(b)
    done = sorted(trades.collect(), key=lambda x: x.exit_ts)
    assert all(x.exit_ts <= y.entry_ts or x.exit_ts == y.signal_ts for x, y in zip(done, done[1:]))
    perf = M.performance(trades, M.daily_equity(trades, b)).first()
    assert perf.final_equity == pytest.approx(math.prod(1 + x.pnl for x in done)) and perf.n_trades == len(done)
    flat = M.sized(trades, "flat1").orderBy("exit_ts").collect()
    assert flat[-1].curve == pytest.approx(math.prod(1 + 0.01 * x.r_mult for x in done))


def test_ruin_equals_replayed_histories(spark):
    r = random.Random(8)
    trades = [("s", "base", T0 + dt.timedelta(days=d, minutes=i), r.gauss(0.0, 8.0)) for d in range(9) for i in range(r.randrange(1, 5))]
    rows = [(s, c, t, t, x, True) for s, c, t, x in trades] + [("s", "base", T0, T0, None, True), ("s", "base", T0, T0, -90.0, False)]
    df = spark.createDataFrame(rows, "symbol string, scenario string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, r_mult double, filled boolean")
    days = [[x for _, _, t, x in trades if t.date() == d] for d in sorted({t.date() for _, _, t, _ in trades})]
    worst = []
    for rep in range(50):
        equity, peak, fall = 1.0, 1.0, 0.0
        for k in range(len(days)):
            for x in days[int(hashlib.md5(f"9:{rep}:{k}".encode()).hexdigest()[:8], 16) % len(days)]:
                equity *= 1 + 0.01 * x
                peak = max(peak, equity)
                fall = min(fall, equity / peak - 1)
        worst.append(fall)
    got = M.ruin(df, reps=50, floor=-0.4).first()
    assert got.mean_worst == pytest.approx(sum(worst) / 50) and got.ruin == pytest.approx(sum(w <= -0.4 for w in worst) / 50)
    assert M.ruin(df.limit(0), reps=5).count() == 0


def test_minutes_hold_only_new_extremes_and_touch_levels_alike(spark):
    r = random.Random(3)
    ticks = [("s", T0 + dt.timedelta(seconds=r.randrange(1800)), round(r.uniform(90, 110), 1), round(r.uniform(80, 90), 1)) for _ in range(400)]
    df = spark.createDataFrame(ticks * 5, "symbol string, ts timestamp_ntz, high double, low double")
    bars = spark.createDataFrame([("s", T0), ("s", T0 + dt.timedelta(minutes=15)), ("s", T0 + dt.timedelta(minutes=30))], "symbol string, ts timestamp_ntz")
    got = [x.minutes for x in M.attach_minutes(bars, df).orderBy("ts").collect()]
    assert got[2] == []
    for i in (0, 1):
        whole = [{"high": h, "low": low} for _, t, h, low in sorted(ticks) if (t - T0).seconds // 900 == i]
        assert len(got[i]) < 30 < len(whole)
        for _ in range(200):
            limit, side = r.uniform(80, 110), r.choice([1, -1])
            sl = limit - side * r.uniform(0, 5)
            assert M.stop_first(got[i], limit, sl, side) == M.stop_first(whole, limit, sl, side)


def test_kelly_from_running_sums_equals_plain_windows(spark):
    import numpy as np

    r = random.Random(8)
    x = [r.choice([1.4, -1.0, 0.3]) for _ in range(1500)] + [0.5] * 400
    rows = [("s", "base", T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i), v, True) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, scenario string, exit_ts timestamp_ntz, entry_ts timestamp_ntz, r_mult double, filled boolean")
    out = M.sized(df, "kelly025")
    assert "RowFrame, -300, -1)" not in out._jdf.queryExecution().optimizedPlan().toString()  # such a frame is added up anew for each row
    got = [t.fraction for t in out.orderBy("exit_ts").collect()]
    for i, f in enumerate(got):
        held = np.array(x[max(0, i - 300) : i])
        k = held.mean() / (held.var() + 1e-12) if len(held) else 0
        assert f == pytest.approx(0.01 if len(held) < 100 else min(max(0.0025 * k, 0.0025), 0.02) if k > 0 else 0.0025, abs=1e-9)


def test_curve_adds_up_exactly_however_trades_are_dealt(spark):
    rng = random.Random(5)
    n = 30_000
    rows = [("s", "base", T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i), rng.uniform(-1.0, 2.6), True) for i in range(n)]
    logs = [math.log(1 + 0.01 * r[4]) for r in rows]
    df = spark.createDataFrame(rows, "symbol string, scenario string, exit_ts timestamp_ntz, entry_ts timestamp_ntz, r_mult double, filled boolean")
    curves = [[t.curve for t in M.sized(dealt, "flat1").orderBy("exit_ts").collect()] for dealt in (df, df.orderBy(F.desc("exit_ts")).repartition(7))]
    assert curves[0] == curves[1]
    for i in range(999, n, 1000):
        assert curves[0][i] == pytest.approx(math.exp(math.fsum(logs[: i + 1])), rel=6e-14)
