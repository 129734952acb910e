import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as R
from tidemark.operators.bars import by_stretch, chunked, keep_last, numbered, previous, quality, resample
from tidemark.operators.series import drawdown
from tidemark.operators.smoothing import below, ranked, smoothed, span
from tidemark.plans import grammar

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walk():
    r = random.Random(1)
    x, rows = 100.0, []
    for i in range(400):
        x *= 1 + r.gauss(0, 0.01)
        rows.append(("s", T0 + dt.timedelta(minutes=15 * i), x))
    return pd.DataFrame(rows, columns=["symbol", "ts", "x"])


def frame(spark, walk):
    return spark.createDataFrame(walk, "symbol string, ts timestamp_ntz, x double")


def test_rolling_equals_pandas(spark, walk):
    w = R.series("symbol")
    df = frame(spark, walk).withColumn("rn", F.row_number().over(w)).withColumn("x1", F.lag("x").over(w))
    got = df.select("ts", R.skew("x", w, 32).alias("skew"), R.kurt("x", w, 32).alias("kurt"), R.zscore("x", w, 16).alias("z"), R.rank_share("x", w, 8).alias("rank"), R.autocorr1("x", "x1", w, 20).alias("ac"), R.mean_deviation("x", w, 20).alias("mad"), R.since_extreme("x", w, 26, True).alias("arg"), R.share_below("x", w, 20).alias("below")).orderBy("ts").toPandas()
    s = walk["x"]
    want = {
        "skew": s.rolling(32).skew(), "kurt": s.rolling(32).kurt(), "z": (s - s.rolling(16).mean()) / (s.rolling(16).std() + 1e-12), "rank": s.rolling(8).rank(pct=True), "ac": s.rolling(20).apply(lambda v: pd.Series(v[1:]).corr(pd.Series(v[:-1])), raw=True),
        "mad": s.rolling(20).apply(lambda v: abs(v - v.mean()).mean(), raw=True), "arg": s.rolling(26).apply(lambda v: v.argmax(), raw=True), "below": s.rolling(20).apply(lambda v: (v[:-1] < v[-1]).mean(), raw=True),
    }
    for name, values in want.items():
        pd.testing.assert_series_equal(got[name].astype(float), values, check_names=False, rtol=1e-6, atol=1e-9)


def test_constant_series_has_no_correlation_and_no_error(spark):
    rows = [("s", T0 + dt.timedelta(minutes=i), 5.0) for i in range(30)]
    w = R.series("symbol")
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").withColumn("x1", F.lag("x").over(w))
    assert {r[0] for r in df.select(R.autocorr1("x", "x1", w, 10)).collect()} == {None, 0.0}


def test_chunks_with_a_halo_change_nothing(spark, walk):
    w = R.series("symbol", "chunk")
    out = []
    for size in (37, 10_000):
        b = chunked(numbered(frame(spark, walk)), size, 120)
        b = smoothed(b, {"ema": ("x", span(5), 5)}).withColumn("z", R.zscore("x", w, 60))
        out.append(b.where("not halo").select("ts", "ema", "z").orderBy("ts").toPandas())
    assert len(out[0]) == len(walk)
    pd.testing.assert_frame_equal(out[0], out[1], rtol=1e-9)
    pd.testing.assert_series_equal(out[1]["ema"], walk["x"].ewm(span=5, adjust=False, min_periods=5).mean(), check_names=False)


def test_numbered_and_drawdown(spark, walk):
    got = drawdown(numbered(frame(spark, walk)), "x").orderBy("ts").toPandas()
    assert got["rn"].tolist() == list(range(1, 401))
    pd.testing.assert_series_equal(got["drawdown"], walk["x"] / walk["x"].cummax() - 1, check_names=False)


def test_bars_and_quality(spark):
    at = lambda m, s=0: T0 + dt.timedelta(minutes=m, seconds=s)
    ticks = [("a", at(0), 10.0, 1), ("a", at(0), 11.0, 2), ("a", at(14), 9.0, 3), ("a", at(15), 12.0, 4), ("a", at(50), 8.0, 5)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, price double, seq long")
    got = resample(keep_last(df, "symbol", "ts")).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.n, r.up, r.down) for r in got] == [(at(0), 11.0, 11.0, 9.0, 9.0, 2, 0, 1), (at(15), 12.0, 12.0, 12.0, 12.0, 1, 1, 0), (at(45), 8.0, 8.0, 8.0, 8.0, 1, 0, 1)]
    q = quality(resample(keep_last(df, "symbol", "ts"))).first()
    assert (q.n_rows, q.violations, q.non_positive, q.outliers) == (3, 0, 0, 2)
    assert resample(df.limit(0)).count() == 0


def test_records_of_one_time_all_count_in_the_order_of_seq(spark):
    at = lambda d, m: T0 + dt.timedelta(days=d, minutes=m)
    ticks = [("a", at(0, 3), 9.0, 2), ("a", at(0, 3), 10.0, 1), ("a", at(0, 14), 12.0, 4), ("a", at(0, 14), 11.0, 5), ("a", at(0, 14), 8.0, 3), ("a", at(1, 0), 11.0, 7), ("a", at(1, 0), 7.0, 8)]
    got = resample(spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, price double, seq long")).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.n, r.up, r.down) for r in got] == [(at(0, 0), 10.0, 12.0, 8.0, 11.0, 5, 1, 3), (at(1, 0), 11.0, 11.0, 7.0, 7.0, 2, 0, 1)]
    seven = resample(spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, price double, seq long"), 7).orderBy("ts").first()  # bars that cross days
    assert (seven.open, seven.close, seven.n) == (10.0, 9.0, 2)


def test_long_ranks_equal_pandas_and_do_not_depend_on_chunks(spark):
    r = random.Random(4)
    values = [None if r.random() < 0.02 else float(r.randrange(400)) for _ in range(1500)]
    s = pd.Series(values, dtype=float)
    n = 40
    want = s.rolling(n).apply(lambda v: (v[:-1] < v[-1]).mean(), raw=True)
    assert below(s.to_numpy(), n)[~want.isna()] == pytest.approx(want.dropna().to_numpy())
    rows = [("s", T0 + dt.timedelta(minutes=15 * i), x) for i, x in enumerate(values)]
    b = chunked(numbered(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")), 111, 60)
    got = ranked(b, {"r": ("x", n)}).where("not halo").orderBy("ts").toPandas()["r"]
    pd.testing.assert_series_equal(got.astype(float), want, check_names=False)
    long = pd.Series([r.random() for _ in range(7000)])
    assert below(long.to_numpy(), 6048)[6500] == (long[453:6500] < long[6500]).sum() / 6047


def test_previous_value_passes_over_empty_days(spark):
    at = lambda d, h: T0 + dt.timedelta(days=d, hours=h)
    rows = [("a", at(0, 1), 1.0), ("a", at(0, 2), None), ("a", at(0, 3), 3.0), ("a", at(4, 0), 4.0), ("b", at(4, 5), 5.0)]
    got = previous(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"), "x", "before").orderBy("symbol", "ts").collect()
    assert [r.before for r in got] == [None, 1.0, None, 3.0, None]


def test_stretches_give_what_whole_series_give(spark, walk):
    w = R.series("symbol", "chunk")
    add = lambda b: b.withColumns({"next": F.lead("x", 10).over(w), "z": R.zscore("x", w, 20)})
    out = [by_stretch(frame(spark, walk), add, 19, 10, size).orderBy("ts").toPandas() for size in (7, 64, 10_000)]
    assert out[0].columns.tolist() == ["symbol", "ts", "x", "next", "z"] and len(out[0]) == len(walk)
    for one in out[:2]:
        pd.testing.assert_frame_equal(one, out[2], rtol=1e-9)
    pd.testing.assert_series_equal(out[2]["next"], walk["x"].shift(-10), check_names=False)
    assert by_stretch(frame(spark, walk).limit(0), add, 19, 10).count() == 0


def test_grammar_smoothing_equals_pandas(spark, walk):
    df = frame(spark, walk).withColumns({b: F.col("x") for b in grammar.BASES})
    tree = {"op": "lag", "w": 8, "a": {"op": "ema", "w": 16, "a": {"op": "r"}}}
    assert grammar.reach(tree) == 322
    got = grammar.evaluate(df, {"f": tree}).orderBy("ts").toPandas()["f"]
    pd.testing.assert_series_equal(got.astype(float), walk["x"].ewm(span=16, min_periods=16).mean().shift(2), check_names=False)
