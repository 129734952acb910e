import datetime as dt

from tidemark.operators.labels import barriers, forward_returns

T0 = dt.datetime(2024, 1, 2)


def bars(spark, rows, gap_after=None):
    out, t = [], T0
    for i, (o, h, low, c) in enumerate(rows):
        out.append(("s", t, float(o), float(h), float(low), float(c), 1.0))
        t += dt.timedelta(minutes=15 if i != gap_after else 600)
    return spark.createDataFrame(out, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, a14 double")


FLAT = (100, 100.2, 99.8, 100)


def first(spark, path, gap_after=None):
    rows = [FLAT, *path, *[FLAT] * 20]
    return barriers(bars(spark, rows, gap_after)).orderBy("ts").first()


def test_stop_wins_in_one_bar(spark):
    r = first(spark, [FLAT, (100, 102, 98, 100)])
    assert (r.y_tp_long, r.y_tp_short, r.time_to_hit) == (0.0, 0.0, 2.0)
    assert (r.mfe_16, r.mae_16) == (2.0, 2.0)


def test_target_and_timeout(spark):
    r = first(spark, [FLAT, (100, 101.6, 100, 101)])
    assert (r.y_tp_long, r.y_tp_short, r.time_to_hit) == (1.0, 0.0, 2.0)
    r = first(spark, [FLAT])
    assert (r.y_tp_long, r.y_tp_short, r.time_to_hit) == (None, None, None) and round(r.mfe_16, 9) == 0.2


def test_gap_at_once_leaves_no_label(spark):
    r = first(spark, [(100, 102, 98, 100)], gap_after=0)
    assert (r.y_tp_long, r.mfe_16) == (None, None)


def test_tail(spark):
    b = bars(spark, [FLAT] * 20)
    assert [r.mfe_16 is None for r in barriers(b).orderBy("ts").collect()] == [False] * 3 + [True] * 17
    tail = forward_returns(b).orderBy("ts").collect()[-1]
    assert (tail.fwd_ret_1, tail.y_dir_1) == (None, 0)
