import datetime as dt
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.smoothing import below
from tidemark.sources import ticks as T

MINUTES = ["20240102 170100;2063.1;2063.5;2062.9;2063.2;0", "20240102 170000;2062.5;2063.2;2062.4;2063.1;0"]


def test_minute_files(spark, tmp_path):
    """The same records from headerless files and from archives, which hold other members too; times as written."""
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text("\n".join(MINUTES))
    (tmp_path / "zipped").mkdir()
    with zipfile.ZipFile(tmp_path / "zipped" / "a.zip", "w") as z:
        z.writestr("readme.txt", "no data")
        z.writestr("DAT.CSV", "\n".join(MINUTES))
    with zipfile.ZipFile(tmp_path / "zipped" / "empty.zip", "w") as z:
        z.writestr("readme.txt", "no data")
    plain, zipped = (sorted(map(tuple, f(spark, str(tmp_path / d), "x").collect())) for f, d in ((T.read_minutes, "plain"), (T.read_zipped_minutes, "zipped")))
    assert plain == zipped == [("x", dt.datetime(2024, 1, 2, 17, 0), 2062.5, 2063.2, 2062.4, 2063.1, 0.0), ("x", dt.datetime(2024, 1, 2, 17, 1), 2063.1, 2063.5, 2062.9, 2063.2, 0.0)]


def test_calendar_index_and_documents(spark, tmp_path):
    (tmp_path / "calendar.csv").write_text("date,event,hour_est\n2024-01-05,NFP,8\n2024-01-31,FOMC,14\n")
    assert [tuple(r) for r in T.read_calendar(spark, str(tmp_path / "calendar.csv")).orderBy("date").collect()] == [(dt.date(2024, 1, 5), "NFP", 8), (dt.date(2024, 1, 31), "FOMC", 14)]
    (tmp_path / "rank.csv").write_text(",mean gain,vif\nret_1,0.25,1.5\natr14,0.75,\n")
    assert {tuple(r) for r in T.read_indexed(spark, str(tmp_path / "rank.csv"), "feature").collect()} == {("ret_1", 0.25, 1.5), ("atr14", 0.75, None)}
    (tmp_path / "thresholds.json").write_text(json.dumps({"2024": {"threshold": 0.9, "val_exp_R": 0.1}, "2025": {"threshold": 0.8, "val_exp_R": None}}, indent=1))
    assert {tuple(r) for r in T.read_document(spark, str(tmp_path / "thresholds.json"), "threshold: double, val_exp_R: double").collect()} == {("2024", 0.9, 0.1), ("2025", 0.8, None)}


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 2), 1.5, "x, \"y\""), ("b", dt.datetime(2024, 1, 3), None, "")], "symbol string, ts timestamp_ntz, close double, note string")
    T.write_bars(rows, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert sorted(p.name for p in (tmp_path / "bars").iterdir() if p.is_dir()) == ["symbol=a", "symbol=b"]
    T.write_csv(rows.select("symbol", "close", "note").where("close IS NOT NULL"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", "true").schema("symbol string, close double, note string").csv(str(tmp_path / "csv")).collect()] == [("a", 1.5, "x, \"y\"")]
    T.write_document(rows, str(tmp_path / "json"))
    assert sorted(map(str, spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect())) == sorted(map(str, rows.collect()))
    bars = rows.select("symbol", "ts", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")), F.lit(1).alias("n"))
    T.write_report(B.quality_text(B.quality(bars)), str(tmp_path / "report"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert len(lines) == 2 and lines[0].startswith("a: 1 rows, 0 violations")


def test_panels_of_meetings(spark):
    html = '<div class="month"><strong>January/February</strong></div><div class="date">31-1</div><div class="month">March</div><div class="date">19-20*</div><div class="month">June</div><div class="date">31</div>'
    got = T.meeting_dates(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string"), F.lit(2024)).orderBy("position").collect()
    assert [(r.page_id, r.date) for r in got] == [(1, dt.date(2024, 2, 1)), (1, dt.date(2024, 3, 20))]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_share_below(n):
    r = random.Random(n)
    values = np.array([r.choice([np.nan, 1.0, 2.0, r.random(), r.random(), r.random()]) if r.random() < 0.2 else r.random() for _ in range(400)])
    got = below(values, n)
    for i, x in enumerate(values):
        frame = values[max(0, i - n + 1) : i + 1]
        if i < n - 1 or np.isnan(frame).any():
            assert np.isnan(got[i])
        else:
            assert got[i] == (frame[:-1] < x).sum() / max(n - 1, 1)
    assert len(below(np.zeros(0), n)) == 0 and np.isnan(below(np.full(3, np.nan), n)).all()
