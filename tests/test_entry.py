import datetime as dt
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.operators.joins import asof
from tidemark.plans import grammar

SF = "/root/testdata/sf0.001"
CHECKED = ["bars_15m", "features_candles", "labels_forward", "auc_exact", "asof_previous", "interval_join"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "labels", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = [c for c in ("symbol", "ts", "t0", "k", "event_id") if c in got.columns]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert got[c].astype(float).sub(want[c].astype(float)).abs().max() < 1e-5 or got[c].isna().all()


@pytest.mark.parametrize("name", ["bars_15m", "features_activity", "grammar_columns", "grammar_operations"])
def test_repeated_events_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT e.* REPLACE (event_id + i * 1000000 AS event_id) FROM range(3) r(i), '{SF}/events.parquet' e) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf().sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = entry.queries()[name](spark, str(tmp_path)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) and set(got.columns) == set(want.columns)
    for c in got.select_dtypes("number").columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-5, equal_nan=True), c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_asof_over_buckets(spark):
    t = dt.datetime(2024, 1, 1)
    right = spark.createDataFrame([("a", t, 1), ("a", t, 2), ("a", t + dt.timedelta(days=3), 3)], "k string, ts timestamp_ntz, v int")
    left = spark.createDataFrame([("a", t, 1), ("a", t + dt.timedelta(days=2), 2), ("a", t + dt.timedelta(days=3), 3), ("b", t, 4)], "k string, ts timestamp_ntz, i int")
    strict = {r.i: r.r_v for r in asof(left, right, "k", "ts", ["v"], strict=True).collect()}
    assert strict == {1: None, 2: 2, 3: 2, 4: None}
    loose = {r.i: r.r_v for r in asof(left, right, "k", "ts", ["v"]).collect()}
    assert loose == {1: 2, 2: 2, 3: 3, 4: None}


def test_grammar_text_and_depth():
    tree = grammar.random_tree(random.Random(4), 3)
    assert grammar.text(tree) == grammar.text(grammar.random_tree(random.Random(4), 3))
    assert grammar.text({"op": "add", "w": 4, "a": {"op": "r"}, "b": {"op": "zs", "w": 8, "a": {"op": "rv"}}}) == "add(r, zs(rv, 8))"
