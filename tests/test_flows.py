import datetime as dt
import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import flows
from tidemark.operators import embedding as V
from tidemark.shared import written
from tidemark.sources import jobs
from tidemark.sources.documents import document_rows, documents_from
from tidemark.streaming.bars import late_rows, run_bars, stream_bars

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 3, 1)
TICKS = "symbol string, ts timestamp_ntz, price double, seq long"


@pytest.mark.parametrize("name", sorted(flows.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(flows.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = flows.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_stream_stops_and_goes_on(spark, tmp_path):
    """Files arrive, the query is stopped between and started anew: each bar is written once and equals the batch's; repeated ticks count once, late ones are counted and left out."""
    r = random.Random(2)
    ticks = [("ab"[i % 2], START + dt.timedelta(seconds=40 * i), 100 + r.random(), i) for i in range(1200)]
    late = [("a", START + dt.timedelta(seconds=5 + k), 999.0, 9000 + k) for k in range(3)]
    files = [ticks[:300], ticks[300:600] + ticks[290:300] + ticks[300:310], ticks[600:900] + late, ticks[900:], [("a", START + dt.timedelta(days=2), 1.0, 99_999)]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    dropped, seen = 0, []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(source)
        query = run_bars(stream, out, state, once=k != 1)
        if k == 1:  # a query that would go on is stopped from outside
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
        dropped += late_rows(query)
        seen.append(spark.read.parquet(out).count() if k else 0)
    assert seen == sorted(seen) and 0 < seen[1] < seen[-1]
    got = spark.read.parquet(out).collect()
    want = stream_bars(spark.createDataFrame(ticks, TICKS)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == set(map(tuple, want))
    assert dropped == 3


def test_second_run_reads_nothing(spark, tmp_path):
    """Parts are fetched once; a run that breaks leaves nothing that counts; parts without rows stay pending."""
    path = str(tmp_path / "kept")
    wanted = lambda *p: spark.createDataFrame([(x,) for x in p], "part string")
    asked = []

    def fetch(left):
        asked.append(sorted(r.part for r in left.collect()))
        return left.where("part != 'none'").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3))))

    assert jobs.run_jobs(wanted("2020", "2021/1", "none"), fetch, path) == 2
    assert jobs.run_jobs(wanted("2020", "2021/1"), fetch, path) == 0

    def breaks(left):
        asked.append(sorted(r.part for r in left.collect()))
        return left.withColumn("x", F.when(F.col("part") == "2023", F.raise_error(F.lit("lost"))).otherwise(1).cast("int"))

    with pytest.raises(Exception, match="lost"):
        jobs.run_jobs(wanted("2022", "2023"), breaks, path)
    assert jobs.manifest(spark, path).count() == 2
    assert jobs.run_jobs(wanted("2020", "2021/1", "2022", "2023"), fetch, path) == 2
    assert asked == [["2020", "2021/1", "none"], ["2022", "2023"], ["2022", "2023"]]
    assert sorted((r.part, r.x) for r in jobs.kept(spark, path).collect()) == sorted((p, x) for p in ("2020", "2021/1", "2022", "2023") for x in (1, 2, 3))


def test_documents_round_trip(spark):
    docs = [
        {"a": {"b": [1, 2.5, {"c": None, "d": "x\"y/\\é"}], "": {}}, "z": [], "n": True}, [[], [[1]], "t"], 5, "text", None, {}, {"2024": {"threshold": 0.85, "val_exp_R": 0.1}, "2025": {"threshold": 0.9, "val_exp_R": None}},
        {"deep": {"er": {"and": {"deep": {"er": [[[[{"end": 1}]]]]}}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken")], "i int, doc string")
    rows = document_rows(df, "i", "doc")
    found = {(r.i, tuple(s.key if s.key is not None else s.pos for s in r.path)): json.loads(r.value) for r in rows.collect()}
    assert found[0, ("a", "b", 2, "d")] == "x\"y/\\é" and found[0, ("a", "")] == {} and found[6, ("2025", "threshold")] == 0.9 and found[2, ()] == 5
    back = {r.i: json.loads(r.document) for r in documents_from(rows, "i").collect()}
    assert back == dict(enumerate(docs))
    assert document_rows(df.limit(0), "i", "doc").count() == 0 and documents_from(rows.limit(0), "i").count() == 0


def test_documents_in_few_passes(spark, monkeypatch):
    """Four levels of nesting are one written pass, deeper ones another each four; documents are put together without any. Keys come as they were."""
    from tidemark.sources import documents

    passes = []
    monkeypatch.setattr(documents, "written", lambda df, name: passes.append(name) or written(df, name))
    docs = ['{"a":{"b":{"c":[1,{}]}},"z":"{\\"x\\":1}"}', '{"\\u001F\\n\\\\u00ab":"[","é\\"":[[],null]}', '[[[[[[[[[7]]]]]]]]]', "null", '"{"', None, "{"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    assert document_rows(df.where("i < 2"), "i", "doc").count() == 6 and len(passes) == 1
    back = documents_from(document_rows(df, "i", "doc"), "i").collect()
    assert len(passes) == 4 and {r.i: r.document for r in back} == dict(enumerate(docs[:5]))


@pytest.mark.parametrize("chunk", [20_000, 50])
def test_components_equal_numpy(spark, chunk):
    r = np.random.default_rng(4)
    series = {"a": np.cumsum(r.normal(size=(300, 2)), axis=0) * 0.1, "b": r.normal(size=(120, 2)), "c": r.normal(size=(3, 2))}
    rows = [(s, START + dt.timedelta(minutes=i), float(u), float(v)) for s, x in series.items() for i, (u, v) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, u double, v double").repartition(4)
    model = V.components(df, ["u", "v"], 5, 3, chunk)
    windows = {s: np.array([x[i : i + 5].ravel() for i in range(len(x) - 4)]) for s, x in series.items() if len(x) >= 5}
    every = np.vstack(list(windows.values()))
    values, vectors = np.linalg.eigh(np.cov(every.T, bias=True))
    assert model.n == len(every) and model.share == pytest.approx(values[::-1][:3] / values.sum(), rel=1e-9)
    assert np.abs(np.sum(model.vectors * vectors[:, ::-1].T[:3], axis=1)) == pytest.approx([1, 1, 1])
    got = {(q.symbol, q.ts): [q.e0, q.e1, q.e2] for q in V.embedded(df, ["u", "v"], 5, model, chunk).collect()}
    assert len(got) == len(every)
    for s, x in windows.items():
        for i, row in enumerate(x):
            assert got[s, START + dt.timedelta(minutes=i + 4)] == pytest.approx(((row - model.mean) @ model.vectors.T).tolist(), abs=1e-9)
