import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import research
from tidemark.operators import folds
from tidemark.operators import importance as I
from tidemark.operators import models
from tidemark.plans import grammar
from tidemark.plans.screen import screen

SF = "/root/testdata/sf0.01"


LONG = {"features_lags", "features_all", "labels_expansion"}  # their parts are tested; whole, they take half a minute each


@pytest.mark.parametrize("name", sorted(set(research.ORACLES) & set(research.QUERIES) - LONG))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "labels", "orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(research.ORACLES[name]).fetchdf()
    got = research.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if got[c].dtype.kind == "f":
            both = got[c].isna() & want[c].isna()
            assert ((got[c].astype(float) - want[c].astype(float)).abs() < 1e-5)[~both].all(), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_shuffle_is_a_permutation(spark):
    """Every feature keeps its values, changes places, and leaves the others alone; the order of rows and partitions doesn't matter."""
    df = spark.createDataFrame([(i, float(i), float(i % 7), i % 2) for i in range(500)], "id long, a double, b double, y int")
    out = I.shuffled(df.repartition(5), "id", ["a", "b"], ["y"]).collect()
    by = {c: {r.id: r for r in out if r.column == c} for c in ("", "a", "b")}
    assert all(len(x) == 500 for x in by.values())
    assert sorted(r.a for r in by["a"].values()) == [float(i) for i in range(500)] and sum(r.a == r.id for r in by["a"].values()) < 20
    assert all(r.b == r.id % 7 and r.y == r.id % 2 for r in by["a"].values()) and all(r.a == r.id for r in by["b"].values())
    again = I.shuffled(df.orderBy(F.desc("id")).repartition(3), "id", ["a", "b"], ["y"]).collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in again}


def test_drop_tells_what_a_score_uses(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, x, r.random(), int(x + r.random() > 1)) for i, x in ((i, r.random()) for i in range(2000))], "id long, x double, z double, y int")
    got = {row.column: row["drop"] for row in I.auc_drops(df, "id", ["x", "z"], "y", lambda d: d.withColumn("score", F.col("x"))).collect()}
    assert got["x"] > 0.25 and got["z"] == 0


@pytest.mark.parametrize("kind, rounds", [("gbt", 3), ("forest", 5)])
def test_gain_shares(spark, kind, rounds):
    """Shares sum to one for each fold, say what the label depends on, and are the same again."""
    r = random.Random(5)
    rows = [("s", f"{2000 + i // 300}-01-01", i + 1, x, r.random(), int(x > 0.5)) for i, x in ((i, r.random()) for i in range(1200))]
    df = spark.createDataFrame(rows, "symbol string, day string, rn long, x double, z double, y int").withColumn("ts", F.to_date("day"))
    plan = folds.year_folds(df)
    shares = [I.gain_shares(models.fold_models(df, plan, ["x", "z"], "y", kind, rounds), ["x", "z"]) for _ in range(2)]
    assert [s[:2] for s in shares[0]] == [s[:2] for s in shares[1]] and [s[2] for s in shares[0]] == pytest.approx([s[2] for s in shares[1]])  # sums in another order
    for year in {s[0] for s in shares[0]}:
        own = {f: s for y, f, s in shares[0] if y == year}
        assert sum(own.values()) == pytest.approx(1) and own["x"] > 0.9
    top = I.gain_importance(df, plan, ["x", "z"], "y", kind, rounds, top=1).collect()
    assert [t.feature for t in top] == ["x"] and top[0].n_folds == 3


def test_screen_finds_a_planted_column(spark):
    """Of 60 columns of noise and one that goes with the target, that one is accepted; one whose sign turns isn't even tested."""
    r = random.Random(4)
    rows = []
    for i in range(4000):
        y = r.gauss(0, 1)
        rows.append((i, y, *(r.gauss(0, 1) for _ in range(60)), y + r.gauss(0, 3), y * (1 if i < 500 else -1)))
    names = [f"n{k}" for k in range(60)] + ["good", "turns"]
    df = spark.createDataFrame(rows, "i long, y double, " + ", ".join(f"{n} double" for n in names)).withColumn("ts", F.timestamp_seconds(F.lit(946684800) + F.col("i") * 86400).cast("timestamp_ntz"))
    got = {x.name: x for x in screen(df, names, "y", "2000-01-01", "2001-06-01", "2003-01-01", "year", 20, 200).collect()}
    assert len(got) == 20 and got["good"].accepted and "turns" not in got
    assert sum(x.accepted for x in got.values()) == 1


def test_many_trees_share_their_subtrees(spark):
    """A hundred trees are as many projections as their greatest height, and each value equals that of its tree alone."""
    rng = random.Random(11)
    trees = {f"t{i}": grammar.random_tree(rng, 3) for i in range(30)}
    bars = grammar.base_series(research.bars_of(spark, SF))
    some = [n for n, t in trees.items() if grammar.reach(t) < 400][:6]
    every = {(r.symbol, r.ts): r for r in grammar.evaluate(bars, trees).select("symbol", "ts", *some).collect()}
    for n in some[:3]:
        for r in grammar.evaluate(bars, {n: trees[n]}).select("symbol", "ts", n).collect():
            a, b = r[n], every[r.symbol, r.ts][n]
            assert (a is None or a != a) and (b is None or b != b) or a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_training_rows_in_bounded_parts(spark, monkeypatch):
    """However the rows are dealt, a fold's rows come in parts of about PART, and models don't depend on the dealing; kinds share one preparation."""
    monkeypatch.setattr(models, "PART", 100)
    r = random.Random(6)
    rows = [("s", f"{2000 + i // 400}-01-01", i + 1, x, r.random(), int(x + r.random() > 1)) for i, x in ((i, r.random()) for i in range(1200))]
    df = spark.createDataFrame(rows, "symbol string, day string, rn long, x double, z double, y int").withColumn("ts", F.to_date("day"))
    plan = folds.year_folds(df)
    shares = []
    for dealt in (df.coalesce(1), df.orderBy(F.desc("rn")).repartition(3, "x")):
        got = models.models_of(dealt, plan, ["x", "z"], "y", {"forest": 3, "gbt": 2})
        assert all(got["forest"][y].stages[:3] == got["gbt"][y].stages[:3] for y in (2001, 2002))
        shares.append([s[2] for kind in got for s in I.gain_shares(got[kind], ["x", "z"])])
        sizes = models.training(dealt.withColumn("label", F.col("y").cast("double")), plan, 2002, 704, ["x", "z"]).rdd.glom().map(len).collect()
        assert sum(sizes) == 704 and max(sizes) < 200
    assert shares[0] == pytest.approx(shares[1])


def test_longest_years_first_and_nodes_kept(spark, monkeypatch):
    """Years are fitted by falling number of training rows and come back in order; kept nodes give the same trees."""
    r = random.Random(9)
    rows = [("s", f"{2000 + i // 300}-01-01", i + 1, x, r.random(), int(x + r.random() > 1)) for i, x in ((i, r.random()) for i in range(1200))]
    df = spark.createDataFrame(rows, "symbol string, day string, rn long, x double, z double, y int").withColumn("ts", F.to_date("day"))
    asked, training = [], models.training
    monkeypatch.setattr(models, "training", lambda rows, plan, year, *a: asked.append(year) or training(rows, plan, year, *a))
    fitted = models.fold_models(df, folds.year_folds(df), ["x", "z"], "y", "forest", 4, at_once=1)
    assert asked == [2003, 2002, 2001] and list(fitted) == [2001, 2002, 2003]
    ready = models.preparation(["x", "z"]).fit(df).transform(df).select("features", F.col("y").cast("double").alias("label")).persist()
    forest = models.classifier("forest", 1200, 2, 4)
    assert forest.getCacheNodeIds()
    kept, walked = (forest.setCacheNodeIds(c).fit(ready).toDebugString.split("\n", 1)[1] for c in (True, False))
    assert kept == walked
    ready.unpersist()


def whole_models(monkeypatch):
    """Notes the trees or steps that a query asks for, by kind, and fits one instead."""
    asked, classifier = {}, models.classifier

    def noted(kind, n, width, rounds=None):
        whole = classifier(kind, n, width, rounds)
        asked[kind] = whole.getNumTrees() if kind == "forest" else whole.getMaxIter()
        return classifier(kind, n, width, 1)

    monkeypatch.setattr(models, "classifier", noted)
    return asked


def test_gains_are_of_whole_models(spark, monkeypatch):
    """Gain is that of the reference's 400 boosted and 300 bagged trees, whose lineage can be cut."""
    asked = whole_models(monkeypatch)
    for kind in ("gbt", "forest"):
        assert research.QUERIES[f"importance_gain_{kind}"](spark, SF).count() == 8
    assert asked == {"gbt": 400, "forest": 300} and spark.sparkContext.getCheckpointDir()


def test_walk_forward_compares_whole_models(spark, monkeypatch):
    """All five kinds are fitted with all their trees or steps; the logistic one and margins until they settle."""
    asked = whole_models(monkeypatch)
    got = research.QUERIES["walk_forward_models"](spark, SF).collect()
    assert {r.kind for r in got} == set(asked) == {"gbt", "forest", "mlp", "svm", "logistic"} and len(got) == 30
    assert (asked["gbt"], asked["forest"], asked["mlp"]) == (400, 300, 60) and asked["svm"] >= 50 and asked["logistic"] >= 100
