import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import statistics as S


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [("k", i, round(r.random(), 2), r.randint(0, 1), i % 7) for i in range(300)]
    return data, spark.createDataFrame(data, "k string, i long, p double, y int, d int")


def test_auc(spark, rows):
    data, df = rows
    pos, neg = [x[2] for x in data if x[3]], [x[2] for x in data if not x[3]]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert S.auc(df, "p", "y", ["k"]).first().auc == pytest.approx(want)
    assert S.auc(df.withColumn("q", 1 - F.col("p")), "q", "y", ["k"]).first().auc == pytest.approx(1 - want)
    assert S.auc(df.where("y = 1"), "p", "y", ["k"]).first().auc is None


def test_drift_of_a_copy_is_nothing(spark, rows):
    _, df = rows
    both = df.withColumn("a", F.lit(True)).unionByName(df.withColumn("a", F.lit(False)))
    assert S.psi(both, "p", F.col("a"), ["k"]).first().psi == pytest.approx(0)


def test_bootstrap_contains_the_mean(spark, rows):
    data, df = rows
    r = S.day_bootstrap(df, "p", F.col("d"), reps=400).first()
    assert r.low <= r["mean"] <= r.high and r["mean"] == pytest.approx(sum(x[2] for x in data) / len(data))


def test_student_tail():
    assert S.student_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert S.student_tail(0, 5) == 1.0
    assert S.student_tail(1.959964, 1e7) == pytest.approx(0.05, abs=1e-4)


def test_constant_scores(spark, rows):
    _, df = rows
    assert S.spearman(df.withColumn("c", F.lit(1.0)), "p", "c", ["k"]).first().ic is None


def test_clusters():
    import numpy as np

    m = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert S.clusters(m, ["a", "b", "c"]) == [("a", 1, True), ("b", 1, True), ("c", 2, False)]
    assert math.isclose(1, 1)


def test_ranks_of_one_key_are_in_ranges(spark):
    """One key, many ties, a tie that is larger than a range: ranks equal a plain count, and no window is over a bare key."""
    r = random.Random(8)
    values = [r.choice([r.random(), 0.5, 0.25, -0.0, 0.0]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v, int(r.random() < 0.3 + 0.4 * v)) for i, v in enumerate(values)], "i long, v double, y int").repartition(6)
    got = S.ranked(df, "v", [])
    for row in got.collect():
        below, same = sum(v < row.v for v in values), sum(v == row.v for v in values)
        assert row._rank == below + (same + 1) / 2
    one = S.auc(df, "v", "y").first()
    pos, neg = [x.v for x in df.where("y = 1").collect()], [x.v for x in df.where("y = 0").collect()]
    assert one.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    top = S.top_payoff(df, "v", "y", "i").first()
    best = sorted(df.collect(), key=lambda x: (-x.v, x.i))[:150]
    assert top.top_n == 150 and top.top_payoff == pytest.approx(sum(2.5 * x.y - 1 for x in best) / 150)
    matrix = {(m.x, m.y): m.rho for m in S.spearman_matrix(df, ["i", "v", "y"]).collect()}
    import pandas as pd

    want = pd.DataFrame([tuple(x) for x in df.collect()], columns=["i", "v", "y"]).corr(method="spearman")
    assert all(rho == pytest.approx(want.loc[a, b]) for (a, b), rho in matrix.items()) and len(matrix) == 3
    assert "_row" not in S.spearman_matrix(df, ["i", "v", "y"])._jdf.queryExecution().optimizedPlan().toString()  # rows aren't put together again by number


def test_digamma(spark):
    got = spark.range(1, 200).select("id", S.digamma(F.col("id")).alias("d")).collect()
    assert all(r.d == pytest.approx(-0.5772156649015329 + sum(1 / i for i in range(1, r.id)), abs=1e-12) for r in got)


def information(points, k):
    """By looking at all pairs of rows."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    points = [p for p in points if p[0] is not None and p[1] is not None]
    points = [p for p in points if sum(q[1] == p[1] for q in points) > 1]
    parts = []
    for i, (x, y) in enumerate(points):
        near = sorted(abs(x - u) for j, (u, v) in enumerate(points) if v == y and j != i)
        own = min(k, len(near))
        r = near[own - 1]
        parts.append((psi(own), psi(len(near) + 1), psi(sum(x - r < u < x + r or r == 0 and u == x for u, _ in points))))
    return max(0.0, psi(len(points)) + sum(a - b - c for a, b, c in parts) / len(points)), len(points)


@pytest.mark.parametrize("stretch", [20_000, 40])
def test_neighbour_information(spark, stretch):
    """2,000 rows with ties, classes of few rows and one of a single row, nulls; stretches don't matter."""
    r = random.Random(12)
    data = [("a", float(round(r.gauss(3 * y, 1) * 64)) / 64, y) for y in (r.choice([0, 0, 1]) for _ in range(1500))] + [("b", float(r.randint(0, 40)), r.randint(0, 2)) for _ in range(500)]
    data += [("a", None, 1), ("a", 1.0, None), ("a", 2.0, 7), ("b", 3.0, 8), ("b", 9.0, 8), ("b", 3.0, 9), ("b", 3.0, 9), ("b", 4.0, 9)]
    df = spark.createDataFrame(data, "g string, x double, y int").repartition(5)
    got = {x.g: (x.information, x.n) for x in S.neighbour_information(df, "x", "y", ["g"], stretch=stretch).collect()}
    for g in "ab":
        want = information([(x, y) for h, x, y in data if h == g], 5)
        assert got[g] == (pytest.approx(want[0], abs=1e-9), want[1])
