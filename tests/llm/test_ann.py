import math
import random

from tidemark.llm import ann


def brute(rows, queries, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in sorted({i: v for i, v in sorted(fine, reverse=True) if i in queries}.items()):
        near = []
        for i, b in fine:
            if i != q and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b):
                    total += (x - y) ** 2
                near.append((math.sqrt(total), i))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted(near)[:k], 1)]
    return out


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(1)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(r.gauss(0, 1)) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 12) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None] + [0.0] * 10), (2004, [float("nan")] * 12), (2005, [float("inf")] * 12), (None, [1.0] * 12), (2006, [1.0, 2.0]), (3, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS cb")
    queries = {0, 100, 200, 1000, 2006, 3}
    want = brute(rows, queries, 10)
    for c, q in ((4096, 1024), (64, 2)):
        monkeypatch.setattr(ann, "CANDIDATES", c)
        monkeypatch.setattr(ann, "QUERIES", q)
        got = sorted(tuple(x) for x in ann.nearest(df, df.where(f"vec_id in ({','.join(map(str, queries))})")).collect())
        if (c, q) == (4096, 1024):
            assert [g[:2] for g in got if g[0] != 3] == [w[:2] for w in want if w[0] != 3]
        assert [g for g in got if g[0] != 3] == [w for w in want if w[0] != 3]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
