import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import filter_audit as A

SF = "/root/testdata/sf0.001"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Every count by applying every order to every text."""
    texts = [(i, t or "", s or "") for i, t, s in docs]

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        return out + "E" * any(i is not None and j is not None and j < i and u == t for j, u, _ in texts)

    rows = [(s, fails(i, t), any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)) for i, t, s in texts]
    out = {}
    for part in {s for s, *_ in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                earlier = [r for r in own if f in r[0] and set(order[:k]) & set(r[0])]
                out[part, order, k + 1] = [len(left), len(removed), len(earlier), sum(r[0] == f for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                if len(out[part, order, k + 1]) == 6:
                    out[part, order, k + 1].append(sum(out[part, p, p.index(f) + 1][1] for p in map("".join, itertools.permutations("ABCDE"))))
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["word", "Word", "été", "a" * 17, "a" * 16 + "b", "b" + "a" * 16, "x#", "LOUD", "ß", "日本", "tiny", "1"]

    def text():
        n = rng.choice([0, 1, 50, 199, 200, 201, 300])
        own = rng.sample(words, rng.randint(1, len(words))) + [f"w{i}" for i in range(rng.choice([0, 150, 300]))]
        return "".join(rng.choice(own) + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for _ in range(n))

    docs = [(i, text(), rng.choice(["p", "q", "", None])) for i in range(60)]
    docs += [(100 + i, docs[i % 7][1], "p") for i in range(20)] + [(200, None, "q"), (201, "", None), (None, "", "q"), (None, docs[0][1], "p"), docs[3], docs[3], (3, "other", "q")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*x, 7, "clash", 1) for x in docs], "doc_id long, text string, source string, failed int, part string, n long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(A.audit(d, lab)) == brute(docs, labels)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(d, lab).count() == 0
    one = A.audit(spark.createDataFrame([(1, None, None)], d.schema), lab).collect()
    assert len(one) == 600 and all(r.part == "" and r.kept == (0 if "A" in r.filter_order[: r.step] else 1) for r in one)


def test_long_text_and_steps(spark):
    """A text longer than a vectorised step, and more texts than a step has rows."""
    long = " ".join(f"w{i % 150_000}" for i in range(200_000))
    data = np.frombuffer(long.encode(), np.uint8)
    assert A.failed(data, np.array([0, len(data)])).tolist() == [0]
    d = spark.range(70_000, numPartitions=1).selectExpr("id AS doc_id", "concat('t', id) AS text", "'s' AS source")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.removed for r in A.audit(d, lab).where("filter_order = 'ABCDE' AND step = 1").collect()} == {70_000}


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that takes few values, distinct words stay right, as neighbours are compared."""
    monkeypatch.setattr(A, "mix", lambda h: (h % np.uint64(3)) << np.uint64(40))
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice([1, 2, 20]) for _ in range(80)) for _ in range(30)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts, ends, first = A.word_spans(data, offsets)
    row = np.repeat(np.arange(30), np.diff(first))
    assert A.distinct_words(data, starts, ends, row, 30).tolist() == [len(set(t.split())) for t in texts]


@pytest.mark.parametrize("sf", [SF])
def test_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.execute(A.OP12_SQL).fetchall()}
    assert {tuple(r) for r in A.op12(spark, sf).collect()} == want
