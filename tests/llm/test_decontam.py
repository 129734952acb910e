import hashlib
import re

import pytest

from tidemark.llm.decontam import contamination, op9, remove_documents


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for p in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        out.append((d, len(w), len(hit), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_equals_brute_force(spark, limit):
    a = " ".join(f"Q{i}" for i in range(25))
    items = [(1, a), (2, "short Item"), (3, None), (4, ""), (10, a[:60]), (5, "solo")]
    docs = [(1, "x " + a.lower() + " y"), (2, None), (3, ""), (4, "a short, ITEM! here"), (5, " ".join(f"q{i}" for i in range(9))), (6, a + " " + a), (7, "é solo Ünder"), (1, "x " + a.lower() + " y"), (8, "short-item short item solo" * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS hash", "3 AS win")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in contamination(d, b, max_broadcast=limit).collect()), key=str)
    assert got == brute(docs, items)
    assert sorted(r.doc_id for r in remove_documents(d, b).collect()) == sorted(x[0] for x in brute(docs, items) if not x[4])
    clash = d.withColumnsRenamed({"words": "text_key", "hash": "h_id"})
    assert remove_documents(clash, b).columns == clash.columns and remove_documents(clash, b).count() == sum(not x[4] for x in brute(docs, items))
    assert contamination(d.limit(0), b).count() == 0
    assert {r.contaminated for r in contamination(d, b.limit(0)).collect()} == {False}


def test_native(spark):
    plan = op9(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in op9(spark, "/root/testdata/sf0.001").collect()}
