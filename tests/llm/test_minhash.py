import math
import random
import re

import pytest

from tidemark.llm.graph import components
from tidemark.llm.minhash import COORDINATES, matches_at, meeting, near_duplicates, one_of_each


def brute(rows, k=5, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    """Chains of edits, of which some link only over others; copies, common passages, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "one two three")]
    base, passage = text(120), text(40)
    for i in range(40):
        now = list(base)
        for _ in range(r.randint(0, 6)):
            now[r.randrange(len(now))] = r.choice(words)
        rows.append((100 + i, " ".join(now)))
    now = text(150)
    for i in range(15):
        now = list(now)
        now[r.randrange(len(now))] = "X" + str(i)
        rows.append((200 + i, " ".join(now)))
    for i in range(30):
        rows.append((300 + i, " ".join(text(r.randint(3, 30)) + passage)))
    rows.append((400, rows[10][1]))
    rows.append((401, rows[10][1].upper()))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,num", [(1, 85), (2, 80)])
def test_equals_brute_force(spark, seed, num):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "'x' AS sig")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, num=num).collect())
    assert got == brute(rows, num=num)
    kept = one_of_each(df, num=num)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in got if k]


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()))
    assert got == [(0, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 200)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90} | {500 + i: 500 for i in range(30)}


def test_meeting_counts_common_elements():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 25)).astype(np.uint64) for _ in range(30)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = meeting(sets)
    np.fill_diagonal(got, 0)
    assert got.astype(int).tolist() == want


def test_asked_matches_miss_one_in_a_million():
    for num in (50, 60, 70, 80, 85, 95):
        m, s = matches_at(num, 100), num / 100
        missed = sum(math.comb(COORDINATES, i) * s**i * (1 - s) ** (COORDINATES - i) for i in range(m))
        assert missed <= 1e-6
    assert matches_at(85, 100) == 27
    with pytest.raises(ValueError):
        matches_at(1, 100)


def test_one_of_each_with_repeated_rows_and_clashing_names(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "a"), (2, text.upper(), "b"), (3, "quite another text that has words", "c"), (3, "and a second text of that id", "d"), (None, text, "e"), (None, text, "e"), (4, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string").selectExpr("*", "1 AS kept", "2 AS count")
    got = one_of_each(df)
    assert got.columns == ["doc_id", "text", "gone", "kept", "count"]
    assert sorted(((r.doc_id or 0, r.gone) for r in got.collect())) == [(0, "e"), (0, "e"), (1, "a"), (3, "c"), (3, "d"), (4, "f")]


def test_a_very_long_text(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:150_000] + ["x"] + words[150_000:])), (3, "short text of a few words here")]
    got = {r_.doc_id: r_.component_id for r_ in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
