import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import pst


def test_base_scores_equal_brute_force(spark):
    texts = {1: "The cat sat on the mat", 2: "the dog\x0bate THE Ünder cat", 3: "", 4: None, 5: "a a a b", 6: "zebra zebra cat", 9: "x\ty", 10: "the", 11: "new words here"}
    df = spark.createDataFrame(list(texts.items()) + [(5, "a a a b")], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS h")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [*texts.items(), (5, "a a a b")]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 9)) for i, t in rows)
    for most in (2_000_000, 3, 0):  # all words broadcast, some, or all joined
        got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in pst.scores(df, most=most).collect())
        assert got == want


def test_distributions_sum_to_one_and_use_the_longest_suffix(spark):
    texts = ["a b c d e f"] * 30 + ["x b c g"] * 20 + ["c d", "b h", "a i j k"]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    words = pst.vocabulary(training)
    total, v = sum(len(t.split()) + 1 for t in texts), 13
    tree = pst.grow(training, words, total, 0.5)
    for before in ("", "a", "b", "b c", "x b c", "a b c d e", "q", "q c"):
        p, context = 0.0, np.array([hash_of(w) for w in before.split()], dtype=np.uint64)
        for word in tree.common:
            h = np.append(context, word)
            number = np.append(np.where(np.isin(h, tree.common), np.searchsorted(tree.common, h), -1), -1)[:-1]
            listed, factor = tree.shares_of(number, np.arange(len(h)))
            p += listed[-1] + factor[-1] * tree.root[number[-1]]
        assert p + factor[-1] * 0.5 * v / total == pytest.approx(1)
    number = np.searchsorted(tree.common, np.array([hash_of(w) for w in ("x", "b", "c", "g")], dtype=np.uint64))
    listed, factor = tree.shares_of(number, np.arange(4))
    assert listed[3] > 0.9  # after "x b c" it is always g; after "b c" mostly d


def hash_of(word: str) -> int:
    return int(pst.hashed_words(np.frombuffer(word.encode(), dtype=np.uint8), np.array([0, len(word)]))[3][0])


def test_empty_table(spark):
    assert pst.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_below_a_thousandth_of_a_percent_count(spark, monkeypatch):
    """A passage that recurs, in a corpus so large that its share of the tokens is under 0.001 %, is expected once it has begun."""
    filler = [(i, " ".join(f"f{(i * 7 + k * k) % 50}" for k in range(2000))) for i in range(200)]
    common = "f1 f2 f3 f4 f5 f6 f7 f8"
    again = "f9 f1 f8 f2 f7 f3 f6 f4 " + "zu zv zw zx zy"
    texts = filler + [(1000, again), (1001, again), (1005, again), (2000, "f9 f1 f8 f2 f7 f3 f6 f4 zy zx zw zv zu"), (3000, common)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert 3 / 300_000 <= 1e-5
    for bucket in (1_000_000, 20_000):  # one bucket, or several of the frequent words
        monkeypatch.setattr(pst, "BUCKET", bucket, raising=False)
        got = {r.doc_id: (r.score, r.base_score) for r in pst.scores(df).collect()}
        assert len(got) == len(texts)
        assert got[1000][0] > got[2000][0] + 5  # the known order is far likelier than the same words turned round


def dict_scores(rows):
    """The tree written out with dicts: score of each (doc_id, text)."""
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    training = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in t)
    n, once, twice = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    after = {}  # context, last word first -> next words
    for t in training:
        for k, w in enumerate(t):
            for length in range(1, min(k, pst.DEPTH) + 1):
                after.setdefault(tuple(t[k - length : k][::-1]), Counter())[w] += 1
    listed = {c: {w: m for w, m in f.items() if m >= 2} for c, f in after.items()}
    left = {c: 1 - (sum(f.values()) - d * len(f)) / sum(after[c].values()) for c, f in listed.items()}

    def share(c, w):  # of the root's part: nothing
        return ((listed[c][w] - d) / sum(after[c].values()) if w in listed[c] else 0) + left[c] * share(c[:-1], w) if c else 0.0

    def state(c):
        if not listed.get(c):
            return False
        if len(c) == 1:
            return True
        q, r = ([share(x, w) for w in listed[c]] for x in (c, c[:-1]))
        rest, other = max(1 - sum(q), 1e-12), max(1 - sum(r), 1e-12)
        return sum(a * math.log(a / b) for a, b in zip(q, r, strict=True)) + rest * math.log(rest / other) >= pst.DIVERGENCE

    states = {c for c in after if state(c)}
    out = []
    for _, text in rows:
        t, total = tokens(text), 0.0
        for k, w in enumerate(t):
            c = next((c for c in (tuple(t[k - x : k][::-1]) for x in range(min(k, pst.DEPTH), 0, -1)) if c in states), ())
            root = (counts[w] - d) / n if counts[w] else d * len(counts) / n
            total += math.log10(share(c, w) + math.prod(left[c[:x]] for x in range(1, len(c) + 1)) * root)
        out.append(total)
    return out


def test_scores_equal_a_tree_of_dicts(spark, monkeypatch):
    """Texts with null and repeated ids, null, empty and repeated texts; contexts of all lengths are hot in the small buckets."""
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(420)]
    rows += [(1000 + i, "it is the case that it is the case that it is so " * r.randint(1, 9)) for i in range(70)] + [(3, None), (4, ""), (None, "it is so"), (None, "w1 w2"), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ctx", "2 AS bucket")
    order = lambda pairs: sorted((-1 if i is None else i, x) for i, x in pairs)
    want = order(zip([i for i, _ in rows], dict_scores(rows), strict=True))
    for bucket, most in ((400_000, 2_000_000), (300, 2_000_000), (300, 0), (2_000, 40)):
        monkeypatch.setattr(pst, "BUCKET", bucket)
        got = order((x.doc_id, x.score) for x in pst.scores(df, most=most).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9, abs=1e-9)


def test_very_long_text(spark):
    long = " ".join(f"f{k * k % 1009}" for k in range(400_000))
    got = {x.doc_id: x for x in pst.scores(spark.createDataFrame([(1, long), (2, "f1 f4"), (5, "f1 f4")], "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 400_001 and got[1].score > got[1].base_score and got[2].score > got[2].base_score


def test_scores_do_not_depend_on_the_bucket_or_the_broadcast(spark, monkeypatch):
    """One model on the test documents, however many buckets it is grown in and however many words are broadcast."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for bucket, most in ((400_000, 2_000_000), (4_000, 2_000_000), (4_000, 500), (400_000, 0)):
        monkeypatch.setattr(pst, "BUCKET", bucket)
        found.append({r.doc_id: r.score for r in pst.scores(df, most=most).collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(abs(other[i] - x) < 1e-9 * max(1, abs(x)) for i, x in found[0].items())


def test_what_is_shuffled_goes_and_tokens_are_dealt_in_slices(spark, monkeypatch, tmp_path):
    """F1: the slices are worked off one after the other, each with a part of the tokens, and leave no shuffle files; the scores stay."""
    r = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(f"w{int(r.paretovariate(0.8))}" for _ in range(r.randint(0, 80)))) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(pst, "BUCKET", 500)
    tables, made = [], pst.materialise
    monkeypatch.setattr(pst, "materialise", lambda frame, name: (tables.append(name), made(frame, name))[1])
    found = []
    for slices in (1, 3):
        monkeypatch.setattr(pst, "SLICES", slices)
        tables.clear()
        found.append({x.doc_id: x.score for x in pst.scores(df).collect()})
        assert tables.count("scored") == slices
    assert found[1] == pytest.approx(found[0], rel=1e-9)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    root = f"{tmp_path}/counts"
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    with pst.shuffles_removed(spark):
        files = shuffle_files(store)
        df.groupBy("doc_id").count().write.parquet(root)
        for _ in range(100):  # executors delete in their own time
            if not (left := shuffle_files(store) - files):
                break
            time.sleep(0.1)
    assert not left
    assert spark.conf.get(name) == before


def shuffle_files(store):
    names = [f.getName() for f in map(store.getAllFiles().apply, range(store.getAllFiles().size()))]
    return {x for x in names if x.startswith("shuffle_")}


def test_tokens_of_a_hot_context_stay_together():
    """a hot context's tokens go to as many buckets as they fill, not to all, so that what buckets ask for grows with the tokens."""
    hot = pst.Hot()
    hot.add(np.array([5, 9], dtype=np.uint64), np.array([-1, -1]), 1, np.array([1000, 260]))
    hot.add(np.array([7], dtype=np.uint64), np.array([0]), 2, np.array([700]))
    begin, many = hot.buckets(2000, 100)
    assert many.tolist() == [3, 3, 7, 8]
    assert begin.tolist() == [0, 3, 6, 13]


def test_index_and_groups_equal_numpy():
    r = np.random.default_rng(4)
    keys = np.unique(np.append(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), [np.uint64(0), np.uint64((1 << 64) - 1)]))
    asked = np.concatenate([keys[::3], r.integers(0, 1 << 63, 5000).astype(np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]])
    for known in (keys, keys[:1], keys[:0], keys[-40:]):
        at, there = pst.Index(known).find(asked)
        assert (there == np.isin(asked, known)).all() and (known[at[there]] == asked[there]).all()
    for span in (40, 1 << 62):
        key = r.integers(0, span, 3000)
        own, n, pick = pst.groups(key, span)
        values, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        assert n == len(values) and (own == inverse).all() and (pick == first).all()
    assert pst.groups(np.zeros(0, dtype=np.int64), 1)[1] == 0
