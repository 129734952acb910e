import hashlib
import random

import pytest

from tidemark.llm.suffix_dedup import LoserTree, digests, find_stretches, keyed_texts, remove_repeats, shared_prefix


def brute(texts: list[bytes], n: int) -> list[tuple]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = [word(r.randint(10, 120)) for _ in range(6)]
    texts: list[str | None] = [None, "", "ab" * 100, "x" * 300, "short"]
    for _ in range(60):
        texts.append("".join(r.choice([word(r.randint(1, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :]]) for _ in range(r.randint(1, 5))))
    texts += texts[10:14] + [texts[20], texts[20]]
    return texts


@pytest.mark.parametrize("seed,max_class", [(1, 4096), (2, 4096), (3, 1)])
def test_equals_brute_force(spark, seed, max_class):
    texts = corpus(seed)
    df = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = digests(df, 20, max_class).collect()
    assert all(r.repeats == (r.n_removed > 0) for r in rows)
    got = sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in rows)
    want = sorted((-1 if i == 7 else i, *b) for i, b in enumerate(brute([(t or "").encode() for t in texts], 20)))
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in digests(df).collect()) == [(1, 500), (1, 500), (2, 0)]
    assert digests(df.limit(0)).count() == 0
    kept = remove_repeats(df.selectExpr("*", "length(text) AS n_chars"))
    assert kept.columns == ["doc_id", "text", "n_chars"]
    assert sorted((r.doc_id, r.n_chars) for r in kept.collect()) == [(1, 0), (1, 0), (2, 5)]


def test_loser_tree_merges_without_known_prefixes():
    r = random.Random(3)
    items = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(200)]
    runs = []
    for k in range(7):
        run, before = [], b""
        for x in sorted(items[k::7]):
            run.append((x, shared_prefix(before, x, 0), x))
            before = x
        runs.append(run)
    out = list(LoserTree(runs))
    assert [x for x, _, _ in out] == sorted(items)
    for (x, _, _), (y, same, _) in zip(out, out[1:]):
        assert same == shared_prefix(x, y, 0)


def test_long_texts_in_segments(spark):
    r = random.Random(9)
    word = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = word(200)
    texts = [word(1500) + shared[:130] + word(900) + shared + "x" * 90, word(300) + shared[20:], shared, word(5000)]
    df = keyed_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    whole, parts = ({(x.doc_id, p, x.anchor) for x in find_stretches(df, 40, size).collect() for p in range(x.lo, x.hi + 1)} for size in (1 << 20, 100))
    assert whole == parts


def test_names_that_clash(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(1, text, 1, "a", None), (2, text + "tail", 2, "b", None), (3, None, None, None, None)], "doc_id long, text string, s_th int, spans string, key long")
    got = {r.doc_id: (r.text, r.s_th, r.spans) for r in remove_repeats(df).collect()}
    assert got == {1: ("", 1, "a"), 2: ("tail", 2, "b"), 3: (None, None, None)}
