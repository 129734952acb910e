import itertools
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_vocabulary())


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_ids_equal_the_library(library, monkeypatch, block):
    """In small blocks and whole, over white space of all kinds, special tokens and any letters."""
    monkeypatch.setattr(P, "BLOCK_CHARS", block)
    with open(P.default_vocabulary()) as f:
        encode = P.Encoder(f.read())
    rng = random.Random(3)
    some = ["a", "b", "it's", "'", "ll", " ", " ", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "é", "日本", " ", " ", "\x1f", "\x85", "​", "0", "12", "½", "_", "-", ".", "🙂", "́", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(some) if rng.random() < 0.95 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.choice([3, 20, 120])))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(sizes, capacity):
    """The least number of sequences, by trying every way to fill one with the longest piece."""
    if not sizes:
        return 0
    seen = {}

    def best(left):
        if not left:
            return 0
        if left not in seen:
            first, rest = left[0], left[1:]
            room, most = capacity - first, 99
            for k in range(len(rest) + 1):
                for chosen in set(itertools.combinations(range(len(rest)), k)):
                    if sum(rest[i] for i in chosen) <= room:
                        most = min(most, 1 + best(tuple(x for i, x in enumerate(rest) if i not in chosen)))
            seen[left] = most
        return seen[left]

    return best(tuple(sorted(sizes, reverse=True)))


def checked(plan, counts):
    """The plan holds every piece once, without gaps or overlaps, and no sequence over the capacity."""
    held, ranks = {}, {}
    for length, rank, sequence, bins, per, offset in plan.rows:
        ranks.setdefault(length, []).append((rank, rank + bins * per))
        for s in range(sequence, sequence + bins):
            held.setdefault(s, []).extend((offset + i * length, length) for i in range(per))
    for s in held.values():
        ends = 0
        for at, length in sorted(s):
            assert at == ends
            ends += length
        assert ends <= plan.capacity
    assert sorted(held) == list(range(plan.sequences))
    for length, spans in ranks.items():
        at = 0
        for a, b in sorted(spans):
            assert a == at
            at = b
        assert at == counts[length]
    assert set(ranks) == {x for x, n in counts.items() if n}


def test_reduction_loses_nothing():
    """After the reduction the rest still fits into as many sequences as the optimum leaves; the plan is whole."""
    rng = random.Random(2)
    shrunk = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 30])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 4, capacity * 2 // 3) for _ in range(rng.randint(1, 8))]
        counts = {x: sizes.count(x) for x in sizes}
        left = np.zeros(capacity + 1, dtype=np.int64)
        for x, n in counts.items():
            left[x] = n
        plan = P.Plan(capacity, left)
        P.reduce(plan)
        rest = [x for x in range(capacity + 1) for _ in range(int(plan.left[x]))]
        assert plan.fixed + fewest(rest, capacity) == fewest(sizes, capacity), sizes
        shrunk += len(rest) < len(sizes)
        P.best_fit(plan)
        checked(plan, counts)
        assert plan.sequences >= fewest(sizes, capacity)
    assert shrunk > 300


def test_best_fit_in_bulk_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([16, 40])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 60))), reverse=True)
        rooms = []
        for x in sizes:
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - x)
        counts = {x: sizes.count(x) for x in sizes}
        plan = P.Plan(capacity, np.bincount(sizes, minlength=capacity + 1))
        P.best_fit(plan)
        checked(plan, counts)
        assert plan.sequences == len(rooms)


def test_large_counts():
    """A plan's size depends on the lengths, and few sequences beyond the tokens' share are used."""
    rng = np.random.default_rng(1)
    counts = {int(x): int(n) for x, n in enumerate(rng.integers(0, 10**9, 1025)) if x}
    plan = P.plan_of(counts)
    assert len(plan.rows) < 20_000
    total = sum(x * n for x, n in counts.items())
    assert plan.sequences <= 1.01 * -(-total // 1024)


def test_packs_documents(spark, library):
    word = "word "
    docs = [(1, "some text"), (2, None), (2, ""), (None, "x y"), (3, word * 3000), (3, word * 3000), (4, "a" * 50_000), (5, "<|endoftext|> b")] + [(i, word * (i % 90)) for i in range(10, 200)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, piece int, task int, _n long").repartition(5)
    got = P.packed(df).collect()
    want = sorted(str((d, [*library.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in docs)
    whole, held = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 1024
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.piece), []).append((r.start, ids))
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    texts = []
    for (doc, piece), found in whole.items():
        if piece == 0:
            for k, (start, ids) in enumerate(sorted(found)):
                assert start == 0
                more = 1
                while k < len(whole.get((doc, more), ())):
                    at, own = sorted(whole[doc, more])[k]
                    assert at == len(ids) and len(own) == 1024
                    ids = ids + own
                    more += 1
                texts.append(str((doc, ids)))
    assert sorted(texts) == want
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // 1024) + 1
    assert P.packed(df.limit(0)).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.op11(spark, SF).collect()
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        assert zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        n = len(docs[r.doc_id])
        assert r.length == (1024 if r.piece else (n - 1) % 1024 + 1)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 1024) + 1
