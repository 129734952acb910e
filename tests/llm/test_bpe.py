import random
import unicodedata

import numpy as np
import pytest

from tidemark.llm.bpe import Codec, default_vocabulary, digests, encode, load_vocabulary, merge_words

tokenizers = pytest.importorskip("tokenizers")


def differing(texts):
    lib = tokenizers.Tokenizer.from_file(default_vocabulary())
    codec = Codec(load_vocabulary(default_vocabulary()))
    got = [g for lo in range(0, len(texts), 500) for g in codec.encode_batch(texts[lo : lo + 500])]
    return [t for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True) if g != np.array(e.ids, dtype="<u4").tobytes()]


def test_every_code_point_beside_a_letter():
    # the planes from 4 to 13 hold nothing, those from 15 on private characters
    every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x40000), *range(0x50000, 0x110000, 997), *range(0xE0000, 0xE0200)]]
    assert differing([f"a{c}b {c}" for c in every]) == []


def test_special_tokens_in_every_case():
    r = random.Random(4)
    tokens = ["<|endoftext|>", "<|startoftext|>"]
    cased = ["".join(c.upper() if r.random() < 0.5 else c for c in r.choice(tokens)) for _ in range(200)]
    assert differing([*tokens, *cased, *map(str.upper, tokens), *(f"x{a}{r.choice(tokens)} {b}" for a, b in zip(cased, cased[::-1]))]) == []


def test_random_texts():
    r = random.Random(6)
    pools = [list(map(chr, p)) for p in (range(32, 127), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x600), range(0x900, 0x1200), range(0x1E00, 0x2100), [*range(0x2C00, 0xD800)], [*range(0x10000, 0x18000), *range(0x1D000, 0x1FA00)])]
    assert differing(["".join(r.choice(r.choice(pools[: r.randint(1, 8)])) + r.choice(["", "", " "]) for _ in range(r.randint(1, 40))) for _ in range(100_000)]) == []


def texts(n):
    r = random.Random(5)
    parts = ["Hello", "world's", "  ", "<|endoftext|>", "ünïcode", "ΟΔΟΣ", "İ", "ﬁ", "Ǆ", "\x85", " ", "123", "$$!!", "\x1c", "日本", "🙂", "don't", "'LL", "a" * 60, "<|startoftext|>", "<|end", "\n", "é", "Ñandú", "ſ", "K"]
    known = [chr(c) for c in range(1, 0x2FFF) if unicodedata.category(chr(c)) != "Cn"]  # tables of other Unicode versions differ on the rest
    return [None, "", " "] + ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 30))) for _ in range(n)] + ["".join(chr(r.randint(33, 126)) if r.random() < 0.5 else r.choice(known) for _ in range(80)) for _ in range(n)]


def test_equals_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(default_vocabulary())
    codec = Codec(load_vocabulary(default_vocabulary()))
    for t in texts(300):
        want = lib.encode(t or "", add_special_tokens=False).ids
        got = codec.encode_batch([t])[0]
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t)
        assert codec.decode_batch([got])[0].decode() == lib.decode(want, skip_special_tokens=False)


def test_index_merges_as_one_word_at_a_time():
    r = random.Random(2)
    ids = {c: i for i, c in enumerate("abc")}
    merges, names = {}, ["a", "b", "c"]
    for rank in range(40):
        x, y = r.randrange(len(names)), r.randrange(len(names))
        if (x, y) not in merges:
            names.append(names[x] + names[y])
            merges[x, y] = (rank, len(names) - 1)

    def plain(word):
        s = list(word)
        while True:
            found = [(merges[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in merges]
            if not found:
                return s
            i = min(found)[1]
            s[i : i + 2] = [merges[s[i], s[i + 1]][1]]

    words = [[ids[r.choice("abc")] for _ in range(r.randint(1, 20))] for _ in range(300)]
    assert merge_words(words, merges) == [plain(w) for w in words]


def test_frames(spark):
    df = spark.createDataFrame([(1, "The cat", "x"), (None, None, "y"), (1, "The cat", "x")], "doc_id long, text string, ids string")
    out = encode(df)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in out.collect()) == [(0, ""), (1, "the</w> cat</w>"), (1, "the</w> cat</w>")]
    assert sorted(r.n_tokens for r in digests(df).collect()) == [0, 2, 2]
    assert digests(df.limit(0)).count() == 0
