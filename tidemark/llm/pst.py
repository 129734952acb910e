"""Language-model scores from a probabilistic suffix tree over words, with add-one word scores beside them.

A text is a sequence of words and one end. Contexts are the last 0 to DEPTH words of the text. A context lists the next
words that follow it at least LEAST times in the training texts, a count that doesn't depend on the size of the corpus, so
the tree grows with it. Distributions are smoothed by absolute discounting: listed words have their discounted share, and
what is left goes to the distribution of the parent (the context without its first word). A context that lists words is a
state if it is one word, or if its shares diverge from its parent's by DIVERGENCE nats or more; the test takes both before
the root's part is added, which is one symbol of it with all else that isn't listed. The root has the discounted counts of
all training words, and the discounts' sum is the probability of an unknown word, one symbol as in the add-one score.
Scoring takes the longest suffix of what stands before a word that is a state. All probabilities after a context sum to one.

The tree is never in one place. Every token goes with the DEPTH words before it to a bucket, where all contexts that end
with the same words are counted, tested and read. A context of more than half a BUCKET of tokens is hot: its next words
are counted as rows, with a combiner before the shuffle, and joined to the buckets that ask for them; its tokens are dealt
by the longer contexts. So the tree is the same for any BUCKET and for any number of words broadcast.

Texts are read and their words looked up once; what is kept of them are their words' numbers. The buckets are worked off
in SLICES, one after the other, and each one's shuffle files go before the next begins, so the disk holds a part of the
tokens with their contexts at a time. Every bucket is in one slice, so the result doesn't depend on their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import CHUNK_BYTES, lower_ascii, materialise, mix, prefix_hash, release, require, span_hash, text_chunks, word_spans

#: Longest context in words.
DEPTH = 4
#: Times that a context must be followed by a word to list it; nats between a context and its parent.
LEAST, DIVERGENCE = 2, 0.01
#: Tokens that a bucket has about at most; contexts of more than half of a bucket's are hot. Small corpora have up to SPREAD buckets of FEWEST tokens and more.
BUCKET, SPREAD, FEWEST = 700_000, 160, 140_000
#: Parts of the buckets whose tokens are on disk one after the other.
SLICES = 2
#: Codes of the end, of the place before a text's first word or of a word that no context can list, and the bit of words that aren't broadcast.
END_CODE, NONE, FAR = 1 << 61, (1 << 61) + 1, 1 << 63
#: Most words that are broadcast with their counts, the most frequent ones; the others' counts are joined.
BROADCAST = 2_000_000
END = 10
#: Words whose counts a task keeps before it hands them on.
KEPT = 600_000
CHUNK = 4 << 20


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, hashes, and each text's first word."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    h = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(low), CHUNK_BYTES)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = starts[i]
        h[i:j] = span_hash(prefix_hash(low[at : ends[j - 1]]), starts[i:j] - at, ends[i:j] - at)
    return low, starts, ends, h, first


def end_hash() -> int:
    """The hash that stands for the end; the line feed that it is made of is in no word."""
    one = np.array([END], dtype=np.uint8)
    return int(span_hash(prefix_hash(one), np.array([0]), np.array([1]))[0])


def vocabulary(training: DataFrame) -> DataFrame:
    """h (64-bit hash) and c (count) of every token of the training texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        texts = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = joined()
            held.clear()
            for lo in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 200_000].astype(np.int64)), pa.array(n[lo : lo + 200_000])], ["h", "c"])

        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, limit=CHUNK):
                texts += hi - lo
                held.append(np.unique(hashed_words(data, offsets)[3], return_counts=True))
                if len(held) > 8:
                    held[:] = [joined()]
                    if len(held[0][0]) > KEPT:
                        yield from flush()
        if texts:
            held.append((np.array([end_hash()], dtype=np.uint64), np.array([texts])))
            yield from flush()

    return training.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Index:
    """Sorted 64-bit hashes with where those of each leading bits begin, which finds a hash in a few steps instead of a search through all."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, len(keys).bit_length())
        self.begin = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``: where each key is, and whether it is there."""
        if not len(self.keys):
            return find(self.keys, keys)
        last = len(self.keys) - 1
        at = np.minimum(self.begin[keys >> np.uint64(64 - self.bits)], last)
        got = self.keys[at]
        behind = np.flatnonzero(got < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.keys[at[behind]] < keys[behind]]
        at = np.minimum(at, last)
        return at, self.keys[at] == keys


def coded(h: np.ndarray, first: np.ndarray, known: np.ndarray | Index, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each token, its place in its text, and its text.

    The code is the number of a ``known`` hash (its place, if ``number`` isn't given), the hash with FAR set, or END_CODE.
    """
    docs = len(first) - 1
    size = np.diff(first) + 1
    codes = np.full(len(h) + docs, np.uint64(END_CODE))
    at, there = known.find(h) if isinstance(known, Index) else find(known, h)
    if number is not None and len(number):
        at = number[at]
    codes[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(first))] = np.where(there, at.astype(np.uint64), h | np.uint64(FAR))
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(docs), size)


def befores(codes: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Codes of the words 1 to DEPTH before each token; before a word that no context can list there is none either."""
    out = []
    for d in range(1, DEPTH + 1):
        w = np.full(len(codes), np.uint64(NONE))
        w[d:] = np.where(place[d:] >= d, codes[:-d], np.uint64(NONE))
        if out:
            w[out[-1] == np.uint64(NONE)] = NONE
        out.append(w)
    return out


def context_key(shorter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a context that has one more word before a shorter one (0 for the empty context)."""
    return mix(shorter * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(1)))


def pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a hot context's number and a next word."""
    return mix(mix(word + np.uint64(3)) + ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Hot:
    """The hot contexts: sorted keys and their numbers; by number, the parent's number (-1: root), the length and the tokens about."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.parent, self.depth, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, parent: np.ndarray, depth: int, n: np.ndarray) -> None:
        numbers = np.append(self.numbers, len(self.parent) + np.arange(len(keys)))
        every = np.append(self.keys, keys)
        order = np.argsort(every)
        self.keys, self.numbers = every[order], numbers[order]
        self.parent, self.depth = np.append(self.parent, parent), np.append(self.depth, np.full(len(keys), depth))
        self.n = np.append(self.n, n)

    def buckets(self, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """By number, the first bucket and how many buckets the tokens have whose longest hot context it is; in the last place, those of the other tokens.

        A hot context's tokens stay together in few buckets, so that a bucket asks for few different next words of it.
        """
        own = self.n.copy()
        some = self.parent >= 0
        np.subtract.at(own, self.parent[some], self.n[some])
        own = np.maximum(own, 1)
        many = np.maximum(1, -(-np.append(own, max(total - int(own.sum()), 1)) // size))
        return np.cumsum(many) - many, many

    def longest(self, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: length and number of its longest hot context (0 and -1: none), and the key of the context one word longer (0: there is none)."""
        n = len(before[0])
        depth, ctx, longer = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.uint64)
        i, key = np.arange(n), np.zeros(n, dtype=np.uint64)
        for d in range(1, DEPTH + 1):
            w = before[d - 1][i]
            i, key, w = i[w != np.uint64(NONE)], key[w != np.uint64(NONE)], w[w != np.uint64(NONE)]
            key = context_key(key, w)
            at, there = find(self.keys, key)
            longer[i] = np.where(there, np.uint64(0), key)
            i, key, at = i[there], key[there], at[there]
            depth[i], ctx[i] = d, self.numbers[at]
        return depth, ctx, longer

    def lines(self) -> pa.Table:
        """Each hot context (deep) with itself and its hot suffixes (ctx)."""
        deep, ctx = [np.arange(len(self.parent))], [np.arange(len(self.parent))]
        while (ctx[-1] >= 0).any():
            up = self.parent[ctx[-1]]
            deep.append(deep[-1][up >= 0])
            ctx.append(up[up >= 0])
            if not len(ctx[-1]):
                break
        return pa.table({"deep": np.concatenate(deep), "ctx": np.concatenate(ctx)})


def groups(key: np.ndarray, span: int) -> tuple[np.ndarray, int, np.ndarray]:
    """For each key (whole, under ``span``) the place of its value among the sorted ones, how many they are, and where each is first."""
    n = len(key)
    shift = max(1, n.bit_length())
    if span.bit_length() + shift <= 64:  # key and place in one word, which sorts faster than places by their keys
        both = (key.astype(np.uint64) << np.uint64(shift)) | np.arange(n, dtype=np.uint64)
        both.sort()
        order, values = (both & np.uint64((1 << shift) - 1)).astype(np.int64), both >> np.uint64(shift)
        del both
    else:
        order = np.argsort(key, kind="stable")
        values = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = values[1:] != values[:-1]
    own = np.empty(n, dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    return own, int(new.sum()), order[new]


def numbered(columns: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The columns' codes as small numbers, equal ones for equal codes (1: none), and a number above them all."""
    far = np.unique(np.concatenate([c[c >= np.uint64(FAR)] for c in columns]))
    top = 3 + max(int(c[c < np.uint64(END_CODE)].max(initial=0)) for c in columns)
    out = []
    for c in columns:
        w = (c & np.uint64(0x3FFFFFFF)).astype(np.int32) + np.int32(2)
        w[c == np.uint64(END_CODE)], w[c == np.uint64(NONE)] = 0, 1
        i = np.flatnonzero(c >= np.uint64(FAR))
        w[i] = top + np.searchsorted(far, c[i])
        out.append(w)
    return out, top + len(far)


def shares(words: list[np.ndarray], base: int, train: np.ndarray, discount: float, hot: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each token: its listed share after its longest state, and the factor of its root share.

    words, base: ``numbered`` codes of the tokens and of the words before them. The tokens are all those after the contexts that end with the same words; those of ``train`` are learned from.
    hot: for each token, length and number of its longest hot context, its listed share and factor there, and those of the longest state up to there, which are written over.
    """
    x, *w = words
    n_ = len(x)
    length, ctx, listed, factor, out, rest_ = hot or (np.zeros(n_, dtype=np.int64), np.full(n_, -1), np.zeros(n_), np.ones(n_), np.zeros(n_), np.ones(n_))
    above = int(ctx.max()) + 2 if n_ else 1  # numbers of hot contexts and the root come before those of this place
    ctx = ctx.astype(np.int64) + 1
    active = np.zeros(0, dtype=np.int64)
    for d in range(1, DEPTH + 1):
        active = np.concatenate([active, np.flatnonzero(length == d - 1)])
        active = active[w[d - 1][active] != 1]  # none
        own, kinds, _ = groups(ctx[active] * base + w[d - 1][active], (int(ctx.max(initial=0)) + 1) * base)
        seen = np.bincount(own, train[active], kinds)
        fine = seen >= LEAST
        new = np.cumsum(fine) - 1
        active, own = active[fine[own]], new[own[fine[own]]]
        seen = seen[fine]
        gram, _, pick = groups(own * base + x[active], (len(seen) + 1) * base)
        n = np.bincount(gram, train[active], len(pick))
        holder, some = own[pick], n >= LEAST
        p = np.where(some, (n - discount) / np.maximum(seen[holder], 1), 0.0)
        kinds = np.bincount(holder, some, len(seen))
        left = 1 - (np.bincount(holder, n * some, len(seen)) - discount * kinds) / np.maximum(seen, 1)
        below = listed[active]
        here = p[gram] + left[own] * below
        keep = kinds > 0
        if d > 1:
            q, r, of = here[pick][some], below[pick][some], holder[some]
            rest, other = (np.maximum(1 - np.bincount(of, v, len(seen)), 1e-12) for v in (q, r))
            keep &= np.bincount(of, q * np.log(q / r), len(seen)) + rest * np.log(rest / other) >= DIVERGENCE
        listed[active], factor[active] = here, left[own] * factor[active]
        of = active[keep[own]]
        out[of], rest_[of] = listed[of], factor[of]
        ctx[active] = above + own
    return out, rest_


class Tree:
    """The tree of few texts in one place, read by the same ``shares``. common: sorted hashes of all words; counts: theirs."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, total: float, discount: float, codes: np.ndarray, place: np.ndarray):
        self.common, self.discount, self.codes, self.place = common, discount, codes, place
        self.root = (counts - discount) / max(total, 1)

    def shares_of(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token (number among ``common``, -1 for others): its listed share after its longest state, and the factor of its root share."""
        k = len(number)
        codes = np.where(number >= 0, number, FAR).astype(np.uint64)
        both = [np.concatenate(c) for c in zip(befores(self.codes, self.place), befores(codes, place), strict=True)]
        every = np.concatenate([self.codes, codes])
        listed, factor = shares(*numbered([every, *both]), np.arange(len(every)) < len(self.codes), self.discount)
        return listed[-k:], factor[-k:]


def grow(training: DataFrame, words: DataFrame, total: int, discount: float) -> Tree:
    """The tree of training texts that are few enough for one place."""
    got = words.select("h", "c").toArrow()
    h = got.column("h").to_numpy().astype(np.uint64)
    order = np.argsort(h)
    common, counts = h[order], got.column("c").to_numpy()[order]
    parts = [(coded(own, first, common)) for b in training.select("text").toArrow().to_batches() for _, _, data, offsets in text_chunks(b) for _, _, _, own, first in [hashed_words(data, offsets)]]
    codes, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    at, there = find(common, np.array([end_hash()], dtype=np.uint64))
    codes[codes == np.uint64(END_CODE)] = at[0] if there[0] else END_CODE
    return Tree(common, counts, total, discount, codes, place)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes, all second bytes and so on, for the compressor."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplaned(data: memoryview, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    """The array of n values whose ``planes`` begin at ``at``, and where they end."""
    size = np.dtype(kind).itemsize
    own = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
    return np.ascontiguousarray(own.T).reshape(-1).view(kind), at + n * size


def packed(arrays: list[np.ndarray]) -> tuple[int, bytes]:
    """Arrays as one compressed string, and its size before."""
    raw = np.array([len(a) for a in arrays], dtype=np.int64).tobytes() + b"".join(planes(a) for a in arrays)
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(size: int, blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    raw = memoryview(pa.Codec("zstd").decompress(blob, decompressed_size=size, asbytes=True))
    lengths, at, out = np.frombuffer(raw, dtype=np.int64, count=len(kinds)), len(kinds) * 8, []
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        a, at = unplaned(raw, at, n, kind)
        out.append(a)
    return out


#: Arrays of what a text chunk asks a bucket (numbers, text, learned from, hashes of words that aren't broadcast), and of the answer.
ASKED = [np.int32] * (DEPTH + 1) + [np.int32, np.uint8, np.uint64]
TOLD = [np.int32, np.float64, np.int32, np.uint64, np.float64, np.float64]
#: Arrays of a text chunk: tokens of each text, whether it is learned from, the tokens' codes, hashes of words that aren't broadcast.
CODED = [np.int32, np.uint8, np.int32, np.uint64]


def shrunk(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in 32 bits, and the hashes of words that aren't broadcast."""
    far = (codes & np.uint64(FAR)) != 0
    small = (codes & np.uint64(0x3FFFFFFF)).astype(np.int32)
    small[codes == np.uint64(END_CODE)], small[codes == np.uint64(NONE)], small[far] = -1, -2, -3
    return small, codes[far]


def grown(small: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The codes of ``shrunk``."""
    codes = small.astype(np.int64).astype(np.uint64)
    codes[small == -1], codes[small == -2], codes[small == -3] = np.uint64(END_CODE), np.uint64(NONE), far
    return codes


def asked(columns: list[np.ndarray], doc: np.ndarray, train: np.ndarray) -> tuple[int, bytes]:
    """What a chunk asks a bucket: the tokens' codes and those of the words before them."""
    small, hashes = zip(*(shrunk(c) for c in columns), strict=True)
    return packed([*small, np.diff(doc, prepend=0).astype(np.int32), train.astype(np.uint8), np.concatenate(hashes)])


def read_asked(size: int, blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of codes, texts and whether they are learned from."""
    *small, doc, train, far = unpacked(size, blob, ASKED)
    columns, at = [], 0
    for c in small:
        k = int((c == -3).sum())
        columns.append(grown(c, far[at : at + k]))
        at += k
    return columns, np.cumsum(doc), train.astype(bool)


def least_count(words: DataFrame, most: int) -> int:
    """The smallest count of a grid that at most ``most`` words reach; words that no context can list aren't broadcast."""
    grid = sorted({max(LEAST, int(1.25**k)) for k in range(150)})
    reach = words.agg(*(F.count_if(F.col("c") >= t) for t in grid)).first()
    return next((t for t, n in zip(grid, reach, strict=True) if n <= most), grid[-1])


def hot_contexts(coded_texts: DataFrame, first: np.ndarray, counts: np.ndarray, half: int, far_listed: bool) -> Hot:
    """The contexts that more than ``half`` tokens stand after, those of one word given: fewer than tokens / half of each length."""
    hot = Hot()
    hot.add(context_key(np.zeros(len(first), dtype=np.uint64), first), np.full(len(first), -1), 1, counts)
    for d in range(2, DEPTH + 1):
        if not (hot.depth == d - 1).any():
            break
        shared = coded_texts.sparkSession.sparkContext.broadcast(hot)

        def run(batches: Iterator[pa.RecordBatch], d=d, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, far_listed):
                    depth, ctx, longer = shared.value.longest(part.before)
                    i = np.flatnonzero((depth == d - 1) & (longer != 0))
                    keys, pick, n = np.unique(longer[i], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(ctx[i][pick]), pa.array(n)], ["key", "parent", "n"])

        got = coded_texts.mapInArrow(run, "key long, parent long, n long").groupBy("key", "parent").agg(F.sum("n").alias("n")).where(F.col("n") > half).orderBy("key").toArrow()
        hot.add(got.column("key").to_numpy().astype(np.uint64), got.column("parent").to_numpy(), d, got.column("n").to_numpy())
    return hot


def hot_shares(spark: SparkSession, needs: DataFrame, hot: Hot, discount: float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """For the hot contexts: rows (bucket, ctx, x, listed, state_listed) for all that is asked, and by number the root's factor, there and at the longest state up to there.

    needs: bucket, deep (number of a token's longest hot context), x (its code) and n (training tokens).
    """
    grams = materialise(needs.groupBy("deep", "x").agg(F.sum("n").alias("n")).join(spark.createDataFrame(hot.lines()), "deep").groupBy("ctx", "x").agg(F.sum("n").alias("n")), "grams")
    some = F.col("n") >= LEAST
    got = grams.groupBy("ctx").agg(F.sum("n").alias("seen"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("sum"), F.count_if(some).alias("kinds")).toArrow()  # a row a hot context
    at = got.column("ctx").to_numpy()
    seen, total, kinds = (np.zeros(len(hot.parent), dtype=np.int64) for _ in range(3))
    seen[at], total[at], kinds[at] = (got.column(c).to_numpy() for c in ("seen", "sum", "kinds"))
    left = 1 - (total - discount * kinds) / np.maximum(seen, 1)
    facts = spark.createDataFrame(pa.table({"ctx": np.arange(len(left)), "parent": hot.parent, "depth": hot.depth, "seen": np.maximum(seen, 1), "left": left}))
    factor, state_factor = left.copy(), np.where(kinds > 0, left, 1.0)
    levels = []
    for d in range(1, int(hot.depth.max()) + 1):
        own = grams.join(facts.where(F.col("depth") == d), "ctx")
        p = F.when(some, (F.col("n") - discount) / F.col("seen")).otherwise(0.0)
        if d == 1:
            levels.append(own.select("ctx", "x", p.alias("listed"), p.alias("state_listed")))
            continue
        below = levels[-1].select(F.col("ctx").alias("parent"), "x", F.col("listed").alias("below"), F.col("state_listed").alias("state_below"))
        here = own.join(below, ["parent", "x"]).select("ctx", "x", "n", (p + F.col("left") * F.col("below")).alias("listed"), "below", "state_below")
        got = here.where(some).groupBy("ctx").agg(F.sum(F.col("listed") * F.log(F.col("listed") / F.col("below"))).alias("a"), F.sum("listed").alias("q"), F.sum("below").alias("r")).toArrow()
        at = got.column("ctx").to_numpy()
        rest, other = (np.maximum(1 - got.column(c).to_numpy(), 1e-12) for c in ("q", "r"))
        keep = np.zeros(len(left), dtype=bool)
        keep[at] = got.column("a").to_numpy() + rest * np.log(rest / other) >= DIVERGENCE
        mine = np.flatnonzero(hot.depth == d)
        factor[mine] *= factor[hot.parent[mine]]
        state_factor[mine] = np.where(keep[mine], factor[mine], state_factor[hot.parent[mine]])
        kept = spark.createDataFrame(pa.table({"ctx": mine, "keep": keep[mine]}))
        levels.append(here.join(kept, "ctx").select("ctx", "x", "listed", F.when(F.col("keep"), F.col("listed")).otherwise(F.col("state_below")).alias("state_listed")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    known = materialise(needs.join(every.withColumnRenamed("ctx", "deep"), ["deep", "x"]).select("bucket", F.col("deep").alias("ctx"), "x", "listed", "state_listed"), "hot-shares")
    release(grams)
    return known, factor, state_factor


class Tokens:
    """The tokens of a text chunk, with the codes of the words before each."""

    def __init__(self, chunk: int, size: int, blob: bytes, far_listed: bool):
        self.chunk = chunk
        n, train, small, far = unpacked(size, blob, CODED)
        self.train, self.codes = train.astype(bool), grown(small, far)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(n) - n, n)
        context = self.codes if far_listed else np.where((self.codes & np.uint64(FAR)) != 0, np.uint64(NONE), self.codes)
        self.before = befores(context, self.place)


def chunks(batch: pa.RecordBatch, far_listed: bool) -> Iterator[Tokens]:
    """The text chunks of a batch (chunk, size, blob)."""
    for chunk, size, blob in zip(batch.column("chunk").to_pylist(), batch.column("size").to_pylist(), batch.column("blob"), strict=True):
        yield Tokens(chunk, size, blob.as_py(), far_listed)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what an action has shuffled is deleted when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scores(documents: DataFrame, fold: int = 7, left_out: int = 2, most: int = BROADCAST) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``most``: words that are broadcast at most, which changes the plan, not the result. 64-bit hashes stand for words and contexts. Learns from the whole texts whose crc32(doc_id as text) mod ``fold`` is not ``left_out``; rows with a null doc_id are
    not held out and are learned from. Null and empty texts are one end. Without training texts every token is unknown,
    with probability one. Repeated rows are texts of their own. Other columns are ignored.
    """
    require(documents, "doc_id", "text")
    with shuffles_removed(documents.sparkSession):
        texts, parts, tail, facts = scored_parts(documents, fold, left_out, most)
    n, log_all, discount, unknown = facts
    # a word's hash is told apart by its lower 63 bits
    far = parts.where("h is not null").join(tail, F.col("h") == F.col("w_h"), "left")
    count = F.coalesce("c", F.lit(0))
    root = F.when(count > 0, (count - F.lit(discount)) / F.lit(float(max(n, 1)))).otherwise(F.lit(float(unknown)))
    far = far.select("row", F.when(count > 0, 1).otherwise(0).cast("long").alias("n_known"), (F.log10(count + 1) - F.lit(log_all)).alias("base_score"), F.log10(F.col("listed") + F.col("factor") * root).alias("score"))
    both = texts.unionByName(parts.where("h is null").select("row", "score"), True).unionByName(far, True)
    out = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.coalesce(F.sum("n_known"), F.lit(0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.drop("row")


#: Of each text, what is known without the tree; of the tokens, what the tree gave: sums (no h) and words whose counts are joined.
TEXT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
PART = "row long, h long, score double, listed double, factor double"


def scored_parts(documents: DataFrame, fold: int, left_out: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Written tables of ``TEXT`` and ``PART``, the counts (c) of the hashes (w_h) to join, and the numbers that shares take: tokens, log of all, discount, unknown."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == left_out, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    training = rows.where("not held_out")
    words = materialise(vocabulary(training), "vocabulary")
    n, v, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    unknown = discount * v / n if n else 1.0
    end = words.where(F.col("h") == int(np.uint64(end_hash()).astype(np.int64))).select("c").first()
    end_count = end[0] if end else 0
    least = least_count(words, most)
    head = words.where(F.col("c") >= least).select("h", "c").toArrow()  # at most ``most`` rows
    head_h, head_c = head.column("h").to_numpy().astype(np.uint64), head.column("c").to_numpy()
    order = np.argsort(head_h)
    head_h, head_c = head_h[order], head_c[order]
    order = np.argsort(-head_c, kind="stable")  # frequent words have small numbers, which take fewer bytes
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    head_c = head_c[order]  # by number
    end_number = number[find(head_h, np.array([end_hash()], dtype=np.uint64))[0]] if end_count >= least else None
    bucket_size = min(BUCKET, max(-(-n // SPREAD), FEWEST))
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((Index(head_h), number, head_c))
    log_all = math.log10(n + v + 1)
    far_listed = least > LEAST

    def root_share(c):
        return np.where(c > 0, (c - discount) / max(n, 1), unknown)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, numbers, counts = shared.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, limit=CHUNK):
                h, first = hashed_words(data, offsets)[3:]
                codes, place, doc = coded(h, first, index, numbers)
                docs = hi - lo
                held = batch.column("held_out").slice(lo, docs)
                end, far = codes == np.uint64(END_CODE), (codes & np.uint64(FAR)) != 0
                c = np.full(len(codes), end_count, dtype=np.int64)
                c[~end & ~far] = counts[codes[~end & ~far].astype(np.int64)]
                base = np.where(far, 0.0, np.log10(c + 1) - log_all)
                start = place == 0
                home = pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(docs)), batch.column("doc_id").slice(lo, docs), held, pa.array(np.diff(first) + 1), pa.array(np.bincount(doc, ~far & (c > 0), docs).astype(np.int64)), pa.array(np.bincount(doc, base, docs)), pa.array(np.where(far[start], 0.0, np.log10(root_share(c[start])))), pa.array(np.where(far[start], codes[start], 0).view(np.int64))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, home.schema) as out:
                    out.write_batch(home)
                train = ~held.to_numpy(zero_copy_only=False).astype(bool)
                small, hashes = shrunk(codes)
                size, blob = packed([(np.diff(first) + 1).astype(np.int32), train.astype(np.uint8), small, hashes])
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([size]), pa.array([blob], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "size", "blob", "home"])
                row += docs

    kept = materialise(rows.mapInArrow(code, "chunk long, size long, blob binary, home binary"), "coded")
    coded_texts = kept.select("chunk", "size", "blob")

    def dealt(part: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each token, and length and number of its longest hot context: by its shortest context that isn't hot, or where there is none by its text."""
        depth, ctx, longer = tree.value.longest(part.before)
        begin, many = places
        by = mix(np.where(longer != 0, longer, mix(part.doc.astype(np.uint64) + np.uint64(part.chunk))))
        return begin[ctx] + (by % many[ctx].astype(np.uint64)).astype(np.int64), depth, ctx

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, far_listed):
                bucket, depth, ctx = dealt(part)
                i = np.flatnonzero(depth > 0)
                bucket = bucket[i]
                _, pick, own = np.unique(pair_key(ctx[i], part.codes[i]) + mix(bucket.astype(np.uint64)), return_index=True, return_inverse=True)
                n_train = np.bincount(own, part.train[part.doc[i]], len(pick)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[pick]), pa.array(ctx[i][pick]), pa.array(part.codes[i][pick].astype(np.int64)), pa.array(n_train)], ["bucket", "deep", "x", "n"])

    over = words.where((F.col("c") > bucket_size // 2) & (F.col("h") != int(np.uint64(end_hash()).astype(np.int64)))).select("h", "c").orderBy("h").toArrow()  # fewer than 2 * n / bucket_size
    over_h, over_c = over.column("h").to_numpy().astype(np.uint64), over.column("c").to_numpy()
    at, there = find(head_h, over_h)
    hot = hot_contexts(coded_texts, np.where(there, number[at].astype(np.uint64), over_h | np.uint64(FAR)) if len(head_h) else over_h | np.uint64(FAR), over_c, bucket_size // 2, far_listed)
    places = hot.buckets(n, bucket_size)
    tree = spark.sparkContext.broadcast(hot)
    if len(hot.parent):
        needs = materialise(coded_texts.mapInArrow(need, "bucket long, deep long, x long, n long").groupBy("bucket", "deep", "x").agg(F.sum("n").alias("n")), "needs")
        known, factor, state_factor = hot_shares(spark, needs, hot, discount)
        release(needs)
    else:
        known, factor, state_factor = spark.createDataFrame([], "bucket long, ctx long, x long, listed double, state_listed double"), np.zeros(0), np.zeros(0)
    factors = spark.sparkContext.broadcast((factor, state_factor))
    def ask(part_of: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, far_listed):
                    bucket = dealt(part)[0]
                    rest = np.flatnonzero((bucket % slices == part_of) & (part.place > 0))
                    rest = rest[np.argsort(bucket[rest].astype(np.int32), kind="stable")]
                    bucket = bucket[rest]
                    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(rest))
                    lines = []
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        i = rest[a:b]
                        lines.append((int(bucket[a]), *asked([part.codes[i], *(w[i] for w in part.before)], part.doc[i], part.train[part.doc[i]])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in lines], pa.int64()), pa.array(np.full(len(lines), part.chunk)), pa.array([x[1] for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.binary())],
                        ["bucket", "chunk", "size", "blob"],
                    )

        return run

    def tell(group: pa.Table, hot_rows: pa.Table) -> pa.Table:
        counts = shared.value[2]
        if not group.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        out = group.select(["chunk", "size", "blob"])
        chunks, parts = out.column("chunk").to_pylist(), [read_asked(z, b) for z, b in zip(out.column("size").to_pylist(), out.column("blob").to_pylist(), strict=True)]
        columns = [np.concatenate([p[0][i] for p in parts]) for i in range(DEPTH + 1)]
        docs, train = [p[1].astype(np.int32) for p in parts], np.concatenate([p[2] for p in parts])
        del parts, group, out
        code = columns[0]
        end, far = code == np.uint64(END_CODE), (code & np.uint64(FAR)) != 0
        c = np.full(len(code), end_count, dtype=np.int64)
        c[~end & ~far] = counts[code[~end & ~far].astype(np.int64)]
        depth, ctx, _ = tree.value.longest(columns[1:])
        listed, state_listed, factor, state_factor = np.zeros(len(code)), np.zeros(len(code)), np.ones(len(code)), np.ones(len(code))
        i = np.flatnonzero(depth > 0)
        if len(i):
            keys = pair_key(hot_rows.column("ctx").to_numpy(), hot_rows.column("x").to_numpy().astype(np.uint64))
            order = np.argsort(keys)
            at, there = find(keys[order], pair_key(ctx[i], code[i]))
            if not there.all():
                raise ValueError("shares of a hot context are missing")
            at = order[at]
            listed[i], state_listed[i] = hot_rows.column("listed").to_numpy()[at], hot_rows.column("state_listed").to_numpy()[at]
            factor[i], state_factor[i] = (f[ctx[i]] for f in factors.value)
        words_, base = numbered(columns)
        del columns
        listed, factor = shares(words_, base, train, discount, (depth, ctx, listed, factor, state_listed, state_factor))
        at, told = 0, []
        for doc in docs:
            own = slice(at, at + len(doc))
            at += len(doc)
            f, li, fa = far[own], listed[own], factor[own]
            score = np.log10(li[~f] + fa[~f] * root_share(c[own][~f]))
            new = np.flatnonzero(np.diff(doc[~f], prepend=-1))
            total = np.add.reduceat(score, new) if len(new) else np.zeros(0)
            told.append(packed([np.diff(doc[~f][new], prepend=0).astype(np.int32), total.astype(np.float64), np.diff(doc[f], prepend=0).astype(np.int32), code[own][f], li[f], fa[f]]))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "size": pa.array([t[0] for t in told], pa.int64()), "blob": pa.array([t[1] for t in told], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        told = [unpacked(size, blob, TOLD) for size, blob in zip(group.column("size").to_pylist(), group.column("blob").to_pylist(), strict=True)]
        docs = [np.cumsum(t[0]) for t in told]
        score = np.zeros(1 + max((int(d[-1]) for d in docs if len(d)), default=-1))
        for doc, t in zip(docs, told, strict=True):
            score[doc] += t[1]
        where, word, li, fa = (np.concatenate([np.cumsum(t[2]) if i == 2 else t[i] for t in told]) for i in range(2, 6))
        d, k = len(score), len(where)
        # FAR is set in the codes, so the hashes that are joined have it set as well
        columns = [
            pa.array(np.append(chunk + np.arange(d), chunk + where).astype(np.int64)), pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(word.view(np.int64))]), pa.concat_arrays([pa.array(score), pa.nulls(k, pa.float64())]),
            pa.concat_arrays([pa.nulls(d, pa.float64()), pa.array(li)]), pa.concat_arrays([pa.nulls(d, pa.float64()), pa.array(fa)]),
        ]
        return pa.Table.from_arrays(columns, ["row", "h", "score", "listed", "factor"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home in batch.column("home"):
                yield from pa.ipc.open_stream(home.as_py()).read_all().to_batches()

    slices = min(SLICES, int(places[1].sum()))
    done = []
    for k in range(slices):
        requests = coded_texts.mapInArrow(ask(k), "bucket long, chunk long, size long, blob binary")
        answers = requests.groupBy("bucket").cogroup(known.where(F.col("bucket") % slices == k).groupBy("bucket")).applyInArrow(tell, "chunk long, size long, blob binary")
        done.append(materialise(answers.groupBy("chunk").applyInArrow(gather, PART), "scored"))
    home = materialise(kept.select("home").mapInArrow(texts, TEXT + ", far long"), "texts")
    release(kept)
    parts = home.where("far != 0").select("row", F.col("far").alias("h"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("listed"), F.lit(1.0).alias("factor"))
    for one in done:
        parts = parts.unionAll(one)
    tail = words.where(F.col("c") < least).select(F.col("h").bitwiseOR(F.lit(-(1 << 63))).alias("w_h"), "c")
    return home.drop("far"), parts, tail, (n, log_all, discount, unknown)


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's scores of every whole text of documents."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
