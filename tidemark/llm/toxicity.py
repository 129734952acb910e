"""Toxicity scores from a factorization machine over hashed terms.

A text is cut into overlapping windows of words. Each word gives hashed terms: the word and its first bytes. A window's
logit is bias + sum of term weights + sum of the dot products of the factors of every two terms, and the text's score is
that of its strongest window, so a long text isn't diluted. Labels mark texts, not windows: training starts from
smoothed log-odds of the terms that stand out and then, over and over, takes each text's strongest window as its example.
The bias is centred before pairs are looked for, in all words of the training texts. Pairs of words that come with errors
of the weights alone have factors, whether their words stand out or not: words that are harmless apart are found together. Words over WINDOW words apart never meet, nor do some that are over half of it apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialise, mix, prefix_hash, require, span_hash, text_chunks

#: Hashed terms, factors of each, bytes of the prefixes that are terms too.
TERMS, FACTORS, PREFIXES = 1 << 17, 4, (4, 6)
#: Words of a window; windows start at every half of it.
WINDOW = 256
#: Labelled texts of each class that training takes at most (those with the smallest hash of doc_id), whole.
SAMPLE = 4000
#: Words that one step of training or scoring takes at a time.
STEP = 200_000
#: Times that the strongest windows are taken to learn weights, their step, decay, pseudo-counts, and standard errors by which a term stands out.
EPOCHS, RATE, DECAY, SMOOTH, LEAST = 10, 0.08, 1e-4, 2.0, 3.0
#: Times that they are taken to learn factors, gradient steps after each, their size and decay, and the deviation of the first factors.
ROUNDS, STEPS, STEP_SIZE, SHRINK, SPREAD = 3, 80, 0.15, 1e-4, 0.1
#: Texts that a pair is in at least, standard errors by which its texts' labels differ from the scores, and those by which a cell of hashed pairs is looked into.
TEXTS, CLEAR, LOOK = 5, 5.0, 3.0
#: Cells that pairs are hashed to, ranges of them that are summed at a time, tasks that fill cells, and words of a text whose pairs are made at a time.
CELLS, RANGES, FILLERS, BLOCK = 1 << 20, 16, 8, 4096


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, a row for each word (letters, digits and bytes beyond ASCII; A-Z lower-cased; repeated at once, it counts once), and first word of each text."""
    low = lower_ascii(data)
    n = len(low)
    own = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first, last = own.copy(), own.copy()
    if n:
        first[1:] &= ~own[:-1] | cut[1:-1]
        last[:-1] &= ~own[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = prefix_hash(low)
    word = span_hash(prefix, starts, ends)
    fresh = np.ones(len(starts), dtype=bool)
    if n:  # a word said over and over counts once
        fresh[1:] = (word[1:] != word[:-1]) | np.add.reduceat(cut[:n], starts)[1:].astype(bool) if len(starts) else fresh[1:]
    starts, ends, word = starts[fresh], ends[fresh], word[fresh]
    columns = [word] + [span_hash(prefix, starts, np.minimum(ends, starts + k)) * np.uint64(2 * k + 1) for k in PREFIXES]
    return np.stack([(c >> np.uint64(20)) % np.uint64(TERMS) for c in columns], axis=1).astype(np.int32), np.searchsorted(starts, offsets)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (words) and text of every window; a text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // (WINDOW // 2)) + 1)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][text] + nth * (WINDOW // 2)
    return begin, np.minimum(begin + WINDOW, first[1:][text]), text


def steps(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about STEP words."""
    lo = 0
    while lo < len(first) - 1:
        hi = min(len(first) - 1, max(lo + 1, int(np.searchsorted(first, first[lo] + STEP, "right")) - 1))
        yield lo, hi
        lo = hi


class Machine:
    """Bias, weights and factors of the terms; ``slope`` and ``shift`` make a probability of a text's largest logit."""

    slope, shift = 1.0, 0.0

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))

    def calibrate(self, z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """Take slope and shift with the least weighted logistic loss for Platt's smoothed targets, from a grid."""
        up, down = (weight * labels).sum(), (weight * (1 - labels)).sum()
        target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
        cuts = np.unique(np.quantile(z, np.linspace(0, 1, 801)))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        best = np.inf
        for slope in 2.0 ** np.arange(-6, 4):
            for part in np.array_split(cuts, max(1, len(cuts) // 50)):
                x = slope * (z[None, :] - part[:, None])
                loss = (weight * (np.logaddexp(0, x) - target * x)).sum(axis=1)
                if loss.min() < best:
                    best, self.slope, self.shift = loss.min(), float(slope), float(-slope * part[loss.argmin()])

    def logits(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logit of each window of words begin..end of ``rows``."""
        w = self.weights[rows].sum(axis=1)
        v = self.factors[rows]
        table = np.concatenate([w[:, None], (v * v).sum(axis=(1, 2))[:, None], v.sum(axis=1)], axis=1)
        sums = np.zeros((len(rows) + 1, table.shape[1]))
        np.cumsum(table, axis=0, out=sums[1:])
        x = sums[end] - sums[begin]
        return self.bias + x[:, 0] + 0.5 * ((x[:, 2:] ** 2).sum(axis=1) - x[:, 1])

    def strongest(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, begin and end of each text's strongest window, for about STEP words at a time."""
        parts = [self._strongest(rows[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]) + (first[lo],) for lo, hi in steps(first)]
        if not parts:
            return np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + p[3] for p in parts]), np.concatenate([p[2] + p[3] for p in parts])

    def _strongest(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, end, text = windows(first)
        z = self.logits(rows, begin, end)
        at = np.searchsorted(text, np.arange(len(first) - 1))
        best = np.maximum.reduceat(z, at) if len(at) else np.zeros(0)
        order = np.flatnonzero(z == best[text])
        pick = order[np.searchsorted(text[order], np.arange(len(first) - 1))]
        return best, begin[pick], end[pick]


def pairs(words: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of different words under WINDOW words apart, smaller term first, as one number each, as often as they come; a block of words at a time."""
    words = words.astype(np.int64)
    for lo in range(0, len(words), BLOCK):
        own = words[lo : lo + BLOCK]
        found = []
        for step in range(1, WINDOW):
            other = words[lo + step : lo + step + BLOCK]
            mine = own[: len(other)]
            if not len(mine):
                break
            found.append(np.where(mine < other, mine * TERMS + other, other * TERMS + mine)[mine != other])
        if found:
            yield np.concatenate(found)


def cell(pair: np.ndarray) -> np.ndarray:
    """Cell of each pair."""
    return (mix(pair.astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def clear(rest: np.ndarray, variance: np.ndarray, least: float) -> np.ndarray:
    """Whether sums of label less score are ``least`` standard errors or more from 0."""
    return (variance > 0) & (np.abs(rest) >= least * np.sqrt(np.maximum(variance, 1e-12)))


def telling_terms(texts: DataFrame, machine: Machine, balance: tuple[float, float]) -> np.ndarray:
    """Terms of the word pairs whose texts' labels differ from their scores beyond chance, over all words of the texts (y, terms).

    First pairs are hashed to cells, which have a fixed size in every task; then the pairs in cells that stand out are counted as rows.
    """
    spark, width = texts.sparkSession, 1 + len(PREFIXES)
    shared = spark.sparkContext.broadcast(machine)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, float, float]]:
        for batch in batches:
            for y, blob in zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                own = np.frombuffer(blob, dtype=np.int32).reshape(-1, width)
                z = shared.value.strongest(own, np.array([0, len(own)]))[0][0]
                p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield own[:, 0], (y - p) * balance[y], max(p * (1 - p), 0.01) * balance[y] ** 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS))
        for words, rest, variance in read(batches):
            there = np.zeros(CELLS, dtype=bool)
            for some in pairs(words):
                there[cell(some)] = True
            sums[0, there] += rest
            sums[1, there] += variance
        task = TaskContext.get().partitionId()
        parts = np.split(sums.astype(np.float32), RANGES, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES)), pa.array(np.full(RANGES, task)), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "task", "sums"])

    def stand_out(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        rest, variance = sum(np.frombuffer(b, dtype=np.float32).reshape(2, -1).astype(np.float64) for b in group.column("sums").to_pylist())
        return pa.table({"cell": np.flatnonzero(clear(rest, variance, LOOK)) + group.column("part")[0].as_py() * (CELLS // RANGES)})

    got = texts.coalesce(FILLERS).mapInArrow(fill, "part long, task long, sums binary").groupBy("part").applyInArrow(stand_out, "cell long").toArrow()  # at most CELLS rows
    looked = np.zeros(CELLS, dtype=bool)
    looked[got.column("cell").to_numpy()] = True
    cells = spark.sparkContext.broadcast(looked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                name, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                sums = [np.bincount(at, np.repeat([h[i] for h in held], [len(h[0]) for h in held]), len(name)) for i in (1, 2, 3)]
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(sums[0].astype(np.int64)), pa.array(np.rint(sums[1] * 2**30).astype(np.int64)), pa.array(np.rint(sums[2] * 2**30).astype(np.int64))], ["pair", "n", "rest", "variance"])

        size = 0
        for words, rest, variance in read(batches):
            found = [some[cells.value[cell(some)]] for some in pairs(words)]
            if found:
                held.append((np.unique(np.concatenate(found)), 1, rest, variance))
                size += len(held[-1][0])
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    # sums are whole numbers of 2**-30, so that they don't depend on the order
    sums = texts.mapInArrow(count, "pair long, n long, rest long, variance long").groupBy("pair").agg(F.sum("n").alias("n"), (F.sum("rest") / 2**30).alias("rest"), (F.sum("variance") / 2**30).alias("variance"))
    told = sums.where((F.col("n") >= TEXTS) & (F.abs("rest") >= CLEAR * F.sqrt("variance")))
    got = told.select(F.explode(F.array(F.floor(F.col("pair") / TERMS), F.col("pair") % TERMS)).alias("term")).distinct().toArrow()  # at most TERMS rows
    return np.sort(got.column("term").to_numpy().astype(np.int64))


def descend(machine: Machine, rows: np.ndarray, n: np.ndarray, labels: np.ndarray, balance: np.ndarray, mask: np.ndarray) -> None:
    """Adagrad steps of the weighted logistic loss over one window a text, for the terms of ``mask`` and the bias; what had the least loss stays.

    rows: terms of the words, n: words of each window.
    """
    used, t = np.unique(rows, return_inverse=True)
    flat, owners = t.ravel(), np.repeat(np.arange(len(n)), n * rows.shape[1])
    mine = np.flatnonzero(mask[used][flat])  # the others have no factors
    fixed = machine.weights[used] * ~mask[used]
    fixed = np.bincount(owners, fixed[flat], len(n))
    own, at = np.unique(flat[mine], return_inverse=True)
    owners = owners[mine]
    w, v, bias = machine.weights[used[own]], machine.factors[used[own]], machine.bias
    squares = [np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8]
    best = None
    for _ in range(STEPS + 1):
        each = v[at]
        total = np.stack([np.bincount(owners, each[:, f], len(n)) for f in range(FACTORS)], axis=1)
        z = bias + fixed + np.bincount(owners, w[at], len(n)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(owners, (each**2).sum(axis=1), len(n)))
        loss = float((balance * (np.logaddexp(0, z) - labels * z)).sum() + SHRINK * ((w**2).sum() + (v**2).sum()) / 2)
        if best is None or loss < best[0]:
            best = (loss, w.copy(), v.copy(), bias)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance
        e = error[owners]
        gradients = [
            np.bincount(at, e, len(own)) + SHRINK * w,
            np.stack([np.bincount(at, e * (total[owners, f] - each[:, f]), len(own)) for f in range(FACTORS)], axis=1) + SHRINK * v,
            float(error.sum()),
        ]
        squares = [s + g**2 for s, g in zip(squares, gradients, strict=True)]
        w, v, bias = (x - STEP_SIZE * g / np.sqrt(s) for x, g, s in zip((w, v, bias), gradients, squares, strict=True))
    machine.weights[used[own]], machine.factors[used[own]], machine.bias = best[1:]


def centred(z: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> float:
    """What added to all logits makes the weighted labels less the scores sum to 0."""
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        over = float(((1 / (1 + np.exp(-np.clip(z + middle, -60, 60))) - labels) * balance).sum()) > 0
        low, high = (low, middle) if over else (middle, high)
    return (low + high) / 2


def fit(counts: np.ndarray, labels: np.ndarray, strongest: Callable[[Machine], tuple[np.ndarray, np.ndarray, np.ndarray]], telling: Callable[[Machine, tuple[float, float]], np.ndarray], per_sampled: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> Machine:
    """A machine learned from labelled texts; without both classes, one that gives their share.

    counts: texts of class 0 and 1 that have each term. strongest: gives, for a machine, the logit of each text's strongest
    window, the terms of all those windows and the number of words of each, in the order of the labels.
    telling: gives, for a machine and the weights of both classes, the terms of pairs that come with its errors.
    per_sampled: labelled texts of class 0 and 1 that each sampled one stands for, for the calibration.
    """
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(TERMS), np.zeros((TERMS, FACTORS)))
    if not 0 < labels.sum() < len(labels):
        return machine
    ratio = labels.sum() / (len(labels) - labels.sum())
    n = counts[0] + counts[1]
    above = (counts[1] - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    # weights are of terms that stand out in labelled texts: a term of one or two texts is chance
    known = (above >= LEAST) & (counts[1] >= 3)
    machine.bias, machine.weights = -3.0, np.where(known, np.log((counts[1] + SMOOTH) / (counts[0] * ratio + SMOOTH)), 0)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    g2w, g2b = np.full(TERMS, 1e-3), 1e-3
    for _ in range(EPOCHS):
        z, rows, n = strongest(machine)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance
        for c in range(rows.shape[1]):
            gw = np.bincount(rows[:, c], np.repeat(error, n), TERMS)
            g2w += gw**2
            machine.weights -= known * RATE * gw / np.sqrt(g2w)
        g2b += error.sum() ** 2
        machine.bias -= RATE * error.sum() / np.sqrt(g2b)
        machine.weights *= 1 - DECAY
    paired = np.zeros(TERMS, dtype=bool)
    z = strongest(machine)[0]
    for _ in range(ROUNDS):
        machine.bias += centred(z, labels, balance)
        new = telling(machine, (0.5 / (1 - share), 0.5 / share))
        new = new[~paired[new]]
        machine.factors[new] = rng.normal(0, SPREAD, (len(new), FACTORS))
        machine.weights[new] += 0.01  # among windows that are as strong, those that hold them are taken first
        paired[new] = True
        if not paired.any():
            break
        _, rows, n = strongest(machine)
        descend(machine, rows, n, labels, balance / len(labels), paired)
        z = strongest(machine)[0]
    machine.weights, machine.factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    machine.calibrate(strongest(machine)[0], labels, np.asarray(per_sampled)[labels])
    return machine


def train(documents: DataFrame, labels: DataFrame, fold: int = 3, left_out: int = 1) -> Machine:
    """Fit on at most SAMPLE labelled texts of each class whose crc32(doc_id as text) mod ``fold`` is not ``left_out``.

    The sample has a fixed size bound, so its ids are broadcast. Its whole texts stay in the tasks; the number of texts that
    have each term and, for each step, one window a text come to the driver. Null labels don't count;
    of several labels of one document the largest does.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("y")).where("l_id is not null and y in (0, 1)").groupBy("l_id").agg(F.max("y").alias("y"))
    known = known.where(F.crc32(F.col("l_id").cast("string")) % fold != left_out)
    there = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("l_id")
    picked = known.where("y = 1").orderBy(order, "l_id").limit(SAMPLE).unionAll(known.where("y = 0").orderBy(order, "l_id").limit(SAMPLE))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", "text").repartition(4 * FILLERS, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                t, first = terms(data, offsets)
                part = batch.slice(lo, hi - lo)
                blobs = [t[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "terms"])

    texts = materialise(rows.mapInArrow(run, "doc_id long, y int, terms binary"), "terms")
    width = 1 + len(PREFIXES)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, TERMS), dtype=np.int64)
        for batch in batches:
            for y, blob in zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                n[y, np.unique(np.frombuffer(blob, dtype=np.int32))] += 1
        y, term = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(term.astype(np.int32)), pa.array(n[y, term])], ["y", "term", "n"])

    found = texts.mapInArrow(having, "y int, term int, n long").groupBy("y", "term").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * TERMS rows
    counts = np.zeros((2, TERMS))
    counts[found.column("y").to_numpy(), found.column("term").to_numpy()] = found.column("n").to_numpy()

    def strongest(machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = documents.sparkSession.sparkContext.broadcast(machine)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z, blobs = [], []
                for blob in batch.column("terms").to_pylist():
                    own = np.frombuffer(blob, dtype=np.int32).reshape(-1, width)
                    logit, begin, end = shared.value.strongest(own, np.array([0, len(own)]))
                    z.append(float(logit[0]))
                    blobs.append(own[begin[0] : end[0]].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.float64()), pa.array(blobs, pa.binary())], ["doc_id", "z", "terms"])

        got = texts.mapInArrow(best, "doc_id long, z double, terms binary").toArrow().sort_by("doc_id")  # at most one window a text
        shared.unpersist()
        blobs = got.column("terms").to_pylist()
        return got.column("z").to_numpy(), np.frombuffer(b"".join(blobs), dtype=np.int32).reshape(-1, width), np.array([len(x) // (4 * width) for x in blobs], dtype=np.int64)

    labels_ = texts.select("doc_id", "y").toArrow().sort_by("doc_id").column("y").to_numpy().astype(np.int64)
    per_sampled = tuple(there.get(y, 0) / max(1, int((labels_ == y).sum())) for y in (0, 1))
    return fit(counts, labels_, strongest, lambda machine, balance: telling_terms(texts, machine, balance), per_sampled)


def score(documents: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """All columns of documents with ``tox_score`` (0 to 1) and ``tox_predicted`` (1 at the threshold or above).

    Whole texts count; null, empty and wordless texts get the score of an empty window. Every row comes out.
    """
    require(documents, "text")
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    names = [c for c in documents.columns if c not in ("tox_score", "tox_predicted")]
    schema = documents.select(*names).schema.add("tox_score", "double").add("tox_predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                z, _, _ = shared.value.strongest(*terms(data, offsets))
                p = shared.value.probability(z)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "tox_score", "tox_predicted"])

    return documents.select(*names).mapInArrow(run, schema)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    return score(documents, train(documents, labels), threshold).where("tox_predicted = 0").select(*documents.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's scores for every whole text of documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(documents, machine, 0.7)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
