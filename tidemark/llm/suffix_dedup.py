"""Removal of repeated byte strings with sampled suffixes, front-coded sorted runs and a prefix-aware merge.

Every 400-byte string picks one of its positions by the content alone: the leftmost smallest hash among its 100-byte
substrings. Consecutive strings of a text that pick the same position, the anchor, form one stretch. Equal strings pick
equal anchors, so only stretches whose anchors start with the same 100 bytes can hold equal strings, and the suffixes
to sort are those at anchors, one in about 150, not those at all bytes.

Stretches that occur as a whole more than once are repeated throughout. The others that share their anchor's first
bytes are compared further: tasks sort the suffixes at their anchors into runs, front-code them (length of the prefix
shared with the suffix before, then the rest) and exchange them; the receiver merges the runs with a loser tree that
never compares bytes known to be equal, which yields the sorted suffixes and the common prefix of neighbours. Strings
with j bytes left of the anchor are equal if their suffixes share 400 - j bytes, which the common prefixes tell, and
their j bytes to the left agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, M2, materialise, mix, prefix_hash, release, require, span_hash, text_chunks

#: Different stretches with one anchor key beyond which their strings are counted by hash instead of merged in one group.
MAX_CLASS = 4096
#: Suffixes that one merging group holds on average.
GROUP = 10_000
#: Suffixes of a sorted run.
RUN = 20_000
#: Bytes of text whose stretches one step finds; a longer text is cut into segments that overlap by all but one byte of a string.
SEGMENT = 256 << 10
#: Texts that are cut and hashed at a time.
ROWS = 500
#: Contents with more than this part of the shared stretches meet them by broadcast.
OFTEN = 1000


def stretches(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Document number, first and last string start (from the document's start), anchor, anchor key and content hash of each stretch."""
    gram = max(1, n // 4)  # bytes that an anchor's key covers
    none = np.zeros(0, dtype=np.int64)
    total, width = len(data), n - gram + 1
    if total < n:
        return none, none, none, none, none, none
    prefix = prefix_hash(data)
    at = np.arange(total - gram + 1)
    g = span_hash(prefix, at, at + gram)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = total - n + 1
    anchor = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(starts), "right") - 1
    s = np.flatnonzero(np.arange(starts) + n <= offsets[doc + 1])
    if not len(s):
        return none, none, none, none, none, none
    a, d = anchor[s], doc[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(s) - 1]])
    lo, hi, a, d = s[first], s[last], a[first], d[first]
    return d, lo - offsets[d], hi - offsets[d], a - offsets[d], g[a].astype(np.int64), span_hash(prefix, lo, hi + n).astype(np.int64)


def segments(batch: pa.RecordBatch, n: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, offsets and place in the text of steps of about ``size`` bytes; every string of n bytes starts in one."""
    for first, _, data, offsets in text_chunks(batch, limit=size):
        if len(offsets) > 2 or len(data) <= 2 * size:
            yield first, data, offsets, 0
            continue
        for at in range(0, len(data) - n + 1, size):
            part = data[at : at + size + n - 1]
            yield first, part, np.array([0, len(part)]), at


def find_stretches(keyed: DataFrame, n: int, size: int = SEGMENT) -> DataFrame:
    """Stretches of all texts; keyed: doc_id, th, text. A stretch that lies across a segment's end comes out in two parts."""
    names = ["doc_id", "th", "lo", "hi", "anchor", "key", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets, at in segments(batch, n, size):
                d, lo, hi, a, key, content = stretches(data, offsets, n)
                if len(d):
                    rows = pa.array(d + first)
                    lo, hi, a = lo + at, hi + at, a + at
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("th").take(rows), *(pa.array(x.astype(np.int32)) for x in (lo, hi, a)), pa.array(key), pa.array(content)], names
                    )

    return keyed.mapInArrow(run, "doc_id long, th int, lo int, hi int, anchor int, key long, content long")


def shared_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of x and y, of which ``known`` bytes are known to agree."""
    end = min(len(x), len(y))
    step = 64
    while known < end:
        if x[known : known + step] == y[known : known + step]:
            known = min(end, known + step)
        elif step == 1:
            return known
        else:
            step = max(1, step // 8)
    return known


class LoserTree:
    """Merges sorted runs of (suffix, prefix shared with the run's suffix before, item); each suffix's known prefix is never compared again."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.runs = [iter(r) for r in runs]
        self.loser: list[tuple[int, int]] = [(-1, 0)] * self.size  # run, prefix shared with the winner that beat it
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.top = self._build(1)

    def _play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        x, y = self.heads[a[0]], self.heads[b[0]]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if a[1] != b[1]:  # the one that shares more with the last winner is smaller
            return (a, b) if a[1] > b[1] else (b, a)
        same = shared_prefix(x[0], y[0], a[1])
        return ((a, (b[0], same)) if x[0][same : same + 1] <= y[0][same : same + 1] else (b, (a[0], same)))

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return (node - self.size, 0)
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        """Suffix, prefix shared with the suffix before, item; in order."""
        while (head := self.heads[self.top[0]]) is not None:
            yield head[0], self.top[1], head[2]
            run = self.top[0]
            new = next(self.runs[run], None)
            self.heads[run] = new
            now = (run, new[1] if new else 0)
            node = (run + self.size) // 2
            while node:
                now, self.loser[node] = self._play(now, self.loser[node])
                node //= 2
            self.top = now


def repeated_strings(left: list[bytes], shared: list[int], low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Of stretches sorted by their suffix, which strings occur in another one: a row each, a column for each j (bytes left of the anchor).

    left: bytes before each anchor; shared: prefix shared with the suffix before; low, high: the j of each stretch.
    """
    m, width = len(left), int(high.max()) + 1
    back = np.zeros((m, width), dtype=np.uint64)
    for i, x in enumerate(left):
        tail = np.frombuffer(x, dtype=np.uint8)[::-1][: width - 1]
        back[i, 1 : len(tail) + 1] = tail.astype(np.uint64) + np.uint64(1)
    powers = np.multiply.accumulate(np.full(width, BASE))
    hashes = np.cumsum(back * powers, axis=1, dtype=np.uint64)
    j = np.arange(width)
    group = np.cumsum(np.asarray(shared)[:, None] < n - j, axis=0)
    value = mix(mix(hashes) + group.astype(np.uint64) * M2 + j.astype(np.uint64) * BASE)
    valid = (j >= low[:, None]) & (j <= high[:, None])
    _, inverse, counts = np.unique(value[valid], return_inverse=True, return_counts=True)
    out = np.zeros((m, width), dtype=bool)
    out[valid] = counts[inverse] > 1
    return out


RUNS = "part int, run long, seq int, shared int, rest binary, left binary, w1 long, w2 long, doc_id long, th int, lo int, hi int, n long"


def sorted_runs(members: DataFrame, parts: int, n: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at anchors, and hashes of the single strings where a class is hot.

    members: doc_id, th, text and an array ``own`` of (lo, hi, anchor, key, n, hot).
    """
    names = [c.split()[0] for c in RUNS.split(", ")]

    def emit(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0], x[1]))
        rows: list[tuple] = []
        part, before, run, seq = None, b"", 0, 0
        for p, suffix, left, doc_id, th, lo, hi, count in held:
            if p != part:
                part, before, seq = p, b"", 0
                run = int.from_bytes(hashlib.blake2b(f"{doc_id} {th} {lo} {len(held)}".encode(), digest_size=8).digest(), "little", signed=True)
            same = shared_prefix(before, suffix, 0)
            rows.append((p, run, seq, same, suffix[same:], left, None, None, doc_id, th, lo, hi, count))
            before, seq = suffix, seq + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names)

    KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            ids, ths = batch.column("doc_id"), batch.column("th")
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py().encode()
                prefix = None
                for o in batch.column("own")[i].as_py():
                    lo, hi, a = o["lo"], o["hi"], o["anchor"]
                    if o["hot"]:
                        if prefix is None:
                            raw = np.frombuffer(data, dtype=np.uint8)
                            prefix, other = prefix_hash(raw), prefix_hash(raw ^ np.uint8(0x5A))
                        s = np.arange(lo, hi + 1)
                        w1, w2 = span_hash(prefix, s, s + n).astype(np.int64), span_hash(other, s, s + n).astype(np.int64)
                        k = len(s)
                        none = lambda t, k=k: pa.nulls(k, t)
                        yield pa.RecordBatch.from_arrays(
                            [none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary()), pa.array(w1), pa.array(w2), pa.array([ids[i].as_py()] * k, pa.int64()), pa.array([ths[i].as_py()] * k, pa.int32()), pa.array(s.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array([o["n"]] * k, pa.int64())], names
                        )
                    else:
                        held.append((o["key"] % parts, data[a : hi + n], data[lo:a], ids[i].as_py(), ths[i].as_py(), lo, hi, o["n"]))
                if len(held) >= RUN:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    return members.select("doc_id", "th", "text", "own").mapInArrow(run, RUNS)


def merge_runs(runs: DataFrame, n: int) -> DataFrame:
    """Spans (doc_id, th, begin, end) of repeated strings in stretches that occur once, from the merged runs of each part."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("run", "ascending"), ("seq", "ascending")])
        c = {k: group.column(k).to_pylist() for k in ("run", "seq", "shared", "rest", "left", "doc_id", "th", "lo", "hi", "n")}
        starts = [i for i in range(group.num_rows) if not i or c["run"][i] != c["run"][i - 1] or c["seq"][i] == 0]

        def read(i: int, end: int) -> Iterator[tuple[bytes, int, object]]:
            before = b""
            for k in range(i, end):
                before = before[: c["shared"][k]] + c["rest"][k]
                yield before, c["shared"][k], k

        out: list[tuple] = []

        def resolve(items: list[int], shared: list[int]) -> None:
            if len(items) < 2:
                return
            anchor = np.array([c["lo"][k] + len(c["left"][k]) for k in items])
            low, high = anchor - np.array([c["hi"][k] for k in items]), anchor - np.array([c["lo"][k] for k in items])
            hit = repeated_strings([c["left"][k] for k in items], shared, low, high, n)
            for r, k in enumerate(items):
                if c["n"][k] == 1 and len(js := np.flatnonzero(hit[r])):
                    for js_run in np.split(js, np.flatnonzero(np.diff(js) > 1) + 1):
                        out.append((c["doc_id"][k], c["th"][k], int(anchor[r] - js_run[-1]), int(anchor[r] - js_run[0]) + n))

        items, shared = [], []
        least = max(1, n // 4)
        for _, same, k in LoserTree([read(i, j) for i, j in zip(starts, [*starts[1:], group.num_rows], strict=True)]):
            if same < least:
                resolve(items, shared)
                items, shared = [], []
            items.append(k)
            shared.append(same)
        resolve(items, shared)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(("doc_id", "th", "begin", "end"), kinds, strict=True))})

    return runs.where("part is not null").groupBy("part").applyInArrow(merge, "doc_id long, th int, begin int, end int")


def repeated_spans(documents: DataFrame, n: int = 400, max_class: int = MAX_CLASS) -> DataFrame:
    """(doc_id, th, spans): byte ranges, possibly overlapping, that strings of ``n`` bytes occurring elsewhere cover."""
    keyed = keyed_texts(documents)
    found = materialise(find_stretches(keyed.where(F.octet_length("text") >= n), n), "stretches")
    keys = found.groupBy("key").agg(F.count("*").alias("c"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("c > 1")
    # written first: joined straight away, its partitioning would keep Spark from splitting the rows of a hot key
    keys = materialise(keys.select("key", (F.col("c0") != F.col("c1")).alias("differ")), "shared-keys")
    again = materialise(found.join(keys, "key"), "shared-stretches")
    release(found, keys)
    distinct = materialise(again.groupBy("key", "content").agg(F.count("*").alias("n"), F.first("differ").alias("differ"), F.min(F.struct("doc_id", "th", "lo", "hi", "anchor")).alias("at")), "distinct-stretches")
    twice = distinct.where("n > 1").select("key", "content", "n")
    # contents with over 1 / OFTEN of all rows, at most OFTEN of them, are broadcast so that no task takes all rows of one
    bound = again.count() / OFTEN
    common = F.broadcast(twice.where(F.col("n") > bound).select("key", "content"))
    others = twice.where(F.col("n") <= bound).select("key", "content")
    whole = again.join(common, ["key", "content"]).unionByName(again.join(common, ["key", "content"], "left_anti").join(others, ["key", "content"]))
    whole = whole.select("doc_id", "th", F.col("lo").alias("begin"), (F.col("hi") + n).alias("end"))

    differ = distinct.where("differ").select("key", "n", "at.*")
    hot = materialise(differ.groupBy("key").count().select("key", (F.col("count") > max_class).alias("hot")), "hot-keys")
    own = differ.join(hot, "key").groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "anchor", "key", "n", "hot")).alias("own"))
    parts = max(256, differ.count() // GROUP)
    members = on_document(keyed, own, "inner")
    runs = materialise(sorted_runs(members, parts, n), "runs")
    release(hot)
    merged = merge_runs(runs, n)
    single = runs.where("part is null").select("w1", "w2", "doc_id", "th", "lo", "n")
    often = single.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    counted = single.where("n = 1").join(often, ["w1", "w2"]).select("doc_id", "th", F.col("lo").alias("begin"), (F.col("lo") + n).alias("end"))
    return whole.unionAll(merged).unionAll(counted).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def keyed_texts(documents: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and text; th tells apart rows that share a doc_id."""
    require(documents, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("th"), text.alias("text"))


def on_document(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (nulls match) and th."""
    other = other.withColumnsRenamed({"doc_id": "o_id", "th": "o_th"})
    return texts.join(other, texts["doc_id"].eqNullSafe(F.col("o_id")) & (texts["th"] == F.col("o_th")), how).drop("o_id", "o_th")


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many maximal runs were removed."""
    if not spans:
        return data, 0
    kept, at, runs, end = [], 0, 0, -1
    for s in sorted((s["begin"], s["end"]) for s in spans):
        if s[0] > end:
            runs += 1
            kept.append(data[at : s[0]])
        end = max(end, s[1])
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def digests(documents: DataFrame, n: int = 400, max_class: int = MAX_CLASS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_kept_chars and repeats (whether bytes were removed).

    Every byte that a string of ``n`` bytes covers which also starts anywhere else, in the same text or another, is
    removed; strings are judged on the input. Null and empty texts, and texts shorter than ``n``, keep all bytes.
    Repeated rows are texts of their own: each is the other's repetition. Other columns are ignored. n_kept_chars counts
    the characters of ``remove_repeats``: those of the kept bytes without the parts of cut characters.
    """
    joined = on_document(keyed_texts(documents), repeated_spans(documents, n, max_class), "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept_chars", "repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    data = text.encode()
                    kept, runs = cut(data, spans)
                    rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), len(kept.decode("utf-8", "ignore")), len(kept) < len(data)))
                cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in cols)], names)

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept_chars long, repeats boolean")


def remove_repeats(documents: DataFrame, n: int = 400, max_class: int = MAX_CLASS) -> DataFrame:
    """The documents, all rows and columns, with the kept bytes as text (bytes of cut characters dropped) and n_chars to match."""
    names = documents.columns
    key = lambda text: F.hash(F.coalesce(text, F.lit("")))
    spans = repeated_spans(documents, n, max_class).select(F.struct(F.col("doc_id").alias("id"), "th").alias("key"), "spans")
    # the input's columns stand in one struct, so no name of theirs can clash
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("key.id")) & (key(F.col("row.text")) == F.col("key.th"))
    joined = rows.join(spans, on, "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cols = dict(zip(names, part.column("row").flatten(), strict=True))
                texts = cols["text"].to_pylist()
                new = [t if not s or t is None else cut(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, part.column("spans").to_pylist(), strict=True)]
                cols["text"] = pa.array(new, pa.string())
                if "n_chars" in names:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return joined.mapInArrow(run, documents.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every whole text of documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
