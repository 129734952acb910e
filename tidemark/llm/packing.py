"""Best-fit packing after a dominance reduction: documents into as few sequences of a fixed number of tokens as it can.

Texts are encoded in the tasks and written once, with the ids of every piece. Piece lengths are integers up to the
capacity, so the instance is a histogram of at most ``capacity`` counts, however many documents there are. The driver
reduces that histogram: sets of at most three pieces which provably dominate every other filling of a sequence are fixed
(Martello and Toth's criteria, applied to whole classes of equal pieces), and what is left goes by best fit, longest first.
The outcome is a list of placements of runs of equal pieces. A piece's rank among those of its length, from per-task
counts, finds its placement; nothing but counts reaches the driver and no group of pieces is gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, require

CAPACITY, END = 1024, 2
#: Characters of a text that are encoded at a time.
BLOCK_CHARS = 1 << 20
#: Bytes of ids that leave a task at a time; a longer document's leave at once.
STEP_BYTES = 8 << 20
#: A space between two others than white space: the pattern starts a token there.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the merges of a byte-level vocabulary file of the tokenizers library; equal to that library's ids."""

    def __init__(self, vocabulary: str):
        import tiktoken

        spec = json.loads(vocabulary)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.library = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a whole text. A long one is encoded in blocks, cut where the pattern starts a token whatever stands around."""
        out, at = [], 0
        while len(text) - at > BLOCK_CHARS and (cut := BETWEEN.search(text, at + BLOCK_CHARS)):
            out.append(self.library.encode_to_numpy(text[at : cut.start()], allowed_special="all"))
            at = cut.start()
        out.append(self.library.encode_to_numpy(text[at:], allowed_special="all"))
        return np.concatenate(out) if len(out) > 1 else out[0]


def letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: its own where it prints, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A written table of every document's pieces: doc_id, piece, start, length, ids (little-endian unsigned 32 bits), task, nth.

    A document is its text's ids and END. Only one longer than the capacity is cut, into pieces of the capacity with a
    first one that may be shorter. ``nth`` counts pieces of one length within the task that made them.
    """
    require(documents, "doc_id", "text")
    path = path or default_vocabulary()
    with open(path) as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(vocabulary.value))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            docs, rows, data, held = batch.column("doc_id"), [], [], 0
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                data.append(ids.tobytes())
                held += len(data[-1])
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    length = capacity if k else first
                    rows.append((i, k, start, length, seen[length]))
                    seen[length] += 1
                if held > STEP_BYTES or i + 1 == batch.num_rows:
                    of, piece, start, length, nth = (np.array(x) for x in zip(*rows, strict=True))
                    cuts = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                    values = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(data))])
                    rest = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), values, pa.array(np.full(len(rows), task), pa.int32()), pa.array(nth, pa.int64())]
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(of)), *rest], names)
                    rows, data, held = [], [], 0

    out = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids binary, task int, nth long")
    return materialise(out, "pieces")


@dataclass
class Plan:
    """Placements: pieces of ``length`` from rank ``rank`` on go ``per`` to a sequence, from place ``offset``, into ``bins`` sequences from ``sequence`` on."""

    capacity: int
    left: np.ndarray
    sequences: int = 0
    fixed: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    _rank: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, sequence: int, bins: int, per: int, offset: int) -> None:
        self.rows.append((length, self._rank[length], sequence, bins, per, offset))
        self._rank[length] += bins * per
        self.left[length] -= bins * per

    def fix(self, lengths: list[int], times: int) -> None:
        """``times`` new sequences with these lengths each."""
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            self.put(x, self.sequences, times, per, offset)
            offset += per * x
        self.sequences += times
        self.fixed += times


def dominating(left: np.ndarray, one: int, capacity: int) -> list[int] | None:
    """Lengths that may be fixed beside a piece of length ``one``, as no filling of its sequence can do better; None if no criterion holds.

    Let r be the room left and x the longest other piece that fits. {x} dominates if x fills r, if no two others fit, or if
    no three fit and no two sum to more than x: any filling S of that sequence can change places with x. The fullest pair
    {a, b} with a = x, a >= b, dominates if no three fit and no two others longer than b fit together: then every filling
    has at most two pieces, of which the shorter is no longer than b, and they change places with a and b.
    """
    others = left.copy()
    others[one] -= 1
    room = capacity - one
    fits = np.flatnonzero(others[: room + 1])
    if not len(fits):
        return []
    x = int(fits[-1])
    smallest = np.repeat(fits[:3], np.minimum(others[fits[:3]], 3))[:3]
    if x == room or len(smallest) == 1 or smallest[:2].sum() > room:
        return [x]
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    best, b = 0, 0
    for a in fits[::-1]:
        partners = fits[fits <= min(a, room - a)]
        if len(partners) and partners[-1] == a and others[a] < 2:
            partners = partners[:-1]
        if len(partners) and a + partners[-1] > best:
            best, b, widest = int(a + partners[-1]), int(partners[-1]), int(a)
        if 2 * a <= best:
            break
    if best <= x:
        return [x]
    if widest == x:
        longer = others[b + 1 :].copy()
        longer[x - b - 1] -= 1 if x > b else 0
        two = np.flatnonzero(longer)[:2]
        two = np.repeat(two, np.minimum(longer[two], 2))[:2] + b + 1
        if len(two) < 2 or two.sum() > room:
            return [x, b]
    return None


def reduce(plan: Plan) -> None:
    """Fix dominating sets, from the longest piece down, until none is left to fix. Counts only fall, so a criterion that holds once holds for all equal sets that are left."""
    changed = True
    while changed:
        changed = False
        for one in range(plan.capacity, 0, -1):
            while plan.left[one] > 0 and (beside := dominating(plan.left, one, plan.capacity)) is not None:
                lengths = [one, *beside]
                plan.fix(lengths, int(min(plan.left[x] // lengths.count(x) for x in lengths)))
                changed = True


def best_fit(plan: Plan) -> None:
    """Longest first, each piece into the fullest open sequence that has room; equal pieces and equal sequences are taken together."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length in range(plan.capacity, 0, -1):
        while n := int(plan.left[length]):
            r = next((r for r in range(length, plan.capacity + 1) if room[r]), None)
            if r is None:
                r, most = plan.capacity, plan.capacity // length
                room[r].append((plan.sequences, -(-n // most)))
                plan.sequences += room[r][-1][1]
            first, bins = room[r].pop()
            per = min(r // length, n)
            used = min(bins, n // per)
            plan.put(length, first, used, per, plan.capacity - r)
            room[r - per * length].append((first, used))
            if used < bins:
                room[r].append((first + used, bins - used))


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length; its size depends on the lengths, not on the counts."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = Plan(capacity, left)
    reduce(plan)
    best_fit(plan)
    return plan


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The table of ``pieces`` (with any other columns) with sequence_id and offset.

    Null and empty texts are one piece of END alone. Rows with a null doc_id and repeated rows are packed as often as they
    are there. An empty table gives no rows. Every sequence is full from 0 on without gaps.
    """
    spark = table.sparkSession
    by_task = table.groupBy("task", "length").agg(F.count("*").alias("_n"))
    plan = plan_of({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)  # a row a length
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = by_task.select("task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    where = sorted(plan.rows)
    known = spark.sparkContext.broadcast(np.array(where, dtype=np.int64).reshape(-1, 6))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        w = known.value
        key = lambda x, r: x.astype(np.int64) << 48 | r
        x, r = length.to_numpy(), rank.to_numpy()
        own = w[np.searchsorted(key(w[:, 0], w[:, 1]), key(x, r), "right") - 1]
        turn = r - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + turn // own[:, 4], "offset": own[:, 5] + turn % own[:, 4] * x})

    rows = table.join(offsets, ["task", "length"]).withColumn("_at", placed("length", F.col("nth") + F.col("_before")))
    return rows.select(*(c for c in table.columns if c not in ("task", "nth")), "_at.sequence_id", "_at.offset")


def packed(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece of all documents; columns but doc_id and text are ignored."""
    return pack(pieces(documents, capacity, path), capacity)


def op11(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: the pieces' ids are read once, for their checksums."""
    table = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = pack(table.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"))
    return rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
