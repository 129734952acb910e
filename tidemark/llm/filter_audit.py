"""Filter interaction audit: what each of five text filters removes, in every order, by part of the corpus.

One pass scans the Arrow buffers of whole texts: byte classes and their prefix sums count words, capitals, code points
and symbols of all texts of a step at once; the words' hashes, sorted within each text, give the number of distinct
words, where neighbours of one hash are compared byte by byte before they count as one word. What leaves the tasks is
one bit mask and one digest a text. Masks are then counted by part, and all 600 (order, step) rows of a part come from
the counts of at most 32 masks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import M1, materialise, mix, prefix_hash, require, span_hash, text_chunks, word_spans

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Rows of one vectorised step at most: a row's number within the step stands in the upper 16 bits of a sort key.
STEP_ROWS = 1 << 16


def ends_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each word as numbers; of a shorter word all its bytes, twice."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))
    spare = (8 * np.maximum(0, 8 - (ends - starts))).astype(np.uint64)
    return (eight[starts + 8] << spare) >> spare, eight[ends] >> spare


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different words each row has. Words of equal hash are compared; a row where they differ is counted by a set."""
    n = np.bincount(row, minlength=rows)
    if not len(starts):
        return n
    size = ends - starts
    head, tail = ends_of_words(data, starts, ends)
    h = mix(head * M1 + mix(tail + size.astype(np.uint64)))
    if (long := np.flatnonzero(size > 16)).size:
        h[long] ^= span_hash(prefix_hash(data), starts[long], ends[long])
    key = (row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(key[a] == key[b])
    a, b = a[alike], b[alike]
    same = (size[a] == size[b]) & (head[a] == head[b]) & (tail[a] == tail[b])
    # head and tail are all of a word of 16 bytes; longer ones are compared in the middle
    for i in np.flatnonzero(same & (size[a] > 16)):
        same[i] = np.array_equal(data[starts[a[i]] : ends[a[i]]], data[starts[b[i]] : ends[b[i]]])
    out = n - np.bincount(row[a[same]], minlength=rows)
    for r in np.unique(row[a[~same]]):
        own = row == r
        out[r] = len({data[s:e].tobytes() for s, e in zip(starts[own], ends[own], strict=True)})
    return out


def failed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4 and 8 where a text fails filters A to D."""
    rows = len(offsets) - 1
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS, np.uint8)] = True

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    distinct = distinct_words(data, starts, ends, np.repeat(np.arange(rows), words), rows)
    points, capitals = count((data & 0xC0) != 0x80), count((data >= 65) & (data <= 90))
    return (
        (words < LEAST_WORDS)
        | (100 * distinct < DISTINCT_PERCENT * words).astype(int) << 1
        | (100 * capitals > CAPITAL_PERCENT * points).astype(int) << 2
        | (count(symbol[data]) > 0).astype(int) << 3
    ).astype(np.int32)


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, part, failed (bits of A to D) and digest (SHA-256) of every whole text."""
    require(documents, "doc_id", "text", "source")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                for lo, hi, data, offsets in text_chunks(batch):
                    digests = [hashlib.sha256(data[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]
                    ids, parts = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "part"))
                    yield pa.RecordBatch.from_arrays([ids, parts, pa.array(failed(data, offsets)), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])

    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part string, failed int, digest binary")


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), n, good and toxic: how many texts of a part fail just these filters.

    E's bit: the text is that of a row with a smaller doc_id. Equal rows are counted and written before they meet anything
    else, so that texts are scanned once; the first doc_id of a text is an aggregate and finds its rows by (digest, doc_id), so a text with many copies is no hot
    key. Rows without a doc_id pass E, make nothing fail it and have no labels.
    """
    require(labels, "doc_id", "quality", "toxic")
    texts = materialise(scanned(documents).groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n")), "masks")
    known = texts.where(F.col("doc_id").isNotNull())
    label = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    label = label.groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("q"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("t"))
    first = known.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_id"))
    rows = known.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_id")), "left").join(label, F.col("doc_id") == F.col("l_id"), "left")
    zero = F.lit(0)
    rows = rows.select("part", F.when(F.col("f_id").isNull(), F.col("failed").bitwiseOR(16)).otherwise(F.col("failed")).alias("failed"), "n", F.coalesce("q", zero).alias("q"), F.coalesce("t", zero).alias("t"))
    rows = rows.unionByName(texts.where(F.col("doc_id").isNull()).select("part", "failed", "n", zero.alias("q"), zero.alias("t")))
    return rows.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a source (null and the empty string are one); each has all 120 orders of the five filters with five steps.
    Null texts are empty: they fail A, and E but for the smallest doc_id. Repeated rows with one doc_id count as often as
    they are there and don't make each other fail E. A doc_id labelled more than once is good or toxic if any of its rows
    says so. Columns other than doc_id, text, source (and quality, toxic of labels) are ignored, whatever their names. An
    empty table gives no rows.
    """
    counts = masks(documents, labels)
    spark = documents.sparkSession
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    # a step depends on its filter and on the set before it only: 80 pairs stand for the 600 steps
    pairs = F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(bit[f]).alias("own"), F.lit(before).alias("before")) for f in FILTERS for before in range(32) if not before & bit[f]))
    r = counts.select("part", "failed", "n", "good", "toxic", F.explode(pairs).alias("s")).select("part", "failed", "n", "good", "toxic", "s.*")
    fails, earlier = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda condition, x="n": F.sum(F.when(condition, F.col(x)).otherwise(0))
    # of the orders of m failed filters, one in m has this one first
    turns = F.when(fails, F.lit(120) / F.bit_count("failed")).otherwise(0).cast("long")
    sums = r.groupBy("part", "filter", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(F.col("n") * turns).alias("shapley"),
    )
    steps = [("".join(o), k + 1, o[k], sum(bit[x] for x in o[:k])) for o in itertools.permutations(FILTERS) for k in range(5)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    return sums.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS f FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS t FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > f, false)] AS fails, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(t), 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ix FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, step, ix[step] AS me, ix[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, me, fails[me] AS own, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda z: z)) AS many, n, good, toxic FROM m, s),
g AS (SELECT part, filter_order, step, me, 'ABCDE'[me] AS filter, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g
"""


def op12(spark, sf_dir: str) -> DataFrame:
    """The contract's counts for all of documents and labels."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
