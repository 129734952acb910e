"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

One scan turns every text into a short vector of statistics. Means and covariances of the two classes are sums over all
labelled rows, taken in a grouped aggregate of fixed width; the covariances are shrunk towards the pooled one and that
towards a multiple of the identity. A score is the posterior of class 1 from the Mahalanobis log-density difference,
with each class's inverse Cholesky factor computed once and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialise, prefix_hash, require, span_hash, text_chunks, word_spans

STATISTICS = ("word_length", "spread", "upper", "digits", "marks", "odd_marks", "line_ends", "distinct", "top_word", "pairs", "short", "marked_words", "lone_marks", "after_same")
#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.05, 0.02
#: Words or bytes with usual shares that every text's counts start from.
PRIOR = 20.0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text; all parts of an empty text are those of zero counts."""
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    starts, ends, first = word_spans(data, offsets)
    n = np.diff(first).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(first))
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(doc, x, docs)
    low = lower_ascii(data)
    word = span_hash(prefix_hash(low), starts, ends)
    order = np.lexsort((word, doc))
    new = np.ones(len(word), dtype=bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    distinct = np.bincount(doc[order][at], minlength=docs).astype(float)
    top = np.zeros(docs)
    np.maximum.at(top, doc[order][at], np.diff(np.append(at, len(word))))
    same_doc = doc[1:] == doc[:-1]
    pair = (word[1:] * np.uint64(3) + word[:-1])[same_doc]
    pair_doc = doc[1:][same_doc]
    order = np.lexsort((pair, pair_doc))
    fresh = np.ones(len(pair), dtype=bool)
    fresh[1:] = (pair[order][1:] != pair[order][:-1]) | (pair_doc[order][1:] != pair_doc[order][:-1])
    pairs = np.bincount(pair_doc, minlength=docs).astype(float)
    distinct_pairs = np.bincount(pair_doc[order][fresh], minlength=docs).astype(float)
    again = np.bincount(doc[1:], (word[1:] == word[:-1]) & same_doc, docs) if len(word) else np.zeros(docs)
    alpha = ((low >= 97) & (low <= 122)) | (low >= 128)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(alpha | digit | space)
    odd = mark & ~np.isin(data, np.frombuffer(b".,;:'\"-()?", dtype=np.uint8))
    letters = count(alpha)
    ends_odd = odd[ends - 1].astype(float) if len(ends) else np.zeros(0)
    lone = (mark[starts] & (length == 1)).astype(float) if len(starts) else np.zeros(0)
    # short texts have little to tell: counts start from PRIOR words or bytes with usual shares
    mean = (per(length) + 5 * PRIOR) / (n + PRIOR)
    var = np.maximum((per(length**2) + 35 * PRIOR) / (n + PRIOR) - mean**2, 0)
    share = lambda a, b, usual: np.log((a + PRIOR * usual + 0.02) / (b + PRIOR))
    return np.stack(
        [
            np.log(mean), np.log1p(np.sqrt(var)), share(count(upper), letters, 0.03), share(count(digit), size, 0.003), share(count(mark), size, 0.03), share(count(odd), size, 0.002),
            share(count(data == 10), n, 0.03), share(n - distinct, n, 0.3), share(top, n, 0.06), share(pairs - distinct_pairs, pairs, 0.03), share(per((length <= 3).astype(float)), n, 0.4), share(per(ends_odd), n, 0.002), share(per(lone), n, 0.002), share(again, n, 0.01),
        ],
        axis=1,
    )


def describe(documents: DataFrame) -> DataFrame:
    """doc_id and ``x`` (array of statistics) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                x = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), flat], ["doc_id", "x"])

    require(documents, "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


class Discriminant:
    """Class means, inverse Cholesky factors and log terms, over standardised statistics."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        d = sums.shape[1]
        total = max(1.0, counts.sum())
        self.prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
        self.center = sums.sum(axis=0) / total
        var = np.diagonal(squares.sum(axis=0)) / total - self.center**2
        self.scale = np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-12)), 1.0)
        means, covs = [], []
        for y in (0, 1):
            m = sums[y] / max(1.0, counts[y])
            c = squares[y] / max(1.0, counts[y]) - np.outer(m, m)
            means.append((m - self.center) / self.scale)
            covs.append(c / np.outer(self.scale, self.scale))
        pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / total
        self.usable = bool(counts.min() > 1)
        self.means, self.inverse, self.log_det = means, [], []
        for y in (0, 1):
            trust = counts[y] / (counts[y] + 2.0 * d)  # few rows lean on the pooled covariance
            c = trust * ((1 - POOLED) * covs[y] + POOLED * pooled) + (1 - trust) * pooled
            c = (1 - IDENTITY) * c + IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
            lower = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(lower))
            self.log_det.append(2 * float(np.log(np.diagonal(lower)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1; the prior's where a class has no two labelled rows."""
        if not self.usable:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = (x - self.center) / self.scale
        part = [-0.5 * ((((z - m) @ inv.T) ** 2).sum(axis=1) + det) for m, inv, det in zip(self.means, self.inverse, self.log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip(part[1] - part[0] + self.prior, -500, 500)))


def train(described: DataFrame, labels: DataFrame, fold: int = 5, left_out: int = 0) -> Discriminant:
    """Fit on all labelled rows whose crc32(doc_id as text) mod ``fold`` is not ``left_out``; null labels don't count."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).where("l_id is not null and y in (0, 1)").groupBy("l_id").agg(F.min("y").alias("y"))
    known = known.where(F.crc32(F.col("l_id").cast("string")) % fold != left_out)
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    rows = described.join(known, F.col("doc_id") == F.col("l_id")).select("x", "y")
    sums = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # as many rows as the model has sums
        sums[r["at"]] = r["v"]
    sums = sums.reshape(2, -1)
    return Discriminant(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every described text."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return described.mapInArrow(run, described.select("doc_id").schema.add("score", "double"))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 at the threshold or above).

    Whole texts count. Null and empty texts are scored as texts without words; rows with a null doc_id are scored too
    and are never held out. Repeated rows come out as often as they are there; other columns are ignored.
    """
    described = materialise(describe(documents), "statistics")
    scored = score(described, train(described, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's scores for every whole text of documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
