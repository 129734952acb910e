"""Near-duplicate documents by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

Documents with the same shingle set form one class with one representative. Representatives are posted under their
(coordinate, value) pairs. Two of them with a similarity at the threshold agree on at least ``matches_at`` coordinates but
for a chance of at most one in a million, so they share a pair among the ``COORDINATES - matches + 1`` rarest of each
(prefix filter); pairs that only one document has are skipped. A posting list isn't expanded into all its pairs: its
members are first compared with a pivot, the collision count deciding before the sets do. Lists whose members are in
different components after that are open. Their members, joined by open lists into families, are compared among
themselves in blocks on their full sets, and components that meet are reported rather than links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import M1, lower_ascii, materialise, mix, prefix_hash, require, span_hash, text_chunks, word_spans
from tidemark.llm.graph import components

COORDINATES = 48
#: Chance, at most, that two documents at the threshold agree on fewer coordinates than asked for.
MISSED = 1e-6
#: Members of a family that one block of the exhaustive comparison holds; elements in up to RARE sets are met pair by pair.
BLOCK, RARE = 1024, 8
_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def matches_at(num: int, den: int) -> int:
    """The most coordinates that two documents of similarity num / den agree on but for a chance of MISSED."""
    s, below = num / den, 0.0
    for m in range(COORDINATES + 1):
        below += math.comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)
        if below > MISSED:
            if not m:
                break
            return m
    raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {num} / {den}")


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, with repeats, and the document offsets into them.

    A document of fewer words has its whole sequence as one shingle, one without words has none.
    """
    starts, ends, first = word_spans(lower_ascii(data), offsets)
    words = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out[-1]) - np.repeat(out[:-1], n) + np.repeat(first[:-1], n)
    room = np.repeat(np.minimum(n_words, k), n)
    h = room.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    for i in range(k):
        step = mix(h * M1 + padded[at + i])
        h = np.where(room > i, step, h)
    return h, out


def signatures(documents: DataFrame, k: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, set fingerprint (fp1, fp2) and the signature, 4 bytes a coordinate (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                h, at = shingles(data, offsets, k)
                full = np.flatnonzero(np.diff(at))
                sig = np.zeros((COORDINATES, len(full)), dtype=np.uint32)
                if len(full):
                    for c in range(COORDINATES):
                        sig[c] = np.minimum.reduceat(((h ^ _XOR[c]) * _MUL[c]) >> np.uint64(32), at[full])
                sig = np.ascontiguousarray(sig.T)
                n, fp1, fp2 = (np.zeros(hi - lo, dtype=np.int64) for _ in range(3))
                blobs: list[bytes | None] = [None] * (hi - lo)
                for j, d in enumerate(full):
                    own = np.unique(h[at[d] : at[d + 1]])
                    n[d] = len(own)
                    fp1[d] = own.sum(dtype=np.uint64).astype(np.int64)
                    fp2[d] = np.bitwise_xor.reduce(mix(own)).astype(np.int64)
                    blobs[d] = sig[j].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(fp1), pa.array(fp2), pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """(key, doc): a representative under each of the rarest shared (coordinate, value) pairs that its prefix holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
                key = (sig.astype(np.uint64) | lanes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), COORDINATES))], ["key", "doc"])

    every = reps.select("rep", "sig").mapInArrow(run, "key long, doc long")
    shared = materialise(every.groupBy("key").count().where("count > 1"), "shared-pairs")
    held = every.join(shared, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("held"))
    # the coordinates that nobody shares come first in the prefix
    prefix = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("held"))))
    return held.select("doc", F.explode(prefix).alias("p")).select(F.col("p.key").alias("key"), "doc")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
            out = []
            for _, _, data, offsets in text_chunks(batch, name):
                h, at = shingles(data, offsets, k)
                out += [np.unique(h[at[d] : at[d + 1]]) for d in range(len(offsets) - 1)]
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keep = []
                for x, y in zip(sets(part, "text_a"), sets(part, "text_b"), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(len(x)) and den * common >= num * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def meeting(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets: rare elements by their few pairs, frequent ones by a matrix product."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((m, m), dtype=np.float32)
    for c in range(2, RARE + 1):
        at = first[:-1][counts == c]
        if len(at):
            group = owner[order[at[:, None] + np.arange(c)]]
            for i in range(c):
                for j in range(i):
                    np.add.at(out, (group[:, i], group[:, j]), 1)
    out += out.T
    often = np.flatnonzero(counts > RARE)
    column = np.full(len(counts), -1)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        column[part] = np.arange(len(part))
        use = np.flatnonzero(column[inverse] >= 0)
        grid = np.zeros((m, len(part)), dtype=np.float32)
        grid[owner[use], column[inverse[use]]] = 1
        out += grid @ grid.T
        column[part] = -1
    return out


def joined_components(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between components that a link of members of one family joins; members: family, doc, component, text.

    A family is cut into blocks of about BLOCK members, and each pair of blocks is a group of its own, so that no task
    holds a whole family. All members of the two blocks are compared on their full sets, and what comes out are
    components that are now one, at most as many rows as members, not links.
    """
    sizes = materialise(members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "families")
    member = members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).where("lo < hi or nb = 1")

    def run(group: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        component = group.column("component").to_numpy()
        names, comp = np.unique(component, return_inverse=True)
        if len(names) < 2:
            return none
        sets = []
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for _, _, data, offsets in text_chunks(batch):
                h, at = shingles(data, offsets, k)
                sets += [np.unique(h[at[d] : at[d + 1]]) for d in range(len(offsets) - 1)]
        n = np.array([len(x) for x in sets], dtype=np.float32)
        common = meeting(sets)
        linked = den * common >= num * (n[:, None] + n[None, :] - common)
        label = np.arange(len(names))
        while True:
            new = np.where(linked, label[comp][None, :], len(names)).min(axis=1)
            best = label.copy()
            np.minimum.at(best, comp, new)
            best = best[best]
            if (best == label).all():
                break
            label = best
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[moved]), "b": pa.array(names[label[moved]])})

    return spread.select("family", "lo", "hi", "component", "text").groupBy("family", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; documents link where den * |A and B| >= num * |A or B| of
    their distinct k-word shingles. Null, empty and blank texts have no shingles and link with nothing. A null doc_id
    links with nothing and has a null component. Rows that share a doc_id are one node. Other columns are ignored.
    """
    require(documents, "doc_id", "text")
    matches = matches_at(num, den)
    rows = materialise(signatures(documents, k), "signatures")
    rep_key = ["fp1", "fp2", "n_shingles"]
    reps = materialise(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*rep_key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    lists = materialise(postings(reps, matches), "postings")
    twice = materialise(lists.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top")).where("pivot <> top"), "pivots")
    linked = twice.join(lists, "key").select("doc").distinct()
    texts = materialise(linked.join(documents.select(F.col("doc_id").alias("doc"), "text"), "doc").withColumnRenamed("doc", "rep"), "texts")
    lists = lists.join(twice.select("key"), "key")
    pairs = twice.select("key", "pivot").join(lists, "key").where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = materialise(confirm(by_collisions(pairs, reps, num, den, matches), texts, k, num, den), "links")
    comps = materialise(components(edges), "components")

    here = lists.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = materialise(here.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("doc").alias("first")).where("c0 <> c1").select("key", "first"), "open-lists")
    left = materialise(here.join(mixed, "key").select("doc", "component", "first").distinct(), "open-members")
    family = components(left.select(F.col("doc").alias("a"), F.col("first").alias("b"))).withColumnsRenamed({"node": "doc", "component": "family"})
    members = left.select("doc", "component").distinct().join(family, "doc").join(texts.withColumnRenamed("rep", "doc"), "doc")
    more = joined_components(members, k, num, den)
    comps = materialise(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")
    ids = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*rep_key, F.coalesce("component", "rep").alias("component"))
    out = rows.drop("sig").join(ids, rep_key, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def by_collisions(pairs: DataFrame, reps: DataFrame, num: int, den: int, matches: int) -> DataFrame:
    """The pairs (a, b) that agree on ``matches`` coordinates and whose set sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= matches))

    one = lambda c: reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(F.lit(num) * F.greatest("n_a", "n_b") <= F.lit(den) * F.least("n_a", "n_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def one_of_each(documents: DataFrame, k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """The documents, with all their columns, of which one for each near-duplicate component stays: its smallest doc_id.

    Of rows that share a doc_id and a text one stays. Rows with a null doc_id link with nothing, so all of them stay.
    """
    found = materialise(near_duplicates(documents, k, num, den).select("doc_id", "kept"), "kept")
    drop = found.where("not kept").select("doc_id").distinct().alias("gone")
    kept = documents.alias("own").join(drop, F.col("own.doc_id") == F.col("gone.doc_id"), "left_anti")
    again = materialise(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    same = F.col("own.doc_id") == F.col("again.doc_id")
    once = kept.alias("own").join(again.alias("again"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.alias("own").join(again.alias("again"), same, "left_anti").unionAll(once)


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's classes over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM pair JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM doc UNION SELECT b, root FROM reach JOIN edge ON a = node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN n USING (doc_id) JOIN comp ON node = doc_id
"""
