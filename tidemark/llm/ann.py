"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors again in float, heaps."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require

#: Vectors of a candidate block and of a query block; a tile of products has one of each.
CANDIDATES, QUERIES = 4096, 1024
#: Pairs whose distance one step computes in float.
PAIRS = 200_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and dim of the rows whose vector is not null, not zero and has finite components only."""
    require(vectors, "vec_id", "embedding")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(fine).withColumn("dim", F.size("v"))


def quantised(x: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """x as multiples of ``step`` from -127 to 127, and how far each row is from that (Euclidean)."""
    q = np.clip(np.rint(x / step), -127, 127)
    return q.astype(np.int8), np.sqrt(((x - q * step) ** 2).sum(axis=1))


def nearest_in_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest of the tile's candidates, as sorted (distance, id)."""
    step = max(float(np.abs(q).max()), float(np.abs(c).max())) / 127
    q8, q_off = quantised(q, step)
    c8, c_off = quantised(c, step)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds every int8 product sum exactly
    product = q8.astype(exact) @ c8.astype(exact).T
    square = lambda x: (x.astype(np.float64) ** 2).sum(axis=1)
    about = step * np.sqrt(np.maximum(square(q8)[:, None] + square(c8)[None, :] - 2 * product.astype(np.float64), 0))
    slack = (q_off[:, None] + c_off[None, :]) * (1 + 1e-9) + about * 1e-9
    own = q_ids[:, None] == c_ids[None, :]
    upper = np.where(own, np.inf, about + slack)
    bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q), np.inf)
    qi, ci = np.nonzero((about - slack <= bound[:, None]) & ~own)
    found: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for lo in range(0, len(qi), PAIRS):
        a, b = qi[lo : lo + PAIRS], ci[lo : lo + PAIRS]
        total = np.zeros(len(a))
        for j in range(q.shape[1]):  # component by component: one order of summation everywhere
            total += (q[a, j] - c[b, j]) ** 2
        for i, d, n in zip(a.tolist(), np.sqrt(total).tolist(), c_ids[b].tolist(), strict=True):
            heap = found[i]  # the worst of the k best is on top
            if len(heap) < k:
                heapq.heappush(heap, (-d, -n))
            elif (-d, -n) > heap[0]:
                heapq.heapreplace(heap, (-d, -n))
    return [sorted((-d, -n) for d, n in heap) for heap in found]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest candidates.

    Every usable candidate but those with the query's own vec_id is compared: the result is exact. Fewer than k
    candidates give fewer rows; ties go to the smaller vec_id. Rows whose vector is null, zero or holds null or
    non-finite components take no part, nor do pairs of different dimension. A vec_id that is there twice among the
    queries is asked once. Candidates and queries are dealt into blocks by a hash, and each pair of blocks is a group.
    """
    c, q = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_c, n_q = c.count(), q.count()
    blocks_c, blocks_q = max(1, -(-n_c // CANDIDATES)), max(1, -(-n_q // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.select("dim", block(blocks_c).alias("cb"), spread(blocks_q).alias("qb"), "vec_id", "v")
    q = q.select("dim", spread(blocks_c).alias("cb"), block(blocks_q).alias("qb"), "vec_id", "v")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores, asked = [], [], []
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
            q_ids = left.column("vec_id").to_numpy()
            for i, best in zip(q_ids.tolist(), nearest_in_tile(q_ids, matrix(left), right.column("vec_id").to_numpy(), matrix(right), k), strict=True):
                if best:
                    asked.append(i)
                    scores.append([d for d, _ in best])
                    ids.append([n for _, n in best])
        return pa.table({"query_id": pa.array(asked, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    def merge(group: pa.Table) -> pa.Table:
        lists = [list(zip(s, n, strict=True)) for s, n in zip(group.column("scores").to_pylist(), group.column("ids").to_pylist(), strict=True)]
        best = [x for _, x in zip(range(k), heapq.merge(*lists), strict=False)]
        return pa.table({
            "query_id": pa.array([group.column("query_id")[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([n for _, n in best], pa.int64()), "score": pa.array([d for d, _ in best], pa.float64()),
        })

    tiles = q.groupBy("dim", "cb", "qb").cogroup(c.groupBy("dim", "cb", "qb")).applyInArrow(tile, "query_id long, ids array<long>, scores array<double>")
    return tiles.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by 100 against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
