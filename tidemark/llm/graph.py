"""Connected components over edges that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Edges that a task joins up at a time before they are shuffled.
HELD = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches over them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[x] != label[y])):
        u, v = label[x[open_]], label[y[open_]]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: those that a task reads become stars around their smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            nodes, root = roots(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            own = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(a) for a, _ in held) > HELD:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, component): the smallest node that each node reaches. Nodes without edges are not there.

    Each task joins up the edges that it reads; large-star and small-star steps in turn then hang the neighbours of a
    node on the smallest one it knows, so stars form in a logarithmic number of steps. Each step is a grouped minimum
    (combined before the shuffle) and a join back; its result is written to the shared folder, and a count of the nodes
    that have two parents, or a parent and a child, tells when only stars are left.
    """
    norm = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def unfinished(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionAll(df.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
        return ends.agg(F.count_if((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("children") > 0)))).first()[0] > 0

    now = materialise(norm(contracted(edges)), "edges")
    while unfinished(now):
        now = contracted(now)
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first: joined straight away, its partitioning would keep Spark from splitting a hub's neighbours
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = norm(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))  # larger neighbours hang on m
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # a and its smaller neighbours hang on m
        now = materialise(norm(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
