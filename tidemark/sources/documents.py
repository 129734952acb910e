"""Nested JSON documents as (path, value) rows, and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import written

STEP = "struct<key: string, pos: int>"
#: Levels of nesting that one pass opens.
LEVELS = 4


def document_rows(docs: DataFrame, id: str, column: str) -> DataFrame:
    """id, path and value (as JSON) of every leaf of each document.

    A path is an array of steps: a key of an object, or with a null key a position in an array. Empty objects and arrays
    are leaves; a document that is one value has an empty path. Null documents and texts that aren't JSON give no rows.
    Documents may be nested to any depth: a pass opens LEVELS levels of what is still nested, and the rows of all are united.
    """
    # no filter for documents that are null: it would parse each a second time; their value and _inner are null
    level = docs.select(F.col(id).alias("_id"), F.expr(f"CAST(array() AS array<{STEP}>)").alias("_path"), F.try_parse_json(F.col(column)).alias("_v"))
    done = []
    while True:
        for _ in range(LEVELS):
            level = opened(level)
        rows = level.select(F.col("_id").alias(id), F.col("_path").alias("path"), F.to_json("_v").alias("value"))
        rows = written(rows.withColumn("_inner", F.col("value").rlike(r"^[\[{]") & ~F.col("value").isin("{}", "[]")), "level")
        done.append(rows.where("NOT _inner").select(id, "path", "value"))
        deeper = rows.where("_inner")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level = deeper.select(F.col(id).alias("_id"), F.col("path").alias("_path"), F.parse_json("value").alias("_v"))


def opened(level: DataFrame) -> DataFrame:
    """A row for each element of ``_v`` that is an object or array with something in it, with its step at the path's end; other rows as they are."""
    items = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    step = F.struct(F.col("key").alias("key"), F.when(F.col("key").isNull(), F.col("pos")).cast("int").alias("pos"))
    leaf = F.col("pos").isNull()
    return items.select("_id", F.when(leaf, F.col("_path")).otherwise(F.concat("_path", F.array(step))).alias("_path"), F.when(leaf, F.col("_v")).otherwise(F.col("value")).alias("_v"))


def put_together(leaves: list[tuple[tuple, str]]) -> list[str]:
    """The documents (one, for an id that isn't repeated) of (path, value) leaves, from the deepest level up; a path is (key, position) pairs."""
    levels: dict[int, list[tuple[tuple, str]]] = {}
    for path, value in leaves:
        levels.setdefault(len(path), []).append((path, value))
    for n in range(max(levels), 0, -1):
        groups: dict[tuple, list[tuple]] = {}
        for path, value in levels.get(n, ()):
            key, pos = path[-1]
            groups.setdefault(path[:-1], []).append((key is not None, key or "", pos or 0, value))
        for path, entries in groups.items():
            entries.sort()
            text = ",".join(f"{quoted(key)}:{value}" if named else value for named, key, _, value in entries)
            levels.setdefault(n - 1, []).append((path, f"{{{text}}}" if entries[0][0] else f"[{text}]"))
    return [value for _, value in levels[0]]


@lru_cache(100_000)
def quoted(key: str) -> str:
    """A key as JSON text, written as Spark does."""
    text = json.dumps(key, ensure_ascii=False)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\u00(..)", lambda m: f"{m[1]}\\u00{m[2].upper()}", text) if "\\u" in text else text


def documents_from(rows: DataFrame, id: str) -> DataFrame:
    """id and document of ``document_rows``; keys in the order of their bytes, as Spark writes variants.

    The leaves of a document are dealt to one task, as it is one value in the end.
    """
    schema = T.StructType([rows.schema[id], T.StructField("document", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column("leaves")
            ends, flat = leaves.offsets.to_pylist(), leaves.values
            paths, values = flat.field("path"), flat.field("value").to_pylist()
            steps, at = list(zip(*(paths.values.field(c).to_pylist() for c in ("key", "pos")), strict=True)), paths.offsets.to_pylist()
            own, out = [], []
            for i in range(batch.num_rows):
                new = put_together([(tuple(steps[at[k] : at[k + 1]]), values[k]) for k in range(ends[i], ends[i + 1])])
                own += [i] * len(new)
                out += new
            yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(own, pa.int64())), pa.array(out, pa.string())], [id, "document"])

    each = rows.groupBy(id).agg(F.collect_list(F.struct("path", "value")).alias("leaves"))
    return each.mapInArrow(run, schema)
