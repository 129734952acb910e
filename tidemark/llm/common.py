"""Shared helpers of the training-data operators: Arrow text chunks, rolling hashes, word spans, shared tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at a time; a longer document is a step of its own.
CHUNK_BYTES = 512 << 10
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}
#: By application, the folder made where the setting is unset.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset and all is on one machine (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.tidemark_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n, kept by the worker."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of data[i:j] times BASE**i (see ``span_hash``)."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes get equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, by document, first word number of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a document."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = ~gap
    first[1:] &= gap[:-1] | cut[1:-1]
    last = ~gap
    last[:-1] &= gap[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a batch with their UTF-8 bytes in one array and offsets into it; null texts are empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    if not n:
        return
    ends = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as numpy."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def require(df: DataFrame, *names: str) -> None:
    """Raise ValueError if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
