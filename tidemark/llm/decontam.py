"""Benchmark decontamination by a broadcast hash set of normalised word windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The window set is broadcast up to this many windows (about 150 bytes each), and joined by a shuffle beyond it.
MAX_BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else; no words for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() agrees with the translation where every character is ASCII, and is much cheaper
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows ``win`` (array of words) with length ``len``, ``hash`` and the sorted ``items`` that hold them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    return (
        words.select("item", length.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("win"))
        .groupBy("win", "len")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("hash", F.xxhash64("win"))
    )


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document word window that is an item window: doc_id, text_key, pos (from 1), len, items.

    Besides, each document has one row with pos 0, len 0, no items and its ``n_words``. The window set is counted
    first: up to ``max_broadcast`` windows are broadcast and hits verified word by word in the scan; a larger set
    meets the window hashes in a shuffled join and hits are verified against the document afterwards.
    """
    require(documents, "doc_id", "text")
    require(benchmark, "item_id", "text")
    windows = item_windows(benchmark, n).persist()
    stats = windows.groupBy("len").count().collect()  # at most n rows
    lengths = sorted(r["len"] for r in stats)
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))

    # positions and lengths are exploded as plain numbers and hashed after that, all inside generated code; position 0
    # with length 0 is the row that every document needs, so that it comes out of the same scan
    at = docs.select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("pos"))
    if lengths != [n]:
        at = at.withColumn("k", F.explode(F.array(*map(F.lit, lengths or [n])))).where(f"pos > 0 or k = {(lengths or [n])[0]}")
    else:
        at = at.withColumn("k", F.lit(n))
    at = at.where("pos = 0 or pos + k - 1 <= size(words)")
    window = F.slice("words", F.greatest("pos", F.lit(1)), F.col("k"))
    each = at.select("doc_id", "text_key", "words", "pos", F.when(F.col("pos") == 0, 0).otherwise(F.col("k")).alias("len"), F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(window)).alias("hash"))
    keep = ["doc_id", "text_key", "pos", "len", "items", F.when(F.col("pos") == 0, F.size("words")).alias("n_words")]
    every = windows.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("win"), F.lit(0).alias("len"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("hash"))
    known = windows.select("win", "len", "items", "hash").unionByName(every).withColumnsRenamed({"hash": "k_hash", "len": "k_len"})
    same = (F.col("hash") == F.col("k_hash")) & (F.col("len") == F.col("k_len"))
    if sum(r["count"] for r in stats) <= max_broadcast:
        found = each.join(F.broadcast(known), same & ((F.col("pos") == 0) | (F.slice("words", F.greatest("pos", F.lit(1)), F.col("len")) == F.col("win"))))
        return found.select(*keep)
    base = docs.select("doc_id", "text_key", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("array<string>").alias("items"), F.size("words").alias("n_words"))
    near = each.where("pos > 0").drop("words").join(known, same).select("doc_id", "text_key", "pos", "len", "win", "items")
    texts = docs.dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "d_id", "text_key": "d_key"})
    near = near.join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key")))
    near = near.where(F.slice("words", F.col("pos"), F.col("len")) == F.col("win"))
    return base.unionByName(near.select("doc_id", "text_key", "pos", "len", "items", F.lit(None).cast("int").alias("n_words")))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, items (sorted), spans (hit word positions), contaminated.

    A null text, or one without words, has n_words 0 and no hits. A null benchmark text gives no window, a null item
    id hits but isn't listed. Repeated rows are documents of their own and each comes out. Other columns are ignored.
    """
    hits = find_hits(documents, benchmark, n, max_broadcast)
    span = F.when(F.col("pos") > 0, F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))
    grouped = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(span)))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    one = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_hit = F.size("spans").cast("long")
    return one.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "items", "spans", (n_hit > 0).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    hit = find_hits(documents, benchmark, n).where("pos > 0").select("doc_id", "text_key").distinct().alias("hit")
    on = F.col("own.doc_id").eqNullSafe(F.col("hit.doc_id")) & (F.xxhash64("own.text") == F.col("hit.text_key"))
    return documents.alias("own").join(hit, on, "left_anti")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``contamination`` over documents and benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), hit AS (
  SELECT doc_id, i, l.k, win.item FROM doc, (SELECT DISTINCT k FROM win) AS l, unnest(range(1, len(w) - l.k + 2)) AS r(i)
  JOIN win ON win.k = l.k AND win.win = array_to_string(w[i:i + l.k - 1], ' ')
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""
