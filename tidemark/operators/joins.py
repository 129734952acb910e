"""As-of and interval joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], strict: bool = False, bucket: str = "day") -> DataFrame:
    """The right row with the largest time at or before (``strict``: before) each left row's, as columns r_<name> (nulls if none).

    Both sides become one timeline. The last right row is carried forward inside (key, bucket), and over buckets by one row a
    bucket, so a key with most of the rows is spread over its buckets.
    """
    held = F.struct(F.col(ts).alias("_t"), *(F.col(v) for v in values))
    r = right.select(key, F.col(ts).alias("_ts"), held.alias("_r"), F.lit(0).alias("_o"))
    side = 0 if strict else 1  # a strict search stands before right rows of the same time
    order = r.withColumn("_o", F.lit(1 - side)).withColumn("_l", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    mine = left.select(key, F.col(ts).alias("_ts"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(side).alias("_o"), F.struct("*").alias("_l"))
    line = order.unionByName(mine).withColumn("_b", F.date_trunc(bucket, "_ts"))
    near = line.withColumn("_n", F.last("_r", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy("_ts", "_o").rowsBetween(Window.unboundedPreceding, 0)))
    last = line.where("_r is not null").groupBy(key, "_b").agg(F.max("_r").alias("_m"))
    days = line.select(key, "_b").distinct().join(last, [key, "_b"], "left")
    far = days.withColumn("_f", F.last("_m", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    found = near.where("_l is not null").join(far, [key, "_b"]).withColumn("_x", F.coalesce("_n", "_f"))
    return found.select("_l.*", F.col("_x._t").alias(f"r_{ts}"), *(F.col(f"_x.{v}").alias(f"r_{v}") for v in values))


def interval(points: DataFrame, spans: DataFrame, key: str, ts: str, begin: str, end: str, seconds: int) -> DataFrame:
    """Points inside [begin, end) of the spans of their key: spans are listed under every bucket of ``seconds`` they touch, then it is an equi-join."""
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    s = spans.where(F.col(begin) < F.col(end)).withColumn("_c", F.explode(F.sequence(cell(begin), F.floor((F.unix_seconds(F.col(end).cast("timestamp")) - F.lit(1)) / seconds)))).withColumnRenamed(key, "_k")
    p = points.withColumn("_pc", cell(ts))
    return p.join(s, (F.col(key) == F.col("_k")) & (F.col("_pc") == F.col("_c"))).where((F.col(ts) >= F.col(begin)) & (F.col(ts) < F.col(end))).drop("_k", "_c", "_pc")
