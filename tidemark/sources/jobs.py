"""An incremental list of jobs: parts that are there already are skipped, and a part is there when its manifest row is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, run string, n long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, run and n of every part that is there; of parts that two runs wrote at once, one."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows.groupBy("part").agg(F.min_by(F.struct("run", "n"), "run").alias("r")).select("part", "r.*")


def pending(wanted: DataFrame, path: str) -> DataFrame:
    """The wanted parts (column part) that aren't there."""
    return wanted.select("part").distinct().join(manifest(wanted.sparkSession, path), "part", "left_anti")


def run_jobs(wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Fetch and keep the parts that aren't there yet; how many were kept.

    ``fetch`` makes rows with a column part from the pending parts. They are written in a folder of this run; only when all
    is written, the manifest gets their rows, so what a lost run leaves behind is never read, and the next one fetches it.
    Parts without rows stay pending, as do parts that ``fetch`` leaves out.
    """
    spark = wanted.sparkSession
    left = pending(wanted, path)
    if left.isEmpty():
        return 0
    run = uuid.uuid4().hex
    fetch(left).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "part").parquet(f"{path}/data")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/run={run}").groupBy(F.col("part").cast("string").alias("part")).agg(F.count("*").alias("n"))
    done = rows.select("part", F.lit(run).alias("run"), "n")
    done.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # a row a part
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("run") == run).count()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts that are there; other folders' rows are pruned or joined away."""
    data = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/data").withColumn("part", F.col("part").cast("string"))
    return data.join(manifest(spark, path).select("part", "run"), ["part", "run"], "left_semi").drop("run")
