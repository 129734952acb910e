"""Tables in the folder that the whole cluster shares: they cut lineage, and lost executors don't lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, the folder made where the setting is unset.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all is on one machine (tests), a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
