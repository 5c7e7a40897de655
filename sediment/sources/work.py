"""Work tables below spark.checkpoint.dir, the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """The shared folder. One process alone (tests, a laptop) may go without the setting; a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sediment-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once and read back: it is not computed again, and a lost executor takes nothing with it."""
    path = f"{work_root(df.sparkSession)}/sediment-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
