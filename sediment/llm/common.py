"""Helpers that several operators share: work tables, row ids of texts, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work folders made by each thread, for remove_work_folders.
_MADE = threading.local()


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and Spark runs in one process (tests, a laptop) a local folder is
    made and set; on a cluster its absence is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sediment-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/sediment-{uuid.uuid4().hex}"
    _MADE.folders = [*work_folders(), folder]
    return folder


def work_folders() -> list[str]:
    """The work folders that this thread has made and not removed."""
    return getattr(_MADE, "folders", [])


def remove_work_folders(spark: SparkSession, keep: list[str]) -> None:
    """Delete the work folders of this thread but for those to keep; what still reads the others must have been stored before."""
    for folder in set(work_folders()).difference(keep):
        forget(spark, *folder.rsplit("/", 1))
    _MADE.folders = [f for f in work_folders() if f in keep]


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of a work folder that nothing reads any more."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the work folder and read it back: cuts lineage and survives lost executors."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def sliced(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows: a whole batch of texts as Python values would fill a worker's memory."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def crc_remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def plain_name(df: DataFrame, added: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (an added column replaces a clashing one)."""
    return df.drop(*[c for c in df.columns if c.lower() in {a.lower() for a in added}])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, folder: str, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), by alternating large and small stars.

    Only nodes that have an edge are returned. Each round is written to the work folder, so the
    plan stays short and a lost executor costs one round. Minima are aggregated before the shuffle
    and stored: Spark splits the join of a hub with its minimum only where both sides come
    straight from a shuffle.
    """
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    current = materialize(current, folder, "cc-start")
    for n in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), folder, f"cc-{n}-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, folder, f"cc-{n}-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"cc-{n}-least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), folder, f"cc-{n}")
        # Settled: separate stars, in which no child is a parent and none has two parents.
        ends = current.select(F.col("u").alias("node"), F.lit(1).alias("child")).unionByName(current.select(F.col("v").alias("node"), F.lit(0).alias("child")))
        met = ends.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("alone"))
        if met.where("parents > 1 or (parents = 1 and alone = 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
