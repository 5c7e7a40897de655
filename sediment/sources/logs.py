"""Line sources: usage logs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_usage_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, app, model, ok): three fields between pipes; a line of another form, or without a time, has ok false."""
    parts = F.split(F.regexp_replace(column, r"\r$", ""), r"\|")
    ts = F.try_to_timestamp(F.trim(F.try_element_at(parts, F.lit(1))))
    out = lines.where(F.trim(column) != "").select(ts.alias("ts"), F.trim(F.try_element_at(parts, F.lit(2))).alias("app"), F.trim(F.try_element_at(parts, F.lit(3))).alias("model"), (F.size(parts) == 3).alias("three"))
    return out.withColumn("ok", F.col("three") & F.col("ts").isNotNull()).drop("three")


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_usage_lines(spark.read.text(path))


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("ok")).alias("bad"), F.count("*").alias("lines"))


def parse_metrics(lines: DataFrame, column: str = "value", order: str = "line") -> DataFrame:
    """(name, value): the first value of each metric of a text exposition; comments are left out."""
    out = lines.where(~F.col(column).startswith("#")).select(
        F.regexp_extract(column, r"^([A-Za-z_:][\w:]*)", 1).alias("name"), F.regexp_extract(column, r"\s(\S+)(?:\s+\d+)?$", 1).try_cast("double").alias("value"), order
    )
    first = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return out.where("name <> '' and value is not null").withColumn("_n", first).where("_n = 1").select("name", "value")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
