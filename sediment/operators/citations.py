"""Citations of an answer: grouped by file, with merged lines and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.segments import Segments


def merge_ranges(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """(group, start, end): ranges of a group that overlap or touch (10-20, 21-30) are one."""
    parts = Segments(rows, group, [start, end])
    marked = parts.scan(maxima={"_before": F.col(end)}, before=True)
    marked = parts.kept(marked.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + 1), 1).otherwise(0)))
    island = parts.scan(marked, sums={"_island": F.col("_new")})
    return island.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def page_ranges(rows: DataFrame, group: list[str], page: str) -> DataFrame:
    """(group, pages): distinct pages as text, such as 1-3, 7."""
    one = Segments(rows.select(*group, page).distinct(), group, [page])
    runs = one.scan(sums={"_n": F.lit(1)}).withColumn("_run", F.col(page) - F.col("_n"))
    runs = runs.groupBy(*group, "_run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"])
    return runs.groupBy(*group).agg(F.array_join(parts, ", ").alias("pages"))


def by_file(rows: DataFrame, file: str, page: str, score: str, direct: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per file: chunks, sorted distinct pages, best score of scored rows, whether any was read directly.

    With start and end also lines, the merged ranges (start, end) of the rows that have a start; a missing end is the start.
    """
    files = rows.groupBy(file).agg(F.count("*").alias("chunks"), F.sort_array(F.collect_set(page)).alias("pages"), F.max(score).alias("best"), F.bool_or(direct).alias("direct"))
    if start is None:
        return files
    found = rows.where(F.col(start).isNotNull()).select(F.col(file).alias("_file"), F.col(start).alias("start"), F.coalesce(end, start).alias("end"))
    lines = merge_ranges(found, ["_file"], "start", "end").groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("lines"))
    files = files.join(lines, F.col(file).eqNullSafe(F.col("_file")), "left").drop("_file")
    return files.withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<start: bigint, end: bigint>>")))
