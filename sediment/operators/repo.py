"""Repository files: what is read, skipped and packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.select import pack_skip

#: Folders of dependencies and build results.
SKIPPED_FOLDERS = ["node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__", ".venv", "coverage", ".next"]
GENERATED = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock)$|\.min\.(js|css)$|\.map$"


def skipped_path(path: Column) -> Column:
    """A folder on the path is among the skipped ones (the file's own name does not count), or the file is generated."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS))) | path.rlike(GENERATED)


def is_binary(text: Column) -> Column:
    """A NUL among the first 8,192 characters, or over 5 % replacement characters there."""
    head = F.substring(text, 1, 8192)
    bad = F.length(head) - F.length(F.replace(head, F.lit("�"), F.lit("")))
    return F.coalesce((F.instr(head, "\0") > 0) | (bad > 0.05 * F.length(head)), F.lit(False))


def skip_reason(path: Column, text: Column, most_chars: int, language: Column | None = None) -> Column:
    """Why a file is left out, or null; with language, a file of no known language is left out too."""
    empty = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    reason = F.when(skipped_path(path), "path")
    if language is not None:
        reason = reason.when(language.isNull(), "language")
    return reason.when(empty, "empty").when(F.length(text) > most_chars, "large").when(is_binary(text), "binary")


def reading_order(path: str) -> list[Column]:
    """Shallow paths first, then by name."""
    return [F.size(F.split(path, "/")), F.col(path)]


def file_tree(files: DataFrame, path: str, most: int = 200) -> DataFrame:
    """The first `most` paths by name, and how many more there are, as a last line."""
    first = files.orderBy(path).limit(most).select(F.col(path).alias("line"), F.lit(0).alias("last"))
    more = files.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.concat(F.lit("and "), F.col("n").cast("string"), F.lit(" more")).alias("line"), F.lit(1).alias("last"))
    return first.unionByName(more).orderBy("last", "line").select("line")


def common_root(paths: DataFrame, path: str) -> DataFrame:
    """paths without the folder that all of them begin with, if there is one."""
    top = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))
    one = paths.agg(F.min(top).alias("a"), F.max(top).alias("b"), F.count_if(top.isNull()).alias("bare")).select(F.when((F.col("a") == F.col("b")) & (F.col("bare") == 0), F.concat("a", F.lit("/"))).otherwise("").alias("_root"))
    return paths.crossJoin(F.broadcast(one)).withColumn(path, F.expr(f"substring({path}, length(_root) + 1)")).drop("_root")


def pack_files(files: DataFrame, path: str, size: str, most_files: int, most_chars: int, repository: str = "repository") -> DataFrame:
    """files with used and reason: in reading order, those that the limits of their repository leave out have a reason.

    A file over the rest of the budget of characters is passed over, and later ones may still fit. Only
    paths and sizes are gone through in order; contents are joined afterwards.
    """
    slim = files.select(repository, path, size).withColumn("_order", F.struct(F.size(F.split(path, "/")).alias("depth"), F.col(path).alias("name")))
    place = F.row_number().over(Window.partitionBy(repository).orderBy("_order"))
    ordered = slim.withColumn("_place", place)
    kept = pack_skip(ordered, [repository], "_place", size, most_chars, path, most_files)
    last = kept.groupBy(repository).agg(F.count("*").alias("_kept"), F.max_by(path, "used").alias("_last"))
    last = last.join(ordered.select(repository, F.col(path).alias("_last"), F.col("_place").alias("_end")), [repository, "_last"]).drop("_last")
    out = files.join(kept, [repository, path], "left").join(ordered.select(repository, path, "_place"), [repository, path]).join(last, repository, "left")
    full = (F.col("_kept") >= most_files) & (F.col("_place") > F.col("_end"))
    return out.withColumn("reason", F.when(F.col("used").isNull(), F.when(full, "file_limit").otherwise("size_limit"))).drop("_place", "_kept", "_end")


def reason_counts(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, files), the commonest first."""
    return skipped.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("files")).orderBy(F.desc("files"), reason)
