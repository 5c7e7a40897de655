"""Usage analytics over (ts, user, app, model, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly(logs: DataFrame, week: Column, user: str, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """Requests, tokens and distinct users of each week, newest first."""
    out = logs.groupBy(week.alias("week_start")).agg(F.count("*").alias("requests"), F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"), F.countDistinct(user).alias("users"))
    return out.orderBy(F.desc("week_start"))


def totals(logs: DataFrame, day: Column, user: str, tokens_in: Column) -> DataFrame:
    """One row; zeros and nulls for an empty log."""
    return logs.agg(F.count("*").alias("requests"), F.coalesce(F.sum(tokens_in), F.lit(0)).alias("input_tokens"), F.countDistinct(user).alias("users"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def count_by(logs: DataFrame, name: Column, ordinal: str) -> DataFrame:
    """(name, n), largest first, ties by first appearance."""
    out = logs.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    return out.orderBy(F.desc("n"), "first_seen")


def summary(logs: DataFrame, ts: str, app: str) -> DataFrame:
    return logs.agg(F.count("*").alias("requests"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.countDistinct(app).alias("apps"))


def metric_average(total: Column, count: Column) -> Column:
    """total / count, 0 where count is 0 or null."""
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def daily_partials(logs: DataFrame, day: Column, keys: list[str], user: str, sums: dict[str, Column], precision: int = 12) -> DataFrame:
    """(day, keys, requests, sums, users): exact sums and a sketch of distinct users for each day, to be kept and merged.

    A sketch has 2^precision places at most; its standard error is about 1.04 / sqrt(2^precision), 1.6 % as it stands.
    """
    added = [F.sum(value).alias(name) for name, value in sums.items()]
    return logs.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("requests"), *added, F.hll_sketch_agg(user, precision).alias("users"))


def merged(partials: DataFrame, period: Column | None, keys: list[str], sums: list[str]) -> DataFrame:
    """(period, keys, requests, sums, users): partials of days brought together, without reading the log again.

    Without a period there is one row for each of the keys; users is the estimate.
    """
    by = [*([period.alias("period")] if period is not None else []), *keys]
    users = F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users")
    return partials.groupBy(*by).agg(F.sum("requests").alias("requests"), *[F.sum(c).alias(c) for c in sums], users)


class UsageStore:
    """Partials of days in a folder, a partition each. A day added, or added again, writes its own partition alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, partials: DataFrame) -> None:
        partials.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The partials from a day to a day; only their partitions are read."""
        out = self.spark.read.parquet(self.path)
        for value, keep in ((first, lambda d, v: d >= v), (last, lambda d, v: d <= v)):
            out = out if value is None else out.where(keep(F.col("day"), F.lit(value).cast("date")))
        return out
