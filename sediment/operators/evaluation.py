"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, kind, hit, rr, noise, chunks) from results (case_id, rank, relevant) and cases (case_id, kind)."""
    per = results.groupBy("case_id").agg(
        F.max(F.col("relevant").cast("int")).alias("hit"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.avg((~F.col("relevant")).cast("int")).alias("noise"), F.count("*").alias("chunks"),
    )
    out = cases.join(per, "case_id", "left")
    rr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return out.select("case_id", "kind", F.coalesce("hit", F.lit(0)).alias("hit"), rr.alias("rr"), F.coalesce("noise", F.lit(0.0)).alias("noise"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def by_kind(scored: DataFrame) -> DataFrame:
    """Cases, hits, mean reciprocal rank, noise and chunks of each kind and of all (null)."""
    return scored.rollup("kind").agg(F.count("*").alias("cases"), F.sum("hit").alias("hits"), F.avg("rr").alias("mrr"), F.avg("noise").alias("noise"), F.avg("chunks").alias("chunks"))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(case_id, runs, passed, all_passed) from (case_id, passed)."""
    return runs.groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))
