"""Reciprocal rank fusion of a dense and a lexical leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.lexical import bm25
from sediment.operators.vector import dense_scores

RRF_K = 60


def ranked(leg: DataFrame, score: str, k: int, id_col: str = "doc_id") -> DataFrame:
    """(id, rank) of the k best, ties by id. The limit comes first, so one task ranks k rows."""
    order = [F.round(score, 9).desc(), F.col(id_col)]  # scores that differ in the last bits only are ties
    best = leg.orderBy(*order).limit(k)
    return best.select(id_col, score, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(legs: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """(id, score): the sum of 1 / (60 + rank) over legs of (id, rank), divided by the largest sum."""
    all_legs = legs[0].select(id_col, "rank")
    for leg in legs[1:]:
        all_legs = all_legs.unionByName(leg.select(id_col, "rank"))
    fused = all_legs.groupBy(id_col).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"))
    return fused.crossJoin(F.broadcast(fused.agg(F.max("rrf").alias("top")))).select(id_col, (F.col("rrf") / F.col("top")).alias("score"))


def hybrid_search(
    chunks: DataFrame, query: str, vector: Column | None, k: int = 5, least: float = 0.5, leg_k: int | None = None,
    hybrid: bool = True, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding",
) -> DataFrame:
    """(id, score) of the k best. A blank query or hybrid=False is dense search; no vector is lexical search.

    If no chunk holds a term of the query, the dense scores stay as they are.
    """
    leg_k = leg_k or k
    dense = None
    if vector is not None:
        dense = ranked(dense_scores(chunks, vector, vector_col, least).select(id_col, "score"), "score", leg_k, id_col)
    if not hybrid or not query.strip():
        if dense is None:
            return chunks.limit(0).select(id_col, F.lit(0.0).alias("score"))
        return dense.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)
    lexical = ranked(bm25(chunks, query, id_col, text_col), "lex_score", leg_k, id_col)
    if dense is None:
        return fuse([lexical], id_col).orderBy(F.desc("score"), id_col).limit(k)
    # Both legs have leg_k rows at most, so one task can tell the largest sum and whether any term was found.
    both = dense.select(id_col, "rank", "score", F.lit(0).alias("lexical")).unionByName(lexical.select(id_col, "rank", F.lit(None).cast("double").alias("score"), F.lit(1).alias("lexical")))
    both = both.groupBy(id_col).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("score").alias("dense"), F.max("lexical").alias("lexical"))
    whole = Window.partitionBy(F.lit(0))
    score = F.when(F.max("lexical").over(whole) == 1, F.col("rrf") / F.max("rrf").over(whole)).otherwise(F.col("dense"))
    return both.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
