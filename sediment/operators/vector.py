"""Dense search: scoped scans, exact top-k, thresholds, chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.vectors import cosine, euclidean


def scoped(chunks: DataFrame, project_id: str | None = None, conversation_id: str | None = None, vector_col: str = "embedding") -> DataFrame:
    """Chunks with a vector, of a project and of a conversation where these are given."""
    out = chunks.where(F.size(vector_col) > 0)
    for column, value in (("project_id", project_id), ("conversation_id", conversation_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def query_vector(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dense_scores(chunks: DataFrame, vector: Column, vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """chunks with score; vectors of another length, or without a cosine (one that is not finite), are left out."""
    out = chunks.where(F.size(vector_col) == F.size(vector)).withColumn("score", cosine(F.col(vector_col), vector)).where(~F.isnan("score"))
    return out if least is None else out.where(F.col("score") >= least)


def dense_topk(chunks: DataFrame, vector: Column, k: int = 5, least: float | None = 0.5, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """The k best by cosine, ties by id."""
    return dense_scores(chunks, vector, vector_col, least).orderBy(F.desc("score"), id_col).limit(k)


def nearest_euclidean(chunks: DataFrame, vector: Column, k: int = 5, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    out = chunks.where(F.size(vector_col) == F.size(vector)).withColumn("distance", euclidean(F.col(vector_col), vector))
    return out.orderBy("distance", id_col).limit(k)


def chunk_stats(chunks: DataFrame, group: str = "project_id", vector_col: str = "embedding") -> DataFrame:
    """Chunks and chunks with a vector, of each project and of all (null)."""
    return chunks.rollup(group).agg(F.count("*").alias("chunks"), F.count_if(F.size(vector_col) > 0).alias("with_embedding"))
