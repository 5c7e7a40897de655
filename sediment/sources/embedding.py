"""Embeddings from an injectable function, with a stored cache: only texts that it lacks are embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.hashing import cache_key_hash
from sediment.sources.work import stored

BATCH = 50


def reply_vectors(body: Column) -> Column:
    """The vectors of an embedding reply in the order of the texts asked for, or null for a body of another shape.

    A reply is {data: [{index, embedding}]}, whose order is told by index (0 where it lacks) and not by its
    place, or {embeddings: [...]}, or the array of vectors itself.
    """
    reply = F.from_json(body, "struct<data: array<struct<index: int, embedding: array<double>>>, embeddings: array<array<double>>>")
    placed = F.transform(reply["data"], lambda x, n: F.struct(F.coalesce(x["index"], F.lit(0)).alias("index"), n.alias("place"), x["embedding"].alias("v")))
    bare = F.when(F.ltrim(body).rlike(r"^\[\s*\["), F.from_json(body, "array<array<double>>"))
    return F.coalesce(F.transform(F.array_sort(placed), lambda x: x["v"]), reply["embeddings"], bare)


def embed_missing(chunks: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, new cache rows (key, embedding)); equal texts are embedded once, and stored, so that
    both results hold the same answers."""
    keyed = chunks.withColumn("key", cache_key_hash(F.col(text_col)))
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(text_col).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BATCH):
                some = part.iloc[at : at + BATCH]
                yield pd.DataFrame({"key": some["key"], "embedding": embed(some["text"].tolist())})

    new = stored(missing.mapInPandas(run, "key string, embedding array<float>"), "embedded")
    whole = cache.select("key", "embedding").unionByName(new)
    return keyed.join(whole, "key", "left").drop("key"), new
