"""Hashed byte n-gram vectors of whole texts, and bounded samples to fit on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import materialize, sliced

#: ASCII bytes other than letters, as a space.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


def gram_counts(texts: list[bytes], dims: int, sizes: tuple[int, ...] = (3,)) -> np.ndarray:
    """(texts, dims) counts of the byte n-grams of each text, with a space at either end; dims is a power of two."""
    out = np.zeros((len(texts), dims), "f4")
    shift = np.uint32(32 - dims.bit_length() + 1)
    for row, text in enumerate(texts):
        if not text:
            continue
        b = np.frombuffer(b" " + text + b" ", "u1").astype("u4")
        for size in sizes:
            n = len(b) - size + 1
            if n <= 0:
                continue
            code = np.full(n, size, "u4")
            for k in range(size):
                code = (code ^ b[k : k + n]) * np.uint32(0x9E3779B1)
                code ^= code >> np.uint32(15)
            out[row] += np.bincount((code * np.uint32(0x85EBCA6B)) >> shift, minlength=dims)
    return out


def counts_of_sample(sample: DataFrame, dims: int, sizes: tuple[int, ...] = (3,), clean: Callable[[str], bytes] = str.encode) -> DataFrame:
    """(doc_id, value, at, n): the counts of each text's n-grams, made by the tasks; their size is bounded by dims, that of a text is not."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts, 200):
            counts = gram_counts([clean(t) for t in part.column("text").to_pylist()], dims, sizes)
            full = [np.flatnonzero(c) for c in counts]
            at, n = ([x.astype(t).tobytes() for x in rows] for rows, t in ((full, "<u4"), ([c[f] for c, f in zip(counts, full, strict=True)], "<f4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("value"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "value", "at", "n"])

    kinds = T.StructType([sample.schema["doc_id"], sample.schema["value"], T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    return sample.select("doc_id", "value", "text").mapInArrow(count, kinds)


def dense_counts(rows: list, dims: int) -> np.ndarray:
    """(rows, dims) of collected counts."""
    out = np.zeros((len(rows), dims), "f4")
    for own, r in zip(out, rows, strict=True):
        own[np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["n"], "<f4")
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log counts times idf; a text without n-grams is the zero vector."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def inverse_frequency(held: np.ndarray, texts: int) -> np.ndarray:
    """Weights of n-grams that `held` of the texts hold."""
    return (np.log((texts + 1) / (held + 1)) + 0.3).astype("f4")


def sample_per_value(docs: DataFrame, values: DataFrame, column: str, each: int, folder: str) -> DataFrame:
    """(doc_id, text, value), stored: at most `each` documents of each value, those whose ids have the smallest hash.

    values has doc_id and column. Of a value with many ids only hashes below a bound are ranked, under
    which a few times `each` lie; so no task ranks all rows of a value. The chosen ids are few, so they
    are broadcast to the texts. An id that stands in several rows gives one text, the smallest.
    """
    ids = values.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("value")).where("doc_id is not null and value is not null")
    ids = ids.distinct().withColumn("h", F.xxhash64("doc_id"))
    share = 4.0 * each / F.col("n")
    bounds = ids.groupBy("value").agg(F.count("*").alias("n")).select("value", F.when(share < 1, share).otherwise(F.lit(2.0)).alias("bound"))
    near = ids.join(bounds, "value").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("value").orderBy("h", "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= each).groupBy("doc_id").agg(F.max("value").alias("value"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("value").alias("value"))
    return materialize(sample, folder, f"sample-{column}")
