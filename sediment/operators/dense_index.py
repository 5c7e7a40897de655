"""A coarse-quantised dense index: vectors in lists around centroids, searched list by list, scored exactly.

Centroids are found by k-means on cosine over a bounded sample of vectors; every vector is then put in
the list of its nearest centroid, a partition of the folder. A search reads the lists whose centroids are
nearest to the question, by partition, and scores their vectors with vector.dense_scores; with all lists
it is exact. Batches may be added: centroids stay, lists grow. Vectors that are null, zero, not finite or of
another length than the centroids stand in list -1, which is read with all lists only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.vector import dense_topk, query_vector

#: Vectors of the sample for each list.
SAMPLE = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; a list that loses its vectors begins anew at the vector that is worst served."""
    x = _unit(sample)
    centre = x[np.random.default_rng(7).permutation(len(x))[:lists]]
    for _ in range(rounds):
        cos = x @ centre.T
        near = cos.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        worst = np.argsort(cos.max(axis=1))
        for n, empty in enumerate(np.flatnonzero(np.bincount(near, minlength=len(centre)) == 0)):
            total[empty] = x[worst[n]]
        centre = _unit(total)
    return centre


class DenseIndex:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id, self.vector = spark, path.rstrip("/"), id_col, vector_col

    def train(self, chunks: DataFrame, lists: int) -> None:
        """Find `lists` centroids over at most SAMPLE vectors for each, those with the smallest hash, and store them."""
        some = chunks.where(F.size(self.vector) > 0).select(F.col(self.vector).cast("array<double>").alias("v"), F.xxhash64(self.id).alias("h")).orderBy("h").limit(SAMPLE * lists)
        rows = [np.array(r["v"], "f8") for r in some.select("v").collect() if None not in r["v"]]
        sizes = [len(r) for r in rows]
        usual = max(set(sizes), key=sizes.count) if sizes else 0
        x = np.array([r for r in rows if len(r) == usual and np.isfinite(r).all() and r.any()]).reshape(-1, max(usual, 1))
        found = centroids_of(x, min(lists, len(x))) if len(x) else np.zeros((0, 1))
        self.spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(found)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 1))

    def add(self, chunks: DataFrame) -> None:
        """Put all chunks (id, vector) in their lists; lists are dealt over tasks, also a hot one."""
        centre = self.spark.sparkContext.broadcast(self.centroids())  # lists * length numbers
        vector = self.vector

        def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centre.value
            for whole in parts:
                for at in range(0, whole.num_rows, 2000):
                    part = whole.slice(at, 2000)
                    rows = part.column(vector).to_pylist()
                    ok = [n for n, v in enumerate(rows) if len(c) and v and len(v) == c.shape[1] and None not in v and np.isfinite(v).all() and any(v)]
                    to = np.full(len(rows), -1, "i4")
                    if ok:
                        to[ok] = (_unit(np.array([rows[n] for n in ok], "f8")) @ c.T).argmax(axis=1)
                    yield part.append_column("list", pa.array(to, pa.int32()))

        rows = chunks.select(self.id, F.col(vector).cast("array<double>").alias(vector))
        dealt = rows.mapInArrow(nearest, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))
        dealt = dealt.repartition("list", F.pmod(F.xxhash64(self.id), F.lit(8)))
        dealt.write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")

    def probed(self, vector: list[float], probes: int | None = None) -> DataFrame:
        """The vectors of the `probes` lists nearest to a vector, or all."""
        kept = self.spark.read.parquet(f"{self.path}/vectors")
        if probes is None:
            return kept
        cos = self.centroids() @ np.array(vector, "f8")
        return kept.where(F.col("list").isin(np.argsort(-cos, kind="stable")[:probes].tolist()))

    def search(self, vector: list[float], k: int = 10, probes: int | None = None, least: float | None = None) -> DataFrame:
        """(id, list, score) of the k best by cosine in the lists probed, ties by id."""
        return dense_topk(self.probed(vector, probes), query_vector(vector), k, least, self.id, self.vector).select(self.id, "list", "score")

    def recall(self, questions: list[list[float]], k: int, probes: int) -> tuple[float, float]:
        """The share of the exact k best that the probes find, and the share of the vectors read, over some questions."""
        hits = wanted = read = 0
        total = self.probed([]).count()
        for q in questions:
            exact = {r[0] for r in self.search(q, k).select(self.id).collect()}
            hits += len(exact & {r[0] for r in self.search(q, k, probes).select(self.id).collect()})
            wanted, read = wanted + len(exact), read + self.probed(q, probes).count()
        return hits / max(1, wanted), read / max(1, total * len(questions))
