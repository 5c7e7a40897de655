"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a TF-IDF vector of hashed byte n-grams, upper case and punctuation kept, projected on the
leading right singular vectors of at most `each` labelled documents of either label. The labelled
vectors are broadcast (their number is bounded by 2 * each); every document's cosines with all of
them are exact blocked products, and its nearest `neighbours` vote with weights that grow with the
cosine. Votes are set right for the share of each label among all labelled documents.

Defined results: a null or empty text has the zero vector and scores the share of label 1; repeated
rows get equal scores; texts of any length are read whole; of equally near neighbours at the last place
those with the smallest ids vote; other columns pass through (added names replace clashing ones); without
labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import plain_name, work_folder
from sediment.llm.features import counts_of_sample, dense_counts, gram_counts, inverse_frequency, sample_per_value, weighted

DIMS = 4096
SIZES = (1, 3)


@dataclass
class Neighbours:
    idf: np.ndarray
    axes: np.ndarray  # (DIMS, rank)
    vectors: np.ndarray  # (labelled, rank), unit
    labels: np.ndarray
    weights: np.ndarray  # of each labelled vector
    share: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def latent_axes(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], rank + 8)).astype("f4")
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ turn.T)[:, :rank].astype("f4")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", each: int = 2000, rank: int = 64) -> Neighbours:
    """Fit on docs (doc_id, text) and labels (doc_id, column 0 or 1)."""
    labels = labels.where(f"{column} in (0, 1)")
    share = labels.agg(F.avg(F.col(column).cast("double"))).first()[0]
    sample = sample_per_value(docs, labels, column, each, work_folder(docs.sparkSession))
    rows = counts_of_sample(sample, DIMS, SIZES).orderBy("doc_id").collect()  # at most 2 * each vectors, no texts
    if not rows:
        return Neighbours(np.ones(DIMS, "f4"), np.zeros((DIMS, 1), "f4"), np.zeros((0, 1), "f4"), np.zeros(0), np.zeros(0), 0.0)
    counts = dense_counts(rows, DIMS)
    idf = inverse_frequency((counts > 0).sum(axis=0), len(counts))
    x = weighted(counts, idf)
    axes = latent_axes(x, min(rank, len(rows)))
    y = np.array([r["value"] for r in rows], "f8")
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Neighbours(idf, axes, _unit(x @ axes), y, weight, float(share))


def score_quality(docs: DataFrame, model: Neighbours, text_col: str = "text", neighbours: int = 25, power: float = 12.0) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier)."""
    base = plain_name(docs, ["score"]).withColumn(text_col, F.col(text_col).cast("string"))
    broad = docs.sparkSession.sparkContext.broadcast(model)

    def vote(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broad.value
        k = min(neighbours, len(m.labels))
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = part.column(text_col).to_pylist()
                score = np.full(len(texts), m.share)
                full = np.array([i for i, t in enumerate(texts) if t], "i8")
                if k and len(full):
                    x = _unit(weighted(gram_counts([texts[i].encode() for i in full], DIMS, SIZES), m.idf) @ m.axes)
                    cos = np.round(x @ m.vectors.T, 6)  # so that equal vectors tie wherever they stand in a block
                    near = np.argpartition(cos, -k, axis=1)[:, -k:]
                    own = np.take_along_axis(cos, near, axis=1)
                    last = own.min(axis=1, keepdims=True)
                    for r in np.flatnonzero((cos == last).sum(axis=1) > (own == last).sum(axis=1)).tolist():  # a tie at the last place
                        near[r] = np.lexsort((np.arange(cos.shape[1]), -cos[r]))[:k]
                        own[r] = cos[r, near[r]]
                    weight = np.exp(power * (own - own.max(axis=1, keepdims=True))) * m.weights[near]
                    score[full] = (weight * m.labels[near]).sum(axis=1) / weight.sum(axis=1)
                yield part.append_column("score", pa.array(np.clip(score, 0, 1)))

    return base.mapInArrow(vote, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
