"""Language identification by nearest clustered centroids.

A text is a unit TF-IDF vector of hashed byte trigrams of its letters. Each language has several
centroids, found by spherical k-means over at most `each` of its documents; a text takes the language
of the centroid with the largest cosine. A text farther from it than nearly all documents that the
centroid was made from is marked as rejected, and gets `und` where the caller asks for that.

Defined results: a null text and a text without letters are `und` with score 0; repeated rows get
equal results; of equally near languages the first by name wins; texts of any length are read whole; other columns pass through (added names replace clashing ones); with nothing to learn
from every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import plain_name, sliced, work_folder
from sediment.llm.features import LETTERS, counts_of_sample, dense_counts, gram_counts, inverse_frequency, sample_per_value, weighted

DIMS = 4096
UNKNOWN = "und"


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    lang_of: np.ndarray  # language number of each centroid
    centres: np.ndarray
    reach: np.ndarray  # least cosine that is not rejected, of each centroid


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; fractions, circled and raised figures are none."""
    return any(map(str.isalpha, text))


def cleaned(text: str | None) -> bytes:
    return text.lower().encode().translate(LETTERS) if text else b""


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by k-means on cosine; the start spreads from the mean outwards."""
    centre = x.mean(axis=0, keepdims=True)
    for _ in range(min(k, len(x)) - 1):
        far = int(np.argmin((x @ centre.T).max(axis=1)))
        centre = np.vstack([centre, x[far]])
    for _ in range(rounds):
        near = np.argmax(x @ (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)).T, axis=1)
        centre = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, lang_col: str = "lang", clusters: int = 4, each: int = 800) -> Centroids:
    """Fit on docs (doc_id, text, lang_col); `each` bounds the documents of a language that are used.

    Document frequencies are summed by tasks; the driver takes one language's vectors at a time, so
    what it holds does not grow with the number of languages but for their centroids.
    """
    sample = sample_per_value(docs, docs, lang_col, each, work_folder(docs.sparkSession))

    def held(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts, 500):
            found = (gram_counts([cleaned(t) for t in part.column("text").to_pylist()], DIMS) > 0).sum(axis=0)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["gram", "n"])

    frequency = np.zeros(DIMS, "i8")
    for r in sample.mapInArrow(held, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMS rows at most
        frequency[r["gram"]] = r["n"]
    langs = [r["value"] for r in sample.select("value").distinct().orderBy("value").collect()]
    idf = inverse_frequency(frequency, sample.count()) if langs else np.ones(DIMS, "f4")
    centres, lang_of, reach = [np.zeros((0, DIMS), "f4")], [], []
    for n, lang in enumerate(langs):
        rows = counts_of_sample(sample.where(F.col("value") == lang), DIMS, clean=cleaned).orderBy("doc_id").collect()  # `each` vectors at most, no texts
        own = weighted(dense_counts(rows, DIMS), idf)
        got = spherical_means(own, clusters)
        cos = own @ got.T
        near = cos.argmax(axis=1)
        for j in range(len(got)):
            mine = cos[near == j, j]
            reach.append(0.7 * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
        centres.append(got.astype("f4"))
        lang_of += [n] * len(got)
    return Centroids(idf, langs, np.array(lang_of, "i8"), np.concatenate(centres), np.array(reach))


def predict(docs: DataFrame, model: Centroids, text_col: str = "text", reject: bool = True, sharpness: float = 30.0) -> DataFrame:
    """docs with lang_pred, score (0 to 1: the language's share of a softmax over languages) and rejected."""
    base = plain_name(docs, ["lang_pred", "score", "rejected"]).withColumn(text_col, F.col(text_col).cast("string"))
    broad = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broad.value
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = part.column(text_col).to_pylist()
                known = np.array([bool(t and has_letter(t)) for t in texts], bool) & bool(m.langs)
                lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known.any():
                    cos = weighted(gram_counts([cleaned(t) for t in texts], DIMS), m.idf) @ m.centres.T
                    best = cos.argmax(axis=1)
                    by_lang = np.stack([cos[:, m.lang_of == n].max(axis=1) for n in range(len(m.langs))], axis=1)
                    weight = np.exp(sharpness * (by_lang - by_lang.max(axis=1, keepdims=True)))
                    score = np.where(known, 1 / weight.sum(axis=1), 0.0)
                    far = known & (cos[np.arange(len(cos)), best] < m.reach[best])
                    lang = [m.langs[m.lang_of[b]] if k and not (reject and f) else UNKNOWN for b, k, f in zip(best, known, far, strict=True)]
                out = part.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score, pa.float64()))
                yield out.append_column("rejected", pa.array(far))

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return base.mapInArrow(nearest, T.StructType([*base.schema.fields, *added]))
