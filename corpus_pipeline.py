"""The training-data pipeline: toxicity, line dedup, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of docs. Rows with a null id pass every filter. There is no SQL for the
whole: a learned score and a search in a latent space decide in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from sediment.llm.common import crc_remainder, materialize, remove_work_folders, work_folder, work_folders
from sediment.llm.queries import vocabulary


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, counted anew."""
    if "n_chars" in docs.columns:
        return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs


def _aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, list]:
    """docs with clashing columns under other names, and what restores them."""
    clash = {c: f"_kept_{c}" for c in docs.columns if c.lower() in added}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    docs, restored = _aside(docs, ["score", "toxic_words"])
    return toxicity.score_toxicity(docs, model, spans=False).where("score < 0.5").select(*restored)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more of them hold; the largest id keeps each."""
    docs, restored = _aside(docs, ["n_lines", "n_dropped"])
    return _measured(line_dedup.drop_repeated_lines(docs).select(*restored))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.drop_near_copies(docs, size=5, num=80, den=100).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary(), max_tokens=2048, end_id=0)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each result is stored and read again, then the stage's work tables go."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark)
    before = work_folders()  # with the results of the stages, and all that others may still read
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
        remove_work_folders(spark, keep=before)
    return docs
