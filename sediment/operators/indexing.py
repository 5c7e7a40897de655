"""Indexing of documents: chunks, pages, hashes, vectors of equal chunks used again, the rest embedded, the document's rows replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.hashing import content_hash
from sediment.operators.catalog import reuse_vectors
from sediment.operators.chunking import chunk_documents, page_numbers
from sediment.sources.embedding import embed_missing
from sediment.sources.store import ChunkStore
from sediment.sources.work import stored

STORE = "project_id, document_id, chunk_index, content, page, start_line, end_line, language, content_hash, embedding"


def chunks_of_documents(documents: DataFrame) -> DataFrame:
    """(project_id, document_id, chunk_index, content, page, start_line, end_line, language, content_hash) from (project_id, document_id, name, text)."""
    found = page_numbers(chunk_documents(documents, "document_id"), "document_id")
    found = found.join(documents.select("document_id", "project_id").distinct(), "document_id")
    return found.withColumn("content_hash", content_hash(F.col("content"))).select(*[c for c in STORE.split(", ") if c != "embedding"])


def index_documents(
    documents: DataFrame, store: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], reuse: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(the store after indexing, new rows of the embedding cache).

    documents is (project_id, document_id, name, text), the store has the columns of STORE. A chunk whose
    content another document of its project holds takes that vector; with reuse=False (a conversation's
    documents) none does. All rows of the documents are replaced, also of those that give no chunk.
    """
    chunks = chunks_of_documents(documents)
    others = store.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    if reuse:
        known = others.select(F.struct("project_id", "content_hash").alias("_key"), "embedding", "document_id", "chunk_index")
        chunks = reuse_vectors(chunks.withColumn("_key", F.struct("project_id", "content_hash")), known, "_key", "embedding", ["document_id", "chunk_index"]).drop("_key")
    else:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    lacking, new = embed_missing(chunks.where("embedding is null").drop("embedding"), cache, embed)
    columns = STORE.split(", ")
    ready = chunks.where("embedding is not null").select(*columns).unionByName(lacking.where("embedding is not null").select(*columns))
    return others.select(*columns).unionByName(ready), new


def chunk_store(spark: SparkSession, path: str, parts: int = 64) -> ChunkStore:
    """A store of chunks in a folder; ids of projects and documents are texts."""
    kinds = {"chunk_index": "int", "page": "int", "start_line": "int", "end_line": "int", "embedding": "array<float>"}
    return ChunkStore(spark, path, T.StructType.fromDDL(", ".join(f"{c} {kinds.get(c, 'string')}" for c in STORE.split(", "))), parts)


def index_into(
    store: ChunkStore, documents: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], reuse: bool = True
) -> DataFrame:
    """Index documents (project_id, document_id, name, text) in a store; the new rows of the embedding cache.

    Only the partitions of these documents are rewritten; vectors to use again are looked for in the
    partitions of their projects.
    """
    documents = documents.withColumns({c: F.col(c).cast("string") for c in ("project_id", "document_id")})
    indexed, new = index_documents(documents, store.of_projects(documents) if reuse else store.read().limit(0), cache, embed, reuse)
    new = stored(new, "cache")
    own = indexed.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    store.replace(documents, own.select(*[F.col(f.name).cast(f.dataType) for f in store.schema if f.name != "part"]))
    return new
