"""Queries of small formats and of context assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import formats as fm
from sediment.functions import text as tx
from sediment.operators import blocks, catalog, context, evaluation
from sediment.plans.registry import query


@query(r"SELECT conv_id, turn, lower(translate(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), 'İI', 'iı')) AS key FROM conversations")
def query_cache_keys(spark, table):
    return table("conversations").select("conv_id", "turn", tx.cache_key(F.col("text")).alias("key"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_full_match(t, '-?[0-9]{1,15}([.,][0-9]+)?') AND NOT regexp_full_match(t, '-?[0-9]{1,3}\.[0-9]{3}') THEN CAST(replace(t, ',', '.') AS DOUBLE) END AS value
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_brand ELSE (p_partkey * 7)::VARCHAR END AS t FROM part)""")
def cell_values(spark, table):
    key = F.col("p_partkey")
    t = F.when(key % 4 == 0, F.concat(F.lit("1."), F.lpad((key % 1000).cast("string"), 3, "0"))).when(key % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    t = t.when(key % 4 == 2, F.col("p_brand")).otherwise((key * 7).cast("string"))
    return table("part").select("p_partkey", fm.cell_value(t).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_shipmode || ':' || l_linenumber || CASE WHEN l_suppkey <> l_linenumber THEN '-' || l_suppkey ELSE '' END
WHEN l_linenumber % 3 = 1 THEN l_shipmode || ', ' || l_suppkey ELSE l_shipmode END AS label FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)""")
def chunk_labels(spark, table):
    n = F.col("l_linenumber")
    start, end = F.when(n % 3 == 0, n), F.when(n % 3 == 0, F.col("l_suppkey"))
    page = F.when(n % 3 == 1, F.col("l_suppkey"))
    return table("lineitem").select("l_orderkey", "l_linenumber", tx.chunk_label(F.col("l_returnflag"), page, start, end).alias("label"))


@query("SELECT s_suppkey, substr(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g') || md5(s_name), 1, 24) AS key FROM supplier")
def routing_keys(spark, table):
    return table("supplier").select("s_suppkey", fm.routing_key(F.col("s_name")).alias("key"))


@query(r"""WITH k AS (SELECT p_partkey AS id, p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part),
starts AS (SELECT id, k, left(k, unnest(range(0, length(k) + 1))::INT) AS p FROM k),
m AS (
  SELECT a.id, 1 AS priority, b.id AS best FROM k a JOIN k b ON upper(a.name) = b.name
  UNION ALL SELECT a.id, 2, b.id FROM k a JOIN k b ON a.k = b.k
  UNION ALL SELECT a.id, 3, b.id FROM k a JOIN starts b ON a.k = b.p
  UNION ALL SELECT a.id, 3, b.id FROM starts a JOIN k b ON a.p = b.k)
SELECT id AS p_partkey, best, priority FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, best) = 1""")
def model_match(spark, table):
    part = table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return catalog.match_models(part.withColumn("name", F.upper("name")), part).withColumnRenamed("id", "p_partkey")


@query("SELECT conv_id, count(*) FILTER (WHERE contains(lower(text), 'the ')) AS hits, bool_or(length(trim(text)) BETWEEN 8 AND 400) AS valid FROM conversations GROUP BY conv_id")
def memory_candidates(spark, table):
    rows = table("conversations")
    status = fm.memory_append(F.lit(None).cast("string"), F.col("text"))["status"]
    return rows.groupBy("conv_id").agg(F.count_if(F.lower("text").contains("the ")).alias("hits"), F.bool_or(status != "invalid").alias("valid"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS head, CAST(ceil(length(text) / 4.0) AS INT) AS tokens FROM documents")
def chunk_heads(spark, table):
    return table("documents").select("doc_id", tx.truncated(F.col("text"), 60).alias("head"), tx.chunk_tokens(F.col("text")).alias("tokens"))


@query()
def document_blocks(spark, table):
    found = blocks.blocks_of(table("documents"), "doc_id", "text")
    return blocks.to_slides(found, "doc_id").groupBy("doc_id", "slide").agg(F.count("*").alias("blocks"))


@query()
def question_context(spark, table):
    """Contexts for the benchmark's first questions over documents with vectors, one vector standing in for each question's."""
    chunks = table("documents").join(table("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    chunks = chunks.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_name"), *(F.lit(None).cast("int").alias(c) for c in ("page_number", "start_line", "end_line")), F.col("text").alias("content"), "embedding")
    asked = table("benchmark").join(table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    asked = asked.select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), "vector")
    return context.build_context(asked, [chunks.where("chunk_id % 10 = 0"), chunks.where("chunk_id % 10 <> 0")], budget=2000).drop("content")


@query()
def retrieval_quality(spark, table):
    """Hit, reciprocal rank and noise of lexical search for benchmark passages over all documents."""
    docs = table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    asked = table("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), F.array(F.lit(0.0)).alias("vector"), F.lit(3).alias("top_k"), F.lit(0.5).alias("threshold"), F.lit(False).alias("skip_retrieval"))
    found = context.batch_hybrid(asked, docs).join(docs.select("chunk_id", "content"), "chunk_id").join(F.broadcast(asked.select("question_id", "query")), "question_id")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    results = found.select(F.col("question_id").alias("case_id"), rank.alias("rank"), F.expr("contains(content, query)").alias("relevant"))
    cases = asked.select(F.col("question_id").alias("case_id"), F.when(F.length("query") < 200, "short").otherwise("long").alias("kind"))
    out = evaluation.by_kind(evaluation.score_cases(results, cases))
    return out.select("kind", "cases", "hits", *(F.round(c, 4).alias(c) for c in ("mrr", "noise", "chunks")))
