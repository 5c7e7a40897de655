"""Retrieval queries: terms, BM25, dense, hybrid, packs, diversity, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import text as tx
from sediment.operators import chunking, classify, evaluation, hybrid, lexical, select, vector
from sediment.operators.dense_index import DenseIndex
from sediment.operators.inverted_index import InvertedIndex
from sediment.plans.registry import query
from sediment.sources.work import work_root

ASKED = "the tion ouble est-que"

_TOKENS = """
rough AS (SELECT doc_id, unnest(regexp_split_to_array(lower(translate(coalesce(text, ''), 'İI', 'iı')), '[^\\p{L}\\p{N}''’-]+')) AS raw FROM documents),
cut AS (SELECT doc_id, regexp_replace(raw, '[''’].*$', '') AS w FROM rough),
parts AS (SELECT doc_id, list_filter(string_split(w, '-'), lambda x: x <> '') AS p FROM cut WHERE w <> ''),
folded AS (SELECT doc_id, list_transform(p, lambda x: translate(x, 'şğıçöüâîû', 'sgicouaiu')) AS p FROM parts),
toks AS (
  SELECT doc_id, unnest(list_filter(p, lambda x: length(x) >= 2 OR regexp_matches(x, '[0-9]'))) AS term FROM folded
  UNION ALL SELECT doc_id, array_to_string(p, '') AS term FROM folded WHERE len(p) > 1 AND length(array_to_string(p, '')) >= 2)"""
_BM25 = f"""{_TOKENS},
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN toks t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN ('the', 'tion', 'ouble', 'est', 'que', 'estque') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (
  SELECT tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS lex_score
  FROM tf JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY tf.doc_id)"""
_DENSE = """
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
dense AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.qv) AS score FROM embeddings e, q)"""


def _chunks(table):
    return table("documents").select("doc_id", "text").join(table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def _index(spark, table):
    index = InvertedIndex(spark, f"{work_root(spark)}/sediment-index-{uuid.uuid4().hex}")
    for half in (0, 1):
        index.add(table("documents").where(F.col("doc_id") % 2 == half))
    return index


def _asked_vector(table):
    return vector.query_vector(table("embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"""WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM toks GROUP BY term""")
def term_df(spark, table):
    return lexical.term_frequencies(table("documents"))


@query(f"WITH {_TOKENS} SELECT d.doc_id, count(t.term) AS tokens FROM documents d LEFT JOIN toks t ON d.doc_id = t.doc_id GROUP BY d.doc_id")
def tokenize_counts(spark, table):
    return lexical.lengths(table("documents")).withColumnRenamed("dl", "tokens")


@query(f"WITH {_TOKENS}, dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN toks t ON d.doc_id = t.doc_id GROUP BY d.doc_id) SELECT count(*) AS doc_count, round(avg(dl), 6) AS avgdl FROM dl")
def corpus_stats(spark, table):
    return lexical.corpus_stats(table("documents")).select("doc_count", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25} SELECT doc_id, round(lex_score, 6) AS score FROM lex ORDER BY lex_score DESC, doc_id LIMIT 10")
def bm25_topk(spark, table):
    best = lexical.bm25(table("documents"), ASKED).orderBy(F.desc("lex_score"), "doc_id").limit(10)
    return best.select("doc_id", F.round("lex_score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(lex_score, 6) AS score FROM lex ORDER BY round(lex_score, 9) DESC, doc_id LIMIT 10")
def index_topk(spark, table):
    """The search of bm25_topk over a stored index of two batches."""
    return _index(spark, table).search(ASKED, 10).result.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM tf GROUP BY term")
def index_terms(spark, table):
    """What a stored index of two batches holds."""
    tf = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = _index(spark, table).blocks()
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum(tf).alias("tf"), F.max("max_tf").cast("long").alias("max_tf"))


@query(f"WITH {_BM25}, top AS (SELECT doc_id, row_number() OVER (ORDER BY round(lex_score, 9) DESC, doc_id) AS r FROM lex QUALIFY r <= 10) SELECT doc_id, round(61.0 / (60 + r), 6) AS score FROM top")
def lexical_only_normalized(spark, table):
    out = hybrid.hybrid_search(table("documents"), ASKED, None, k=10)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE} SELECT doc_id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, doc_id LIMIT 10")
def dense_cosine_topk(spark, table):
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vector.dense_topk(rows, _asked_vector(table), 10, None).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE} SELECT doc_id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, doc_id LIMIT 10")
def dense_index_topk(spark, table):
    """dense_cosine_topk over a stored index of two batches, all lists read."""
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    index = DenseIndex(spark, f"{work_root(spark)}/sediment-dense-{uuid.uuid4().hex}")
    index.train(rows, 16)
    for half in (0, 1):
        index.add(rows.where(F.col("doc_id") % 2 == half))
    asked = table("embeddings").where("vec_id = 0").select("embedding").first()[0]
    return index.search(asked, 10).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id AS doc_id, round(list_distance(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], qv), vec_id LIMIT 10")
def dense_euclid_topk(spark, table):
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vector.nearest_euclidean(rows, _asked_vector(table), 10).select("doc_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_DENSE} SELECT doc_id, round(score, 6) AS score FROM dense WHERE score >= 0.2")
def dense_threshold(spark, table):
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vector.dense_scores(rows, _asked_vector(table), least=0.2).select("doc_id", F.round("score", 6).alias("score"))


_CHUNK_BM25 = _BM25.replace("FROM documents)", "FROM chunks)").replace("FROM documents d", "FROM chunks d")


@query(f"""WITH chunks AS (SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id), {_CHUNK_BM25.lstrip()}, {_DENSE.lstrip()},
legs AS (
  SELECT doc_id, row_number() OVER (ORDER BY round(lex_score, 9) DESC, doc_id) AS r FROM lex QUALIFY r <= 20
  UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM dense WHERE score >= 0.1 AND doc_id IN (SELECT doc_id FROM chunks) QUALIFY r <= 20),
fused AS (SELECT doc_id, sum(1.0 / (60 + r)) AS rrf FROM legs GROUP BY doc_id)
SELECT doc_id, round(rrf / max(rrf) OVER (), 6) AS score FROM fused ORDER BY rrf DESC, doc_id LIMIT 20""")
def hybrid_rrf_topk(spark, table):
    out = hybrid.hybrid_search(_chunks(table), ASKED, _asked_vector(table), k=20, least=0.1)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, translate(lower(translate(source || ' ŞĞÜÖÇıİI âîû', 'İI', 'iı')), 'şğıçöüâîû', 'sgicouaiu') AS folded FROM documents")
def tr_fold(spark, table):
    return table("documents").select("doc_id", tx.fold(F.concat("source", F.lit(" ŞĞÜÖÇıİI âîû"))).alias("folded"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY lang = 'de', doc_id) = 1")
def content_dedup_first(spark, table):
    return select.first_of_equal(table("documents"), "text", [F.col("lang") == "de", "doc_id"]).select("doc_id", "lang")


@query("WITH c AS (SELECT doc_id, source, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT doc_id, source, used FROM c WHERE used <= 20000")
def pack_stop(spark, table):
    rows = table("documents").select("doc_id", "source", F.length("text").alias("n"))
    return select.pack_stop(rows, ["source"], ["doc_id"], "n", 20000).select("doc_id", "source", "used")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f(conv_id, r, used, taken) AS (
  SELECT conv_id, r, CASE WHEN n <= 600 THEN n ELSE 0 END, n <= 600 FROM c WHERE r = 1
  UNION ALL SELECT c.conv_id, c.r, CASE WHEN f.used + c.n <= 600 THEN f.used + c.n ELSE f.used END, f.used + c.n <= 600 FROM f JOIN c ON c.conv_id = f.conv_id AND c.r = f.r + 1)
SELECT f.conv_id, c.turn, f.used::DOUBLE AS used FROM f JOIN c ON c.conv_id = f.conv_id AND c.r = f.r WHERE taken""")
def pack_skip(spark, table):
    rows = table("conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return select.pack_skip(rows.withColumn("at", F.col("turn")), ["conv_id"], "at", "n", 600, "turn")


@query("""WITH RECURSIVE q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 40),
r(position, ids, vectors, doc_id, mmr) AS (
  SELECT 0, [vec_id], [e], vec_id, score FROM (SELECT * FROM c ORDER BY score DESC, vec_id LIMIT 1)
  UNION ALL
  SELECT position + 1, list_append(ids, vec_id), list_append(vectors, e), vec_id, v FROM (
    SELECT r.position, r.ids, r.vectors, c.vec_id, c.e, 0.7 * c.score - 0.3 * greatest(0, list_max(list_transform(r.vectors, lambda x: list_cosine_similarity(x, c.e)))) AS v
    FROM r, c WHERE NOT list_contains(r.ids, c.vec_id) AND r.position < 9)
  QUALIFY row_number() OVER (ORDER BY v DESC, vec_id) = 1)
SELECT 0 AS query_id, doc_id, position, round(mmr, 6) AS mmr FROM r""")
def mmr_select(spark, table):
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.lit(0).alias("query_id"))
    best = vector.dense_topk(rows, _asked_vector(table), 40, None)
    return select.mmr(best, "query_id", 10).select("query_id", "doc_id", "position", F.round("mmr", 6).alias("mmr"))


@query()
def chunk_text(spark, table):
    docs = table("documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"), "text")
    return chunking.chunk_documents(docs).select("doc_id", "chunk_index", "content", "has_table", "start_char")


@query()
def compress_passages(spark, table):
    docs = table("documents").select("doc_id", "text")
    return docs.select("doc_id", chunking.compress_chunk("text", F.lit(ASKED)).alias("text"))


@query()
def classify_queries(spark, table):
    return classify.with_parameters(table("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))).drop("query")


_FOUND = r"""words AS (SELECT doc_id, text, regexp_split_to_array(text, '\s+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM words),
heads AS (SELECT item_id, text, array_to_string(regexp_split_to_array(text, '\s+')[1:3], ' ') AS g FROM benchmark),
found AS (
  SELECT h.item_id AS case_id, d.doc_id, row_number() OVER (PARTITION BY h.item_id ORDER BY d.doc_id) AS rank, contains(d.text, h.text) AS relevant
  FROM heads h JOIN grams USING (g) JOIN documents d ON d.doc_id = grams.doc_id)"""


@query(f"""WITH {_FOUND},
per AS (SELECT case_id, max(relevant::INT) AS hit, min(CASE WHEN relevant THEN rank END) AS first, avg((NOT relevant)::INT) AS noise, count(*) AS chunks FROM found GROUP BY case_id),
scored AS (SELECT b.item_id, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS kind, coalesce(hit, 0) AS hit, coalesce(1.0 / first, 0) AS rr, coalesce(noise, 0) AS noise, coalesce(chunks, 0) AS chunks
  FROM benchmark b LEFT JOIN per ON b.item_id = per.case_id)
SELECT kind, count(*) AS cases, sum(hit) AS hits, round(avg(rr), 6) AS mrr, round(avg(noise), 6) AS noise, round(avg(chunks), 6) AS chunks FROM scored GROUP BY ROLLUP (kind)""")
def eval_by_kind(spark, table):
    cases = table("benchmark").select(F.col("item_id").alias("case_id"), "text", F.when(F.length("text") < 200, "short").otherwise("long").alias("kind"))
    # Candidates: documents that hold a case's first three words one after another. Only ids and words meet; bodies follow for the few.
    words = F.split("text", r"\s+")
    heads = cases.select("case_id", F.array_join(F.slice(words, 1, 3), " ").alias("gram"))
    docs = table("documents").select("doc_id", words.alias("words")).where("size(words) > 2")
    each = docs.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("n"))
    gram = F.concat_ws(" ", *(F.get("words", F.col("n") + k) for k in range(3)))
    found = each.select("doc_id", gram.alias("gram")).join(heads, "gram").select("case_id", "doc_id").distinct()
    found = found.join(table("documents").select("doc_id", F.col("text").alias("body")), "doc_id").join(cases.select("case_id", "text"), "case_id")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id"))
    results = found.select("case_id", rank.alias("rank"), F.expr("contains(body, text)").alias("relevant"))
    out = evaluation.by_kind(evaluation.score_cases(results, cases.select("case_id", "kind")))
    return out.select("kind", "cases", "hits", *(F.round(c, 6).alias(c) for c in ("mrr", "noise", "chunks")))
