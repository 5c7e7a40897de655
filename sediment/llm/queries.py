"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import (
    decontaminate, divergence, embedding_dedup, fingerprints, language_id, line_dedup, merkle, ngram_join, packing, quality, substring_dedup, token_counts, toxicity,
)
from sediment.llm.common import crc_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id is never learned from, but has no remainder: false."""
    return F.coalesce(crc_remainder("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select("doc_id", "text"), model, reject=False)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, num=85, den=100)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 4) != 2).select("doc_id", "quality")
    found = quality.score_quality(docs, quality.fit(docs, labels))
    return found.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_matches(docs, _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < o.last_doc, false) AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; the folder is a package of the Python environment."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), max_tokens=2048, end_id=0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary(), limit=2048).drop("text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_toxicity(docs, model).drop("text")
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.95)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(crc_remainder("doc_id", 3) == 0, merkle.leaf_digest("doc_id", "source", "lang", "n_chars", merkle.lowered_copy(F.col("text"))))
    leaf = merkle.leaf_digest("doc_id", "source", "lang", "n_chars", "text")
    rows = merkle.prove(merkle.build(docs.select("doc_id", "lang", leaf.alias("leaf"), tampered.alias("tampered")), "doc_id", "lang", "leaf"))
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "digest"), F.col("path")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.successor_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_document_fingerprints": op13_document_fingerprints,
}
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT r.u AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.v) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.u GROUP BY r.u
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
SELECT c.u AS vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.u = c.component_id AS kept
FROM (SELECT u, min(w) AS component_id FROM r GROUP BY u) c LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) d ON c.u = d.u
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS q FROM k JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM s JOIN v USING (lang)),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 10
"""

_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""


def _leaf_sql(text: str) -> str:
    fields = (f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


def _tree_sql(name: str, start: str) -> str:
    """CTEs: name is the nodes of trees of eight, name_sib what stands before and after each node under its parent."""
    frame = "(PARTITION BY level, g, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""{name}(level, g, pos, digest, size) AS ({start}
  UNION ALL SELECT level + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM {name} WHERE size > 1 GROUP BY level, g, pos // 8),
{name}_sib AS (SELECT level, g, pos, coalesce(string_agg(digest, '') OVER {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(digest, '') OVER {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name} WHERE size > 1)"""


OP12_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM l),
{_tree_sql("t", "SELECT 0, g, pos, leaf, size FROM n")},
s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
{_tree_sql("u", "SELECT 0, '', pos, subroot, size FROM s")},
f(doc_id, pos, g, level, here, folded, proof) AS (
  SELECT doc_id, pos, g, 0, pos, coalesce(bad, leaf), '' FROM n
  UNION ALL SELECT f.doc_id, f.pos, f.g, f.level + 1, f.here // 8, sha256(x.a || f.folded || x.b), f.proof || x.a || x.b
  FROM f JOIN t_sib x ON x.level = f.level AND x.g = f.g AND x.pos = f.here),
h AS (SELECT f.* FROM f QUALIFY row_number() OVER (PARTITION BY f.g, f.pos ORDER BY level DESC) = 1),
e(doc_id, pos, g, level, here, folded, proof) AS (
  SELECT h.doc_id, h.pos, h.g, 0, s.pos, h.folded, h.proof FROM h JOIN s ON s.g = h.g
  UNION ALL SELECT e.doc_id, e.pos, e.g, e.level + 1, e.here // 8, sha256(x.a || e.folded || x.b), e.proof || x.a || x.b
  FROM e JOIN u_sib x ON x.level = e.level AND x.pos = e.here),
z AS (SELECT e.* FROM e QUALIFY row_number() OVER (PARTITION BY e.g, e.pos ORDER BY level DESC) = 1)
SELECT n.doc_id, n.leaf, s.subroot, r.digest AS root, sha256(z.proof) AS proof_sha256, z.folded AS folded_root, z.folded = r.digest AS verified
FROM n JOIN z ON z.g = n.g AND z.pos = n.pos JOIN s ON s.g = n.g, (SELECT digest FROM u WHERE size = 1) r
"""

ORACLE_SQL: dict[str, str] = {"op11_source_divergence": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op3_ngram_join": OP3_SQL, "op7_line_dedup": OP7_SQL, "op10_embedding_dedup": OP10_SQL}
