"""Catalog, citation, repository, edit and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import hashing
from sediment.functions import text as tx
from sediment.operators import catalog as ct
from sediment.operators import citations, edits, repo, select, vector
from sediment.plans.registry import query
from sediment.sources.embedding import reply_vectors


@query("SELECT vec_id AS doc_id FROM embeddings WHERE label % 4 <> 0 AND vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_chunks(spark, table):
    chunks = table("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return ct.orphans(chunks, table("labels"), "doc_id", "doc_id", F.col("label") % 4 == 0).select("doc_id")


@query("""SELECT d.doc_id + 5000000 AS doc_id, e.vec_id + 7000000 AS vec_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id AND e.vec_id % 2 = 0 WHERE d.doc_id % 3 <> 0""")
def import_remap(spark, table):
    rows = table("documents").select("doc_id", F.col("doc_id").alias("vec_id"))
    new = table("documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 5000000).alias("new_id"))
    vec = table("embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("old_id"), (F.col("vec_id") + 7000000).alias("new_id"))
    return ct.remap(ct.remap(rows, vec, "vec_id", False), new, "doc_id", True)


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def import_only_new(spark, table):
    return ct.only_new(table("labels"), table("documents").where("lang = 'en'"), "doc_id").select("doc_id", "quality")


@query("SELECT 'labels' AS part, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT 'documents', count(*) FROM documents WHERE lang <> 'fr' OR lang IS NULL")
def cascade_delete(spark, table):
    docs = table("documents")
    left = ct.delete_cascade({"labels": table("labels"), "documents": docs}, {"labels": "doc_id", "documents": "doc_id"}, docs.where("lang = 'fr'"), "doc_id")
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, t in left.items()]
    return counts[0].unionByName(counts[1])


@query("""WITH h AS (SELECT sha256(text) AS h, min(vec_id) AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT d.doc_id, h.v AS reused FROM documents d LEFT JOIN h ON sha256(d.text) = h.h WHERE d.doc_id % 2 = 1""")
def vector_reuse(spark, table):
    docs = table("documents").select("doc_id", hashing.content_hash(F.col("text")).alias("hash"))
    known = docs.where("doc_id % 2 = 0").join(table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").withColumn("vector", F.array("doc_id"))
    out = ct.reuse_vectors(docs.where("doc_id % 2 = 1"), known, "hash", "vector", ["doc_id"])
    return out.select("doc_id", F.col("vector")[0].alias("reused"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey % 1000 AS a, l_orderkey % 1000 + CAST(l_quantity AS INT) AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_suppkey, min(a) AS a, max(b) AS b FROM i GROUP BY l_suppkey, k""")
def citation_ranges(spark, table):
    rows = table("lineitem").select("l_suppkey", (F.col("l_orderkey") % 1000).alias("a"), (F.col("l_orderkey") % 1000 + F.col("l_quantity").cast("int")).alias("b"))
    return citations.merge_ranges(rows, ["l_suppkey"], "a", "b")


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey % 97 AS p FROM lineitem),
r AS (SELECT *, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS k FROM p),
g AS (SELECT l_suppkey, min(p) AS a, max(p) AS b FROM r GROUP BY l_suppkey, k)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM g GROUP BY l_suppkey""")
def page_ranges(spark, table):
    rows = table("lineitem").select("l_suppkey", (F.col("l_orderkey") % 97).alias("p"))
    return citations.page_ranges(rows, ["l_suppkey"], "p")


@query("""SELECT l_suppkey, count(*) AS chunks, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS pages, max(CASE WHEN l_returnflag <> 'N' THEN l_discount END) AS best, bool_or(l_linestatus = 'O') AS direct FROM lineitem GROUP BY l_suppkey""")
def citation_groups(spark, table):
    rows = table("lineitem").select("l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("score"), (F.col("l_linestatus") == "O").alias("direct"))
    out = citations.by_file(rows, "l_suppkey", "l_linenumber", "score", "direct")
    return out.withColumn("pages", F.array_join("pages", ","))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey % 1000 AS a, l_orderkey % 1000 + CAST(l_quantity AS INT) AS b FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
g AS (SELECT l_suppkey, min(a) AS a, max(b) AS b FROM i GROUP BY l_suppkey, k),
t AS (SELECT l_suppkey, string_agg(a || '-' || b, ', ' ORDER BY a) AS lines FROM g GROUP BY l_suppkey)
SELECT l.l_suppkey, count(*) AS chunks, any_value(t.lines) AS lines FROM lineitem l LEFT JOIN t USING (l_suppkey) GROUP BY l.l_suppkey""")
def citation_lines(spark, table):
    """Citations by file with their merged lines; rows that were not returned have none."""
    at = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey") % 1000)
    rows = table("lineitem").select("l_suppkey", "l_linenumber", "l_discount", F.lit(True).alias("direct"), at.alias("a"), (at + F.col("l_quantity").cast("int")).alias("b"))
    out = citations.by_file(rows, "l_suppkey", "l_linenumber", "l_discount", "direct", "a", "b")
    return out.select("l_suppkey", "chunks", F.array_join(F.transform("lines", lambda x: F.concat_ws("-", x["start"], x["end"])), ", ").alias("lines"))


@query("SELECT vec_id, vec_id // 50 AS request, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def embedding_replies(spark, table):
    """Requests of up to 50 vectors whose replies come in three shapes, one of them out of order, brought back to their ids."""
    rows = table("embeddings").select("vec_id", F.expr("vec_id div 50").alias("request"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("x"))  # 50 vectors at most
    numbered = F.transform("x", lambda r, n: F.struct(r["v"].alias("embedding"), n.alias("index")))
    shapes = [F.to_json(F.struct(F.reverse(numbered).alias("data"))), F.to_json(F.struct(F.col("x.v").alias("embeddings"))), F.to_json(F.col("x.v"))]
    body = F.when(F.col("request") % 3 == 0, shapes[0]).when(F.col("request") % 3 == 1, shapes[1]).otherwise(shapes[2])
    each = asked.select("request", F.explode(F.arrays_zip(F.col("x.vec_id").alias("vec_id"), reply_vectors(body).alias("v"))).alias("r"))
    return each.select("r.vec_id", "request", F.round(F.col("r.v")[0], 5).alias("first"))


_TAGS = "MAP {" + ", ".join(f"'{name}': '" + text.replace("\n", "' || chr(10) || '") + "'" for name, text in tx.TAG_TEXT.items()) + "}"


@query(rf"""WITH pieces AS (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+|<') AS p FROM pages),
plain AS (SELECT page_id, array_to_string(list_transform(p, lambda x: CASE WHEN NOT regexp_full_match(x, '<[^>]+>') THEN x
   WHEN regexp_matches(x, '(?i)^<img[^>]*src="OCR_IMG_[0-9]+"') THEN chr(10) || '%%OCR_IMG_' || regexp_extract(x, '(?i)src="OCR_IMG_([0-9]+)"', 1) || '%%' || chr(10)
   ELSE coalesce(({_TAGS})[lower(regexp_extract(x, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1))], '') END), '') AS t FROM pieces),
shown AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)) AS t FROM plain)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{00A0}}]+', ''), '[\s\x{{00A0}}]+$', '') AS text FROM shown""")
def html_to_text(spark, table):
    return table("pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, sha256(text) AS hash, 's:' || sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS key FROM documents".replace("\\\\", "\\"))
def content_hashes(spark, table):
    docs = table("documents")
    return docs.select("doc_id", hashing.content_hash(F.col("text")).alias("hash"), hashing.cache_key_hash(F.col("text")).alias("key"))


@query("SELECT label, count(*) AS chunks, count(*) FILTER (WHERE len(embedding) > 0) AS with_embedding FROM embeddings GROUP BY ROLLUP (label)")
def chunk_stats(spark, table):
    return vector.chunk_stats(table("embeddings"), "label")


@query("SELECT vec_id AS key, label AS last_used_at FROM embeddings ORDER BY label DESC, vec_id LIMIT 300")
def cache_recency(spark, table):
    cache = table("embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("last_used_at"))
    return select.keep_recent(cache, most=400, left=300)


@query("""SELECT url, CASE WHEN regexp_matches(url, '/(node_modules|vendor|dist)/') THEN 'path' WHEN length(trim(html)) = 0 THEN 'empty' WHEN length(html) > 3000 THEN 'large' END AS reason FROM
 (SELECT 'r/' || (['src', 'vendor', 'dist', 'lib'])[page_id % 4 + 1] || '/f' || page_id || '.html' AS url, html FROM pages)""")
def repo_filter(spark, table):
    folder = F.element_at(F.array(*map(F.lit, ("src", "vendor", "dist", "lib"))), (F.col("page_id") % 4 + 1).cast("int"))
    files = table("pages").select(F.concat(F.lit("r/"), folder, F.lit("/f"), F.col("page_id").cast("string"), F.lit(".html")).alias("url"), "html")
    return files.select("url", repo.skip_reason(F.col("url"), F.col("html"), 3000).alias("reason"))


@query("SELECT doc_id, (unnest(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda x: trim(x[1], ' ') <> '')))[2]::INT AS unit FROM documents WHERE text IS NOT NULL")
def numbered_units(spark, table):
    return edits.numbered_units(table("documents"), "doc_id", "text").select("doc_id", "unit")


@query("""WITH u AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, l, CASE WHEN doc_id % 5 = 0 THEN 9999 ELSE 0 END AS unit FROM u),
x AS (SELECT doc_id, unit, CASE WHEN unit < len(l) AND trim(l[unit + 1], ' ') <> '' THEN l[unit + 1] END AS t FROM e)
SELECT doc_id, unit, CASE WHEN t IS NULL THEN 0 ELSE (length(t) - length(replace(t, 'on', ''))) // 2 END AS places,
 CASE WHEN t IS NULL THEN 'missing' WHEN NOT contains(t, 'on') THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN contains(t, 'on') THEN replace(t, 'on', 'ON') END AS after FROM x""")
def edit_checks(spark, table):
    docs = table("documents")
    wanted = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 9999).otherwise(0).alias("unit"), F.lit("on").alias("find"), F.lit("ON").alias("replace"))
    out = edits.check_edits(edits.numbered_units(docs, "doc_id", "text"), wanted, "doc_id")
    return out.select("doc_id", "unit", "places", "status", "after")
