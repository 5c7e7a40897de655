"""Queries of templates, repositories, fallbacks and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import text as tx
from sediment.operators import context, edits, indexing, repo
from sediment.plans.registry import query

_TEMPLATE = "'{{ name }} of ' || role || ' {{name}}' || chr(10) || '{{}} {{ turn }} {{name}} {{ name }}'"


@query(f"""WITH u AS (SELECT conv_id, turn, unnest(string_split({_TEMPLATE}, chr(10))) AS text, unnest([0, 1]) AS unit FROM conversations),
p AS (SELECT DISTINCT conv_id, turn, unit, unnest(regexp_extract_all(text, '\\{{\\{{[^}}]*\\}}\\}}')) AS find FROM u)
SELECT conv_id * 1000 + turn AS doc_id, unit, find, CASE trim(find[3:-3]) WHEN 'name' THEN 'N' || conv_id ELSE 'T' END AS replace, 'ok' AS status,
 (SELECT replace(u.text, find, CASE trim(find[3:-3]) WHEN 'name' THEN 'N' || p.conv_id ELSE 'T' END) FROM u WHERE u.conv_id = p.conv_id AND u.turn = p.turn AND u.unit = p.unit) AS after
FROM p WHERE trim(find[3:-3]) <> ''""")
def template_fill(spark, table):
    rows = table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "role")
    docs = rows.select("doc_id", F.concat(F.lit("{{ name }} of "), "role", F.lit(" {{name}}\n{{}} {{ turn }} {{name}} {{ name }}")).alias("text"))
    units = edits.numbered_units(docs, "doc_id", "text")
    values = rows.select("doc_id", F.explode(F.create_map(F.lit("name"), F.concat(F.lit("N"), F.col("conv_id").cast("string")), F.lit("turn"), F.lit("T"), F.lit("other"), F.lit(" "))).alias("name", "value"))
    return edits.check_edits(units, edits.fill(edits.placeholders(units, "doc_id"), values, "doc_id"), "doc_id").select("doc_id", "unit", "find", "replace", "status", "after")


_FILES = "SELECT 'r' || page_id % 3 AS repository, repeat('d/', (page_id % 4)::INT) || 'f' || page_id || '.py' AS path, length(html) AS size, page_id % 4 AS depth FROM pages"


@query(f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY depth, path) AS r FROM ({_FILES})),
t(repository, r, used, n, taken) AS (
  SELECT repository, r, CASE WHEN size <= 20000 THEN size ELSE 0 END, (size <= 20000)::INT, size <= 20000 FROM f WHERE r = 1
  UNION ALL SELECT f.repository, f.r, CASE WHEN t.used + size <= 20000 AND t.n < 12 THEN t.used + size ELSE t.used END,
    t.n + (t.used + size <= 20000 AND t.n < 12)::INT, t.used + size <= 20000 AND t.n < 12 FROM t JOIN f ON f.repository = t.repository AND f.r = t.r + 1)
SELECT f.repository, f.path, CASE WHEN t.taken THEN t.used::DOUBLE END AS used,
 CASE WHEN t.taken THEN NULL WHEN t.n >= 12 THEN 'file_limit' ELSE 'size_limit' END AS reason FROM t JOIN f USING (repository, r)""")
def repository_pack(spark, table):
    depth = (F.col("page_id") % 4).cast("int")
    path = F.concat(F.expr("repeat('d/', cast(page_id % 4 as int))"), F.lit("f"), F.col("page_id").cast("string"), F.lit(".py"))
    files = table("pages").select(F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("repository"), path.alias("path"), F.length("html").alias("size"), depth.alias("depth"))
    return repo.pack_files(files, "path", "size", 12, 20000).select("repository", "path", "used", "reason")


@query("""SELECT reason, count(*) AS files FROM (SELECT CASE WHEN page_id % 4 = 1 THEN 'path' WHEN page_id % 5 = 0 THEN 'language' WHEN page_id % 7 = 0 THEN 'empty' WHEN length(html) > 3000 THEN 'large' WHEN page_id % 11 = 0 THEN 'binary' END AS reason FROM pages)
WHERE reason IS NOT NULL GROUP BY reason""")
def skip_reasons(spark, table):
    n = F.col("page_id")
    path = F.concat(F.when(n % 4 == 1, "vendor/").otherwise("src/"), n.cast("string"), F.when(n % 5 == 0, ".bin").otherwise(".py"))
    text = F.when(n % 7 == 0, " ").when(n % 11 == 0, F.concat(F.substring("html", 1, 100), F.lit("\0"), F.substring(F.col("html"), F.lit(101), F.length("html")))).otherwise(F.col("html"))
    files = table("pages").select(path.alias("path"), text.alias("text"))
    language = F.when(F.col("path").endswith(".py"), "python")
    limit = F.when(F.instr("text", "\0") > 0, F.length("text") - 1).otherwise(F.length("text"))
    reason = repo.skip_reason(F.col("path"), F.col("text"), 3000, language)
    reason = F.when((reason == "large") & (limit <= 3000), "binary").otherwise(reason)
    return repo.reason_counts(files.select(reason.alias("reason")))


@query("SELECT p_partkey FROM part WHERE contains(translate(lower(translate(p_name || ' Şık', 'İI', 'iı')), 'şğıçöüâîû', 'sgicouaiu'), 'e s')")
def title_search(spark, table):
    return table("part").where(tx.matches_title(F.concat("p_name", F.lit(" Şık")), F.lit(" E Ş "))).select("p_partkey")


@query("""WITH m AS (SELECT conv_id, sum(CAST(ceil(length(coalesce(text, '')) / 3.5) AS BIGINT) + 4) AS used FROM conversations GROUP BY conv_id)
SELECT conv_id, used, CASE WHEN least(conv_id * 40, 1500) > 1600 - used - 1024 AND 1600 - used - 1024 > 256 THEN 1600 - used - 1024 ELSE least(conv_id * 40, 1500) END AS most FROM m""")
def request_limits(spark, table):
    messages = table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("content"))).alias("messages"))
    used = messages.select("conv_id", tx.request_tokens(F.col("messages")).alias("used"))
    return used.select("conv_id", "used", tx.output_limit(F.col("conv_id") * 40, F.col("used"), 1600, 1500, 512).alias("most"))


@query(r"""WITH whole AS (SELECT conv_id, turn, text, '--- ' || turn || ' ---' || chr(10) || text AS shown FROM conversations),
fenced AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(shown, '(?s)```.*?```'), lambda x: length(x))), 0) AS code FROM whole),
f AS (SELECT *, CAST(ceil((length(shown) - code) / 3.5) + ceil(code / 4) AS INT) + 1 AS cost FROM fenced),
r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) - cost AS begin FROM f)
SELECT conv_id, turn, begin + cost > 120 AS cut, CASE WHEN begin + cost > 120 THEN substr(text, 1, CAST(floor((120 - begin) * 3.5) AS INT)) ELSE text END AS content FROM r WHERE begin < 120""")
def fallback_files(spark, table):
    files = table("conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("name"), F.col("text").alias("content"))
    return context.fallback_files(files, 120, "conv_id", "turn").select("conv_id", "turn", "cut", "content")


@query()
def index_documents(spark, table):
    """Every third document indexed anew against the others, with a stand-in for the embedder; (documents, chunks, of them with a vector of another document)."""
    docs = table("documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("name"), "text")
    old = indexing.chunks_of_documents(docs.where("document_id % 3 <> 0")).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    store, _ = indexing.index_documents(docs.where("document_id % 3 = 0"), old, cache, lambda texts: [[2.0]] * len(texts))
    return store.groupBy((F.col("document_id") % 3 == 0).alias("indexed")).agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.col("embedding")[0] == 1.0).alias("reused"))
