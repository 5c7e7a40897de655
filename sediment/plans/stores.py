"""Queries over stores that are written, changed and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sediment.plans.registry import query
from sediment.sources.imports import TableRule, checked
from sediment.sources.store import ChunkStore, VersionedStore
from sediment.sources.work import work_root


@query("""SELECT source AS project_id, doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE md5(coalesce(text, '')) END AS content
FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 10 = 0""")
def chunk_store_replaced(spark, table):
    """A store of all documents, of which a tenth is replaced and some are deleted."""
    rows = table("documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    store = ChunkStore(spark, f"{work_root(spark)}/sediment-chunks-{uuid.uuid4().hex}", rows.schema, parts=4)
    store.replace(rows.select("project_id", "document_id"), rows)
    store.delete(rows.where("document_id % 7 = 3").select("project_id", "document_id"))
    new = rows.where("document_id % 10 = 0").withColumn("content", F.lit("new"))
    store.replace(new.select("project_id", "document_id"), new)
    return store.read()


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE lang = 'fr')
SELECT 1 AS version, 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 1, 'labels', count(*) FROM labels
UNION ALL SELECT 2, 'documents', count(*) FROM documents WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 2, 'labels', count(*) FROM labels WHERE doc_id NOT IN (FROM gone)""")
def versioned_cascade(spark, table):
    """Two tables before and after a cascade that was published at once."""
    store = VersionedStore(spark, f"{work_root(spark)}/sediment-store-{uuid.uuid4().hex}")
    store.publish({"documents": table("documents").select("doc_id", "lang"), "labels": table("labels")})
    store.delete_cascade({"documents": "doc_id", "labels": "doc_id"}, store.read("documents").where("lang = 'fr'"), "doc_id")
    counts = [store.read(part, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(part).alias("part"), "n") for v in (1, 2) for part in ("documents", "labels")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


RULES = {
    "conversations": TableRule("id long, title string", "export"),
    "messages": TableRule("id long, conversation_id long, created timestamp, parent_id long", "export", owners={"conversation_id": "conversations"}, optional={"parent_id": "messages"}),
}


@query("""WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 11 = 5 THEN 'wrong_kind' WHEN conv_id % 11 = 3 THEN 'bad_version' ELSE 'ok' END AS reason FROM conversations),
m AS (SELECT m.conv_id, turn, CASE WHEN turn % 7 = 4 THEN 'unreadable' WHEN turn % 7 = 2 THEN 'bad_date' WHEN c.reason <> 'ok' THEN 'orphan' ELSE 'ok' END AS reason FROM conversations m JOIN c USING (conv_id)),
twice AS (SELECT CASE WHEN reason IN ('ok', 'orphan') THEN 'repeated' ELSE reason END AS reason FROM m WHERE conv_id % 4 = 1)
SELECT 'conversations' AS part, reason, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'messages', reason, count(*) FROM (SELECT reason FROM m UNION ALL FROM twice) GROUP BY ALL""")
def import_quarantine(spark, table):
    """An export of all conversations with broken lines, kinds, versions, dates and repeats: rows accepted, and refused by reason."""
    rows = table("conversations")
    kind, version = F.when(F.col("conv_id") % 11 == 5, "other").otherwise("export").alias("kind"), F.when(F.col("conv_id") % 11 == 3, 9).otherwise(1).alias("version")
    convs = rows.select("conv_id").distinct().select(F.to_json(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("c"), "conv_id").alias("title"), kind, version)).alias("line"))
    created = F.when(F.col("turn") % 7 == 2, "no date").when(F.col("turn") % 2 == 0, "1700000000000").otherwise("2024-05-01T10:00:00Z").alias("created")
    line = F.to_json(F.struct((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), created, F.lit("export").alias("kind"), F.lit(1).alias("version")))
    messages = rows.withColumn("line", line).withColumn("line", F.when(F.col("turn") % 7 == 4, F.expr("substring(line, 1, length(line) - 9)")).otherwise(F.col("line")))
    messages = messages.select("conv_id", "line").unionByName(messages.where("conv_id % 4 = 1").select("conv_id", "line"))
    good, bad = checked({"conversations": convs, "messages": messages.select("line")}, RULES, version=1)
    out = bad.groupBy("part", "reason").agg(F.count("*").alias("n"))
    for name, kept in good.items():
        out = out.unionByName(kept.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), F.lit("ok").alias("reason"), "n").where("n > 0"))
    return out
