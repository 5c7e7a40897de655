"""Conversation queries: estimates, windows, collapse, forks, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import text as tx
from sediment.operators import conversation as cv
from sediment.operators import edits, evaluation
from sediment.plans.registry import query
from sediment.streaming import events as ev

_EST = "CAST(ceil((length(coalesce(text, '')) - code) / 3.5) + ceil(code / 4) AS INT)"
_CODE = "(SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '(?s)```.*?```'), lambda x: length(x))), 0) AS code FROM conversations)"
_COST = f"(SELECT conv_id, turn, role, text, {_EST} + 4 AS tokens FROM {_CODE})"


@query(f"SELECT conv_id, turn, {_EST} AS tokens FROM {_CODE}")
def token_estimate(spark, table):
    return table("conversations").select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {_COST})
SELECT conv_id, turn, used FROM w WHERE used <= 150 OR n <= 2""")
def message_window(spark, table):
    return cv.message_window(table("conversations"), 150, 2).select("conv_id", "turn", "used")


@query(f"""WITH w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {_COST}),
a AS (SELECT conv_id, count(*) - count(*) FILTER (WHERE used <= 100 OR n <= 2) AS window_start, sum(tokens) AS total FROM w GROUP BY conv_id)
SELECT conv_id, window_start, total, 1 AS from_message, window_start AS to_message FROM a WHERE window_start > 1 AND total > 120""")
def summary_trigger(spark, table):
    messages = table("conversations")
    done = messages.select("conv_id").distinct().withColumn("summarized_count", F.lit(1))
    return cv.summary_trigger(messages, cv.message_window(messages, 100, 2), 120, done)


@query("""SELECT conv_id, turn, CASE WHEN n > 2 AND role = 'assistant' AND length(text) > 80 THEN substr(text, 1, 80) || chr(10) || chr(10) || '[… cut]' ELSE text END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)""")
def context_collapse(spark, table):
    return cv.collapse_old_replies(table("conversations"), keep=2, most=80).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, conv_id % 3 = 0 AND turn >= 2 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 2) AS rewound FROM conversations c")
def rewound_messages(spark, table):
    messages = table("conversations")
    targets = messages.where("conv_id % 3 = 0").select("conv_id").distinct().withColumn("from_turn", F.lit(2).cast("long"))
    return cv.rewind_from(messages, targets).select("conv_id", "turn", "rewound")


@query("SELECT conv_id + 1000000 AS conv_id, turn, conv_id AS forked_from FROM conversations WHERE conv_id % 5 = 0 AND turn <= 1")
def fork_prefix(spark, table):
    messages = table("conversations")
    forks = messages.where("conv_id % 5 = 0").select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("at_turn"), (F.col("conv_id") + 1000000).alias("new_conv"))
    return cv.fork(messages, forks).select("conv_id", "turn", "forked_from")


_FORKS = "(SELECT DISTINCT conv_id, CASE WHEN conv_id % 7 = 0 THEN -1 ELSE conv_id // 2 END AS parent_id FROM conversations)"


@query(f"""WITH RECURSIVE t(conv_id, root, depth) AS (
  SELECT conv_id, conv_id, 0 FROM {_FORKS} n WHERE parent_id NOT IN (SELECT conv_id FROM {_FORKS})
  UNION ALL SELECT n.conv_id, t.root, t.depth + 1 FROM {_FORKS} n JOIN t ON n.parent_id = t.conv_id)
SELECT conv_id, root, depth FROM t""")
def fork_tree_depth(spark, table):
    ids = table("conversations").select("conv_id").distinct()
    parent = F.when(F.col("conv_id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.expr("conv_id div 2"))
    return cv.fork_depth(ids.withColumn("parent_id", parent))


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) > 0 AND (length(text) > 600 OR len(string_split(text, chr(10))) > 10)")
def large_pastes(spark, table):
    return table("conversations").where(tx.large_paste(F.col("text"))).select("conv_id", "turn")


@query("SELECT conv_id, count(*) AS runs, count(*) FILTER (WHERE length(text) < 400) AS passed, bool_and(length(text) < 400) AS all_passed FROM conversations GROUP BY conv_id")
def repeated_runs(spark, table):
    runs = table("conversations").select(F.col("conv_id").alias("case_id"), (F.length("text") < 400).alias("passed"))
    return evaluation.repeated_runs(runs).withColumnRenamed("case_id", "conv_id")


@query("SELECT c.conv_id, string_agg(text, '' ORDER BY turn) AS content, arg_max(role, turn) AS finish_reason FROM conversations c GROUP BY c.conv_id")
def stream_replies(spark, table):
    rows = table("conversations")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.col("role").alias("finish_reason"))).alias("choices")))
    parsed = ev.parse_sse(rows.select("conv_id", "turn", F.concat(F.lit("data: "), delta).alias("data")))
    return ev.replies(parsed, "conv_id", "turn").select("conv_id", "content", "finish_reason")


@query("SELECT conv_id, turn, before, text AS after FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND text IS NOT NULL")
def word_differences(spark, table):
    """Each turn beside the one before it: both texts put together again from the difference. (That it is a shortest one is tested against brute force.)"""
    turns = table("conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null and text is not null")
    ops = turns.select("conv_id", "turn", edits.word_diff("before", "text").alias("ops"))

    def side(left_out: str):
        return F.array_join(F.transform(F.filter("ops", lambda o: o["op"] != left_out), lambda o: o["text"]), "")

    return ops.select("conv_id", "turn", side("added").alias("before"), side("removed").alias("after"))
