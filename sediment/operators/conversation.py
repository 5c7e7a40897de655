"""Conversation windows: what of a conversation is sent, cut, summarised, hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.text import token_estimate
from sediment.operators.segments import Segments
from sediment.sources.work import stored

MARK = "\n\n[… cut]"


def message_window(messages: DataFrame, budget: int, least: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The last messages of each conversation whose tokens (four more for each) fit the budget, and at least the last `least`."""
    back = Segments(messages.withColumn("tokens", token_estimate(F.col(text)) + 4), [conv], [F.desc(turn)])
    out = back.scan(sums={"used": F.col("tokens"), "_n": F.lit(1)})
    return back.plain(out.where((F.col("used") <= budget) | (F.col("_n") <= least)).drop("_n"))


def summary_trigger(messages: DataFrame, window: DataFrame, trigger: int, done: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, window_start, total, from_message, to_message): the messages before the window that no summary covers yet.

    done has (conv, summarized_count).
    """
    total = messages.groupBy(conv).agg(F.count("*").alias("n"), F.sum(token_estimate(F.col("text")) + 4).alias("total"))
    kept = window.groupBy(conv).agg(F.count("*").alias("kept"))
    out = total.join(kept, conv, "left").join(done, conv, "left")
    out = out.withColumn("window_start", F.col("n") - F.coalesce("kept", F.lit(0))).withColumn("from_message", F.coalesce("summarized_count", F.lit(0)))
    out = out.where((F.col("window_start") > F.col("from_message")) & (F.col("total") > trigger))
    return out.select(conv, "window_start", "total", "from_message", F.col("window_start").alias("to_message"))


def collapse_old_replies(messages: DataFrame, keep: int = 8, most: int = 800, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with assistant replies before the last `keep` messages cut to `most` characters and a mark."""
    n = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    old = (n > keep) & (F.col(role) == "assistant") & (F.length(text) > most)
    return messages.withColumn("_old", old).withColumn(text, F.when(F.col("_old"), F.concat(F.substring(text, 1, most), F.lit(MARK))).otherwise(F.col(text))).withColumnRenamed("_old", "collapsed")


def visible(messages: DataFrame) -> DataFrame:
    """The messages that are not rewound."""
    return messages.where(~F.coalesce(F.col("rewound"), F.lit(False)))


def rewind_from(messages: DataFrame, targets: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with rewound: from the first known target turn of (conv, from_turn) on, or rewound already; a turn that does not exist marks nothing."""
    known = targets.join(messages.select(conv, F.col(turn).alias("from_turn")), [conv, "from_turn"], "left_semi")
    known = known.groupBy(conv).agg(F.min("from_turn").alias("from_turn"))
    before = F.coalesce(F.col("rewound"), F.lit(False)) if "rewound" in messages.columns else F.lit(False)
    now = F.coalesce(F.col(turn) >= F.col("from_turn"), F.lit(False))
    return messages.join(known, conv, "left").withColumn("rewound", now | before).drop("from_turn")


def newly_rewound(messages: DataFrame, targets: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn) of the messages that a rewind takes away and that were not rewound before."""
    return rewind_from(visible(messages) if "rewound" in messages.columns else messages, targets, conv, turn).where("rewound").select(conv, turn)


def fork(messages: DataFrame, forks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """New conversations from (conv, at_turn, new_conv): copies of the messages up to the turn, with their origin."""
    out = messages.join(forks, conv).where(F.col(turn) <= F.col("at_turn"))
    return out.withColumn("forked_from", F.col(conv)).withColumn(conv, F.col("new_conv")).drop("new_conv")


def fork_depth(forks: DataFrame, node: str = "conv_id", parent: str = "parent_id") -> DataFrame:
    """(node, root, depth): forks whose parent is unknown are roots, however deep the tree; on a cycle and below it both are null.

    Each round doubles the length of the jumps to an ancestor, so there are as many as the depth has binary digits.
    """
    nodes = forks.select(F.col(node).alias("node"), F.col(parent).alias("up")).dropDuplicates(["node"])
    known = nodes.select(F.col("node").alias("up"), F.lit(1).alias("step"))
    jumps = nodes.join(known, "up", "left").select("node", F.when(F.col("step").isNotNull(), F.col("up")).alias("up"), F.coalesce("step", F.lit(0)).cast("long").alias("step"))
    jumps = stored(jumps.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), "jumps")
    open_, most = jumps.where("root is null"), jumps.count()
    length = 1
    while length <= most and not open_.isEmpty():
        # One jump more: to where the ancestor's own jump leads.
        far = jumps.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("step").alias("_step"), F.col("root").alias("_root"))
        jumps = jumps.join(far, "up", "left").select(
            "node", F.when(F.col("root").isNull(), F.col("_up")).alias("up"), (F.col("step") + F.when(F.col("root").isNull(), F.col("_step")).otherwise(0)).alias("step"),
            F.coalesce("root", "_root").alias("root"),
        )
        jumps = stored(jumps, "jumps")
        open_, length = jumps.where("root is null"), length * 2
    return jumps.select(F.col("node").alias(node), "root", F.when(F.col("root").isNotNull(), F.col("step")).cast("int").alias("depth"))
