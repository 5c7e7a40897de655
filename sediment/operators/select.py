"""Selection under budgets: greedy packs, first of equal contents, diverse results, recency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.segments import Segments


def pack_stop(rows: DataFrame, group: list[str], order: list, cost: str, budget: float) -> DataFrame:
    """The rows of each group, in order, up to the first whose running cost is over the budget; costs are not negative.

    The order may be of any type. A large group is cut in parts, whose costs are added up first (see Segments).
    """
    parts = Segments(rows, group, order)
    return parts.plain(parts.scan(sums={"used": F.col(cost)}).where(F.col("used") <= budget))


def pack_skip(rows: DataFrame, group: list[str], order: str, cost: str, budget: float, row_id: str, most: int | None = None) -> DataFrame:
    """(group, row_id, used) of the rows that fit one after another; a row that does not fit is passed over, as are all after `most`.

    What fits depends on all that went before, so a group's ids and costs are gone through in one task;
    they stream by in order, many groups to a task, and only the running cost is held. Rows over the
    budget by themselves, or without a cost, are left out before the shuffle.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*(T.StructField(g, kinds[g]) for g in group), T.StructField(row_id, kinds[row_id]), T.StructField("used", T.DoubleType())])

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used, count = None, 0.0, 0
        for part in parts:
            keys = zip(*(part.column(g).to_pylist() for g in group), strict=True)
            kept, sums = [], []
            for n, (key, x) in enumerate(zip(keys, part.column("_cost").to_pylist(), strict=True)):
                if key != own:
                    own, used, count = key, 0.0, 0
                if used + x <= budget and (most is None or count < most):
                    used, count = used + x, count + 1
                    kept.append(n)
                    sums.append(used)
            yield part.drop_columns(["_order", "_cost"]).take(pa.array(kept, pa.int64())).append_column("used", pa.array(sums, pa.float64()))

    slim = rows.select(*group, row_id, F.col(order).alias("_order"), F.col(cost).cast("double").alias("_cost")).where(F.col("_cost") <= budget)
    return slim.repartition(*group).sortWithinPartitions(*group, F.asc_nulls_last("_order"), row_id).mapInArrow(choose, schema)


def first_of_equal(rows: DataFrame, content: str, order: list) -> DataFrame:
    """One row of each content, the first in order."""
    w = Window.partitionBy(F.sha2(F.col(content), 256)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mmr(candidates: DataFrame, group: str, k: int, weight: float | str = 0.7, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over (group, id, vector, score): the best first, then the largest
    weight * score - (1 - weight) * (largest cosine to a chosen one, 0 at least). weight may name a column. A group is
    one query's candidates."""
    schema = T.StructType([candidates.schema[group], candidates.schema[id_col], T.StructField("position", T.IntegerType()), T.StructField("mmr", T.DoubleType())])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", id_col], ascending=[False, True])
        x = np.array(part[vector_col].tolist(), "f8")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        share = float(part["_weight"].iloc[0])
        score, near, open_, out = part["score"].to_numpy("f8"), np.zeros(len(part)), np.ones(len(part), bool), []
        for position in range(min(k, len(part))):
            value = np.where(open_, share * score - (1 - share) * near if position else score, -np.inf)
            at = int(np.argmax(value))
            out.append((part[group].iloc[at], part[id_col].iloc[at], position, float(value[at])))
            open_[at] = False
            near = np.maximum(near, x @ x[at])
        return pd.DataFrame(out, columns=[f.name for f in schema])

    share = F.col(weight) if isinstance(weight, str) else F.lit(weight)
    return candidates.select(group, id_col, vector_col, "score", share.alias("_weight")).groupBy(group).applyInPandas(choose, schema)


def keep_recent(cache: DataFrame, most: int = 5000, left: int = 4500, used_col: str = "last_used_at", key: str = "key") -> DataFrame:
    """The cache, or its `left` most recently used entries once it holds over `most`."""
    total = cache.agg((F.count("*") > most).alias("full"))
    kept = cache.orderBy(F.desc(used_col), key).limit(left)
    whole = cache.crossJoin(F.broadcast(total)).where("not full").drop("full")
    return whole.unionByName(kept.crossJoin(F.broadcast(total)).where("full").drop("full"))
