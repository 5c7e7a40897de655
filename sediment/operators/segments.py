"""Running values over ordered groups of any size: sums, maxima and carried values.

A window sorts each group in one task, which is done where the largest group, counted first, has at most
WHOLE_ROWS rows. Beyond that the rows are cut into ranges of (group, order), stored, and
every part is summarised; the summaries of a group, one for each part it spans, are scanned in their
order, and each part is finished with what is carried in. So a group that holds a third of all rows is
worked on by as many tasks as its share of the rows, and none sorts more than a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.sources.work import stored

#: Rows of a group that one task may sort.
WHOLE_ROWS = 1_000_000


class Segments:
    """rows in the order of groups and of columns in them, to be scanned.

    Rows that are equal in these have an arbitrary order, the same in all scans. Null groups are groups.
    """

    def __init__(self, rows: DataFrame, group: list[str], order: list):
        keys, self.group = [*group, *order, "_row"], group
        self.whole = (rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= WHOLE_ROWS
        if self.whole:
            self.rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
            return
        rows = rows.withColumn("_row", F.monotonically_increasing_id())  # so that equal rows need not share a range
        ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        self.rows = stored(ranged.withColumns({"_row": F.monotonically_increasing_id(), "_part": F.spark_partition_id(), "_group": F.struct(*group)}), "ranged")

    def scan(
        self, rows: DataFrame | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False
    ) -> DataFrame:
        """rows (of this object, or made from its rows) with running sums, maxima and last values that are not null.

        A value covers the rows up to its own, or with before=True those before it: a sum of none is null.
        """
        rows = self.rows if rows is None else rows
        kinds: list[tuple[dict[str, Column], Callable, Callable]] = [
            (sums or {}, F.sum, lambda carried, own: F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0)))),
            (maxima or {}, F.max, lambda carried, own: F.greatest(carried, own)),
            (lasts or {}, lambda c: F.last(c, ignorenulls=True), lambda carried, own: F.coalesce(own, carried)),
        ]
        asked = [(name, value, f, join) for values, f, join in kinds for name, value in values.items()]
        if self.whole:
            own = Window.partitionBy(*self.group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
            return rows.withColumns({name: f(value).over(own) for name, value, f, _ in asked})
        inner = Window.partitionBy("_group", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        # The last value of a part is that of its last row that has one.
        totals = [F.max_by(v, F.when(v.isNotNull(), F.col("_row"))) if n in (lasts or {}) else f(v) for n, v, f, _ in asked]
        parts = rows.groupBy("_group", "_part").agg(*[t.alias(f"_total{k}") for k, t in enumerate(totals)])
        parts = parts.select("_group", "_part", *[f(F.col(f"_total{k}")).over(earlier).alias(f"_carried{k}") for k, (_, _, f, _) in enumerate(asked)])
        parts = stored(parts, "parts")  # one row for each group and range; its size tells Spark how to join it
        out = rows.withColumns({f"_own{k}": f(v).over(inner) for k, (_, v, f, _) in enumerate(asked)}).join(parts, ["_group", "_part"])
        out = out.withColumns({name: join(F.col(f"_carried{k}"), F.col(f"_own{k}")) for k, (name, _, _, join) in enumerate(asked)})
        return out.drop(*[f"_own{k}" for k in range(len(asked))], *[f"_carried{k}" for k in range(len(asked))])

    def kept(self, rows: DataFrame) -> DataFrame:
        """rows made from a scan, to be scanned again: stored, unless that is one more window over the same groups."""
        return rows if self.whole else stored(rows, "kept")

    @staticmethod
    def plain(rows: DataFrame) -> DataFrame:
        """rows without what the scans need."""
        return rows.drop("_group", "_part", "_row")
