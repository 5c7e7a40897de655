"""Imports of exported records: a declared schema, versions, keys between tables, and a quarantine with reasons.

Records come as lines of JSON, each with `kind` and `version`. Nothing is dropped: a line is either a row
of its table or a row of the quarantine, with the first reason that holds:

unreadable: no JSON, or a field of another type than declared; wrong_kind; bad_version: none, or newer
than supported; missing: the id or a required field is null; bad_date: a date that is neither text of a
date nor milliseconds; repeated: an id that an earlier line of the table (by its text) has; orphan: a
required reference to a row that is not there, or is in the quarantine itself.

References that are not required are emptied if their row is not there. All of it are joins by keys and
windows over equal ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.sources.work import stored


@dataclass
class TableRule:
    """What rows of a table look like: fields as DDL (dates as timestamp), and references {column: table}."""

    schema: str
    kind: str
    id: str = "id"
    required: list[str] = field(default_factory=list)
    owners: dict[str, str] = field(default_factory=dict)
    optional: dict[str, str] = field(default_factory=dict)


def _date(c: Column) -> Column:
    """A date as JSON has it: text, or milliseconds since 1970."""
    return F.coalesce(F.timestamp_millis(c.try_cast("long")), c.try_cast("timestamp"))


def _parsed(lines: DataFrame, rule: TableRule, version: int) -> DataFrame:
    """line, _n, the fields of the rule and _reason, for what a line tells by itself."""
    declared = T.StructType.fromDDL(rule.schema)
    dates = [f.name for f in declared if isinstance(f.dataType, T.TimestampType)]
    asked = T.StructType([T.StructField(f.name, T.StringType() if f.name in dates else f.dataType) for f in declared])
    asked = asked.add("kind", T.StringType()).add("version", T.DoubleType()).add("_corrupt", T.StringType())
    json = F.from_json("line", asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("line", "_n", json.alias("_j")).select("line", "_n", "_j.*")
    whole = F.col("_corrupt").isNotNull() | ~F.coalesce(F.trim("line").startswith("{"), F.lit(False))
    lacking = F.lit(False)
    for name in [rule.id, *rule.required, *rule.owners]:
        lacking = lacking | F.col(name).isNull()
    undated = F.lit(False)
    for name in dates:
        undated = undated | (F.col(name).isNotNull() & _date(F.col(name)).isNull())
    reason = (
        F.when(whole, "unreadable").when(~F.col("kind").eqNullSafe(rule.kind), "wrong_kind").when(F.col("version").isNull() | (F.col("version") > version), "bad_version")
        .when(lacking, "missing").when(undated, "bad_date")
    )
    return rows.withColumn("_reason", reason).withColumns({d: _date(F.col(d)) for d in dates}).drop("kind", "version", "_corrupt")


def _first_of_id(rows: DataFrame, id_col: str) -> DataFrame:
    """rows with the reason `repeated` for all but the first good line of an id; a hot id is counted before it is shuffled."""
    good = rows.where("_reason is null")
    first = good.groupBy(id_col).agg(F.min("line").alias("_first"))
    # Equal lines of one id: the one with the smallest number stays.
    number = good.groupBy(id_col, "line").agg(F.min("_n").alias("_least"))
    keep = number.join(first, id_col).where(F.col("line") == F.col("_first")).select(F.col(id_col).alias("_id"), "_least")
    out = rows.join(keep, (F.col(id_col) == F.col("_id")) & (F.col("_n") == F.col("_least")), "left")
    return out.withColumn("_reason", F.when(F.col("_reason").isNull() & F.col("_id").isNull(), "repeated").otherwise(F.col("_reason"))).drop("_id", "_least")


def checked(lines: dict[str, DataFrame], rules: dict[str, TableRule], version: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows}, quarantine of (part, line, reason)) of lines (line) of each table; owners stand before what they own in rules."""
    good: dict[str, DataFrame] = {}
    bad = None
    for name, rule in rules.items():
        if name not in lines:
            continue
        numbered = stored(lines[name].select("line").withColumn("_n", F.monotonically_increasing_id()), "lines")
        rows = stored(_first_of_id(_parsed(numbered, rule, version), rule.id), "parsed")
        for column, owner in {**rule.owners, **rule.optional}.items():
            if owner == name:  # of a table to itself: those of its rows that are good so far
                known = rows.where("_reason is null").select(F.col(rule.id).alias("_owner"))
            else:
                known = good[owner].select(F.col(rules[owner].id).alias("_owner")) if owner in good else rows.select(F.col(column).alias("_owner")).limit(0)
            rows = rows.join(known, F.col(column) == F.col("_owner"), "left")
            if column in rule.owners:
                rows = rows.withColumn("_reason", F.when(F.col("_reason").isNull() & F.col("_owner").isNull(), "orphan").otherwise(F.col("_reason")))
            else:
                rows = rows.withColumn(column, F.col("_owner"))
            rows = rows.drop("_owner")
        rows = stored(rows, "checked")
        good[name] = rows.where("_reason is null").drop("line", "_reason", "_n")
        out = rows.where("_reason is not null").select(F.lit(name).alias("part"), "line", F.col("_reason").alias("reason"))
        bad = out if bad is None else bad.unionByName(out)
    return good, bad


def read_import(spark: SparkSession, path: str, rules: dict[str, TableRule], version: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """checked of the folders path/table of JSON lines; a table without a folder is left out."""
    lines = {}
    for name in rules:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            lines[name] = spark.read.text(f"{path}/{name}").withColumnRenamed("value", "line").where("trim(line) <> ''")
    return checked(lines, rules, version)
