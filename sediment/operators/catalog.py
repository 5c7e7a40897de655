"""Tables of projects, conversations and documents: cascades, orphans, imports, version compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import formats as fm


def orphans(chunks: DataFrame, files: DataFrame, key: str, file_key: str, scoped: Column | None = None) -> DataFrame:
    """Chunks whose document is gone; chunks of a conversation (scoped) have none to lose."""
    kept = chunks if scoped is None else chunks.where(~scoped)
    return kept.join(files.select(F.col(file_key).alias(key)).distinct(), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, str], gone: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """Each table less the rows whose key is among the ids of gone."""
    ids = gone.select(F.col(id_col).alias("_gone")).distinct()
    return {n: t.join(ids, t[keys[n]] == ids["_gone"], "left_anti") if n in keys else t for n, t in tables.items()}


def remap(rows: DataFrame, ids: DataFrame, column: str, required: bool) -> DataFrame:
    """rows with column replaced by its new id from (old_id, new_id): a row without one goes if required, else loses the reference."""
    out = rows.join(ids, rows[column] == ids["old_id"], "inner" if required else "left")
    return out.withColumn(column, F.col("new_id")).drop("old_id", "new_id")


def only_new(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of an import whose id the store does not hold; repeated ids come once."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def bulk_get(keys: DataFrame, store: DataFrame, key: str, ordinal: str) -> DataFrame:
    """keys in their order with the store's row, null where it has none."""
    return keys.join(store, key, "left").orderBy(ordinal)


def before_week(logs: DataFrame, week: str, column: str = "week_start") -> DataFrame:
    """The log without weeks before `week`."""
    return logs.where(F.col(column) >= F.lit(week))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by numbers; a missing part is 0."""
    def parts(c: Column) -> Column:
        nums = F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.expr("null").cast("int"), F.regexp_extract(x, r"^\D*(\d*)", 1).try_cast("int"), F.lit(0)))
        return F.slice(F.concat(nums, F.array_repeat(F.lit(0), 8)), 1, 8)

    return F.when(parts(a) < parts(b), -1).when(parts(a) > parts(b), 1).otherwise(0)


def reuse_vectors(new: DataFrame, known: DataFrame, hash_col: str, vector_col: str, order: list) -> DataFrame:
    """new chunks with the vector of the first known chunk of equal hash, null where one must be computed."""
    first = known.where(F.size(vector_col) > 0).groupBy(hash_col).agg(F.min_by(vector_col, F.struct(*order)).alias(vector_col))
    return new.join(first, hash_col, "left")


def match_models(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(id, best, priority): for each row of asked (id, name), the smallest id of offered (id, name) of the best match_priority.

    Names, keys and key prefixes of offered are brought to one row each before they meet asked by equality.
    """

    def starts(c: str) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))).alias("at")

    def met(a: DataFrame, b: DataFrame, priority: int) -> DataFrame:
        return a.join(b.groupBy("at").agg(F.min("best").alias("best")), "at").select("name", F.lit(priority).alias("priority"), "best")

    names = asked.select("name").distinct().withColumn("key", fm.model_key(F.col("name")))
    by_name = offered.groupBy(F.col("name").alias("at")).agg(F.min("id").alias("best"))
    by_key = by_name.groupBy(fm.model_key(F.col("at")).alias("key")).agg(F.min("best").alias("best"))
    exact = met(names.select("name", F.col("name").alias("at")), by_name, 1)
    own, key = names.select("name", F.col("key").alias("at")), by_key.select(F.col("key").alias("at"), "best")
    equal = met(own, key, 2)
    longer = met(own, by_key.select(starts("key"), "best"), 3)
    shorter = met(names.select("name", starts("key")), key, 3)
    every = exact.unionByName(equal).unionByName(longer).unionByName(shorter)
    best = every.groupBy("name").agg(F.min(F.struct("priority", "best")).alias("m"))
    return asked.select("id", "name").join(best, "name").select("id", "m.best", "m.priority")


def without_project(conversations: DataFrame, project: str = "project_id") -> DataFrame:
    return conversations.where(F.col(project).isNull())


def favourites(conversations: DataFrame, flag: str = "favourite") -> DataFrame:
    return conversations.where(F.coalesce(F.col(flag), F.lit(False)))


def most_recent(rows: DataFrame, used: str, key: str, most: int = 3) -> DataFrame:
    """The `most` rows used last; of equally recent ones the smaller key comes first."""
    return rows.orderBy(F.desc_nulls_last(used), key).limit(most)


def purge_other_namespaces(cache: DataFrame, namespace: str, key: str = "key") -> DataFrame:
    """The cache without keys of other namespaces."""
    return cache.where(F.col(key).startswith(namespace))
