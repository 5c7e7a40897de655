"""Merkle manifest of a table: leaves of rows, a subroot for each group, one root, and a proof for each row.

1. Each row gives a leaf, the digest of its fields; only narrow rows go on from there.
2. Rows get their place in the group by ranges: sorted ranges of (group, id) are stored, the rows of each
   group in each range are counted, and sums of the counts tell where a range begins. No group is
   ranked in one task.
3. Levels are windows: a node's parent is its place divided by `arity`; over all nodes of a parent an
   ordered full-frame collect_list gives the parent's preimage and each node's siblings. One node of
   each parent goes on, as the parent, to the next level, which is stored; levels shrink by `arity`.
4. The subroots form the leaves of a last tree by the same steps, in the order of the groups.
5. Proofs go down: a node's path is its own siblings followed by its parent's path, so that a level is
   joined with one `arity`-th as many rows, and only once.

Defined results: null fields are `-`; a null group is a group of its own, before all others; rows of a
null id come first in their group; rows with the same id go by their leaves, and equal rows are leaves
of their own; a group of one row has its leaf as subroot; a table with one group has its subroot as root; an
empty table has no root and no proofs; texts of any length are hashed whole; other columns pass through
`prove` (those named g, pos, size, digest, path, subroot or root are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import materialize, plain_name, work_folder

OWN = ["g", "pos", "size", "digest", "path", "subroot", "root", "part", "row", "parent", "kids"]


def digest(c: Column) -> Column:
    """Lowercase hex sha256 of the UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(*fields: str | Column) -> Column:
    """The digest of fields, each as byte count, colon and value, or `-` if it is null."""
    parts = []
    for field in fields:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda d, s: digest(F.concat(s["before"], d, s["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class Manifest:
    levels: list[DataFrame]  # (g, pos, size, digest), leaves first
    tops: DataFrame  # (g, pos, size, digest): the subroots in order
    upper: list[DataFrame]  # levels above the subroots
    arity: int
    folder: str

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return self.upper[-1].select(F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """(group, level, pos, digest) of all nodes; the group is null for a null group and above the subroots, where level is negative."""
        group = F.when(F.substring("g", 1, 1) == "1", F.expr("substring(g, 2)")).alias("group")
        rows = [n.select(group, F.lit(k).alias("level"), "pos", "digest") for k, n in enumerate(self.levels)]
        rows += [n.select(F.lit(None).cast("string").alias("group"), F.lit(-k).alias("level"), "pos", "digest") for k, n in enumerate(self.upper) if k]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out


def _placed(rows: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """rows with pos, their place in g by keys, and size, the rows of g.

    The last key is the number of the row as it is read, so that equal rows need not share a range.
    """
    keys = ["g", *keys, "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), folder, f"{name}-ranged")
    counts = ranged.groupBy("g", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))  # groups + ranges at most
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    counts = materialize(counts, folder, f"{name}-counts")
    return ranged.join(counts, ["g", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _families(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes with their parent's place and all kids of the parent, in order."""
    nodes = nodes.withColumn("parent", F.call_function("div", F.col("pos"), F.lit(arity)))
    frame = Window.partitionBy("g", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("kids", F.collect_list("digest").over(frame))


def _climb(leaves: DataFrame, arity: int, folder: str, name: str) -> list[DataFrame]:
    """The levels from the leaves up; each holds the nodes of groups that had several nodes below."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        family = _families(levels[-1].where("size > 1").select("g", "pos", "size", "digest"), arity)
        parents = family.where(F.col("pos") % arity == 0)  # one node of each parent
        size = F.call_function("div", F.col("size") + (arity - 1), F.lit(arity))
        parents = parents.select("g", F.col("parent").alias("pos"), size.alias("size"), digest(F.array_join("kids", "")).alias("digest"))
        levels.append(materialize(parents, folder, f"{name}-{len(levels)}"))
        most = -(-most // arity)
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int, folder: str, name: str) -> DataFrame:
    """The first level with the path of each node; tops (g, path and more columns) is what the last node of each group has."""
    more = [c for c in tops.columns if c != "g"]
    below = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        found = nodes.where("size = 1").join(tops, "g")
        if below is not None:
            above = below.select("g", F.col("pos").alias("parent"), *more)
            at = (F.col("pos") % arity).cast("int")
            own = F.struct(
                F.array_join(F.slice("kids", F.lit(1), at), "").alias("before"), F.array_join(F.slice("kids", at + 2, F.lit(arity)), "").alias("after")
            )
            kin = _families(nodes.where("size > 1"), arity).join(above, ["g", "parent"])
            found = found.unionByName(kin.withColumn("path", F.concat(F.array(own), "path")).drop("parent", "kids"))
        below = materialize(found, folder, f"{name}-path-{k}") if k else found
    return below


def build(rows: DataFrame, id_col: str, group_col: str, leaf_col: str, arity: int = 8) -> Manifest:
    """The manifest of rows that hold their leaf; their other columns stay with the leaves."""
    folder = work_folder(rows.sparkSession)
    kept = [c for c in plain_name(rows, OWN).columns if c not in (leaf_col,)]
    group = F.col(group_col).cast("string")
    # One key for null and all else, in the order of the groups.
    coded = F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("g")
    leaves = materialize(rows.select(coded, *kept, F.col(leaf_col).alias("digest")), folder, "leaves")
    levels = _climb(_placed(leaves, [id_col, "digest"], folder, "leaves"), arity, folder, "level")
    tops = levels[0].select("g", "size", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.select("g", "size", "digest"))
    tops = materialize(tops.where("size = 1").select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), folder, "tops")
    tops = _placed(tops, ["group"], folder, "tops")
    return Manifest(levels, tops, _climb(tops, arity, folder, "upper"), arity, folder)


def prove(manifest: Manifest) -> DataFrame:
    """The rows of the manifest with digest (the leaf), subroot, root and path, an array of (before, after) from the leaf to the root."""
    m = manifest
    none = F.array().cast("array<struct<before: string, after: string>>")
    root = m.upper[-1].where("size = 1").select("g", F.col("digest").alias("root"), none.alias("path"))
    tops = _descend(m.upper, root, m.arity, m.folder, "upper")
    tops = materialize(tops.select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "path"), m.folder, "top-paths")
    return _descend(m.levels, tops, m.arity, m.folder, "level").drop("g", "pos", "size")


def lowered_copy(c: Column) -> Column:
    """A tampered copy: A-Z lowered."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
