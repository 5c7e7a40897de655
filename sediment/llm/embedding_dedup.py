"""Embedding near-duplicates: a navigable small-world graph per shard, queried by every vector.

Equal vectors are one class, numbered in the order of their smallest ids. Classes of each length are
dealt to shards by hash; each shard's graph is built in a task and stored. Every class is then
searched for in every shard of its length, by tasks that hold one graph and
read queries as they come. Audits set the beam, which is doubled up to the shard's size: at first
vectors just above the threshold from known nodes must find them; then a few queries of each block
are compared with the whole shard, and each must have found the share `recall` of its links, itself
left out. Cosines are of double precision. A block gives the number of links of each query and the
edges of a spanning forest of the links it found, so a large group of near copies gives no row per
pair; the forests are united over Spark. `audited_recall` tells what the audits saw.

Defined results: one row for each row given; a vector that is null, zero, or that holds a null or
non-finite component links with nothing; vectors link with those of their own length; rows of a null
or repeated id are vectors of their own, so equal ones link with each other; a null id is the last of
all in a component, and never kept; a cosine equal to the threshold is a link; other columns are not
read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import connected_components, materialize, work_folder
from sediment.llm.hnsw import Graph

#: A stored graph is cut into rows of this size.
PIECE_BYTES = 4_000_000


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dims, v): unit vectors as bytes of doubles; v is null for vectors that link with nothing."""

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, dims = [], []
            for x in part.column(1).to_pylist():
                v = None
                if x and None not in x:
                    a = np.array(x, "f8")
                    size = np.abs(a).max()
                    if np.isfinite(size) and size > 0:
                        a = a / size
                        v = (a / np.linalg.norm(a) + 0.0).tobytes()
                out.append(v)
                dims.append(len(x) if v is not None else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dims", "v"])

    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return rows.mapInArrow(clean, "vec_id long, dims int, v binary")


class Searcher:
    """A shard's graph with the beam that its audits ask for."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, graph: Graph, least: float, beam: int, recall: float, audits: int):
        self.ids, self.many, self.graph, self.least, self.beam, self.recall, self.audits = ids, many, graph, least, beam, recall, audits
        self.wanted = self.hits = 0
        self._probe()

    def _probe(self) -> None:
        """Widen the beam until vectors just above the threshold from known nodes find them."""
        n, dims = self.graph.vectors.shape
        if dims < 2:
            self.beam = n
            return
        rng = np.random.default_rng(1)
        nodes = rng.permutation(n)[: self.audits]
        own = self.graph.vectors[nodes]
        away = rng.standard_normal(own.shape)
        away -= (away * own).sum(axis=1, keepdims=True) * own
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        cos = min(1.0, self.least + 1e-3)
        probes = cos * own + np.sqrt(1 - cos * cos) * away
        while self.beam < n:
            found = self.graph.within(probes, self.least, self.beam)
            if sum(node in near for node, near in zip(nodes.tolist(), found, strict=True)) >= self.recall * len(nodes):
                return
            self.beam *= 2

    def audit(self, rep: np.ndarray, q: np.ndarray) -> None:
        """Compare some queries with the whole shard; widen the beam while any of them lacks links, itself left out."""
        checked = np.random.default_rng(len(rep)).permutation(len(rep))[: self.audits]
        if not len(checked):
            return
        cos = q[checked] @ self.graph.vectors.T
        truth = [near[self.ids[near] != rep[i]] for i, near in zip(checked, (np.flatnonzero(c >= self.least) for c in cos), strict=True)]
        some = [k for k, t in enumerate(truth) if len(t)]
        checked, truth = checked[some], [truth[k] for k in some]
        while len(checked):
            found = self.graph.within(q[checked], self.least, self.beam)
            hits = [len(np.intersect1d(t, f)) for t, f in zip(truth, found, strict=True)]
            if self.beam >= len(self.ids) or all(hit >= self.recall * len(t) for hit, t in zip(hits, truth, strict=True)):
                self.wanted, self.hits = self.wanted + sum(map(len, truth)), self.hits + sum(hits)
                return
            self.beam *= 2

    def links(self, rep: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, query, links) of each query that has any, and (query, other, 0) of a spanning forest of the links."""
        self.audit(rep, q)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        rows = []
        for at in range(0, len(rep), 256):  # links of few queries at a time: those of a large group are many
            for one, near in zip(rep[at : at + 256].tolist(), self.graph.within(q[at : at + 256], self.least, self.beam), strict=True):
                others = self.ids[near]
                total = int(self.many[near].sum()) - int(self.many[near][others == one].sum())
                if total:
                    rows.append((one, one, total))
                    for other in others.tolist():
                        a, b = find(one), find(other)
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            rows.append((one, other, 0))
        return rows


def found_links(
    classes: DataFrame, folder: str, least: float, shard_rows: int, least_shards: int, task_rows: int, beam: int, recall: float, audits: int
) -> DataFrame:
    """(u, v, n), stored: links n of each class u = v, edges u, v with n = 0, and the audits of each task.

    An audit's row has no u: v links were wanted by the audited queries and n of them were found.
    A task holds one shard's graph, whose pieces come first, and reads its queries as they come; so
    what is moved is the queries once for each shard, and a graph for each `task_rows` of them.
    """
    spark = classes.sparkSession
    lengths, shards, n = [], 0, 0  # a row for each length of vectors
    for r in classes.groupBy("dims").count().orderBy("dims").collect():
        own = max(min(least_shards, -(-r["count"] // 100)), -(-r["count"] // shard_rows))
        lengths.append((r["dims"], shards, own))
        shards, n = shards + own, max(n, r["count"])
    parts = max(1, -(-n // task_rows), -(-spark.sparkContext.defaultParallelism // max(1, shards)))
    lengths = spark.createDataFrame(lengths, "dims int, first int, own int")
    classes = classes.join(F.broadcast(lengths), "dims")
    dealt = classes.select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("own"))).cast("int").alias("shard"), "rep", "many", "v")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep").sample(frac=1, random_state=2)
        x = np.frombuffer(b"".join(part["v"]), "f8").reshape(len(part), -1)
        data = Graph(x).build().to_bytes(ids=part["rep"].to_numpy("i8"), many=part["many"].to_numpy("i8"))
        pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
        return pd.DataFrame({"shard": part["shard"].iloc[0], "piece": range(len(pieces)), "v": pieces})

    graphs = dealt.groupBy("shard").applyInPandas(build, "shard int, piece int, v binary")
    graphs = materialize(graphs, folder, "graphs")
    graphs = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "piece", F.lit(None).cast("long").alias("rep"), "v")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    queries = classes.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("own") - 1)).alias("shard"), part, F.lit(2**31 - 1).alias("piece"), "rep", "v")
    both = graphs.unionByName(queries).repartitionById(max(1, shards * parts), F.col("shard") * parts + F.col("part")).sortWithinPartitions("piece")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, searcher = [], None
        kinds = [pa.int64()] * 3

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], names=["u", "v", "n"])

        for whole in batches:
            is_query = whole.column("rep").is_valid()
            pieces += whole.filter(pa.compute.invert(is_query)).column("v").to_pylist()
            whole = whole.filter(is_query)
            if not whole.num_rows or not pieces:
                continue
            if searcher is None:
                graph, more = Graph.from_bytes(b"".join(pieces))
                pieces = [b""]
                searcher = Searcher(more["ids"], more["many"], graph, least, beam, recall, audits)
            for at in range(0, whole.num_rows, 4096):
                own = whole.slice(at, 4096)
                q = np.frombuffer(b"".join(own.column("v").to_pylist()), "f8").reshape(own.num_rows, -1)
                yield rows_of(searcher.links(own.column("rep").to_numpy(), q))
        if searcher is not None and searcher.wanted:
            yield rows_of([(None, searcher.wanted, searcher.hits)])

    return materialize(both.mapInArrow(search, "u long, v long, n long"), folder, "found")


def audited_recall(found: DataFrame) -> DataFrame:
    """One row: wanted and found links of all audited queries, and their ratio (null without any)."""
    audits = found.where("u is null").agg(F.sum("v").alias("wanted"), F.sum("n").alias("found"))
    return audits.withColumn("recall", F.col("found") / F.col("wanted"))


def classes_of(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Stored (vec_id, dims, v) of all rows, and (v, dims, rep, low, many) of the distinct unit vectors that can link.

    rep numbers the classes in the order of low, their smallest id: of several classes the smallest rep has the smallest id.
    """
    units = materialize(unit_vectors(vectors, id_col, vector_col), folder, "units")
    found = units.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"), F.max("dims").alias("dims"))
    order = [F.asc_nulls_last("low"), F.col("v")]
    found = materialize(found, folder, "distinct").repartitionByRange(*order).sortWithinPartitions(*order)
    return units, materialize(found.select("v", "dims", F.monotonically_increasing_id().alias("rep"), "low", "many"), folder, "classes")


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 100_000,
    least_shards: int = 6, task_rows: int = 1_000_000, beam: int = 48, recall: float = 0.99, audits: int = 48,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    folder = work_folder(vectors.sparkSession)
    units, classes = classes_of(vectors, folder, id_col, vector_col)
    found = found_links(classes, folder, least, shard_rows, least_shards, task_rows, beam, recall, audits)
    united = connected_components(found.where("u <> v").select("u", "v"), folder)
    degree = found.where("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    lows = classes.select(F.col("rep").alias("component"), F.col("low").alias("component_id"))
    classes = classes.select("v", "rep", "many").join(degree.withColumnRenamed("u", "rep"), "rep", "left")
    classes = classes.join(united.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = classes.join(lows, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = units.select("vec_id", "v").join(classes, "v", "left")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)))
