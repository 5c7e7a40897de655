"""A stored inverted index: postings in blocks with their bounds, and a top-k search that leaves blocks unread.

A folder holds `postings`, partitioned by batch and bucket of the term, and `batches`, a row for each
batch with its chunks and their lengths. Adding chunks writes a new batch and touches no old file; a
batch counts from when its row is written, so that a job killed before leaves nothing that is read.

A term's postings of a batch, if they are more than a block, are cut into TIERS by what they count for, and
each tier into blocks of about BLOCK by the leading bits of a hash of the chunk's id: blocks are even
whatever the ids, a hot term's are dealt over tasks, their bounds are close, and the block of an id
follows from the id. The texts are read once, into runs of postings gathered by term in each task; runs of
hot terms are dealt by tier and up to 2 ** TOGETHER blocks, and those of one key, which meet in one task,
are merged into blocks there, so that few rows are shuffled. A block carries its largest frequency and smallest length, which bound its scores
under any statistics, also those of later batches. Files are sorted by bucket, term and largest
frequency, so that a search reads the pages of its terms with bounds high enough.

A search for the k best (a block-wise MaxScore):
1. Heads of the query's blocks give each term's frequency and best score; a few blocks of highest bound
   are scored, and the k-th best of these partial scores is a floor for the result.
2. Terms that cannot reach the floor together only add to chunks found by the others. Of those others,
   a block is read if its bound and the best of all other terms reach the floor.
3. The chunks found that can still reach it are looked up in the remaining terms' blocks, by their hash.

Scores equal lexical.bm25 of all chunks added. Ids are unique over all batches; a null id is an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sediment.operators.lexical import B, K1, idf, query_terms, runs, tf_part
from sediment.sources.work import stored

BUCKETS, BLOCK, TIERS = 64, 256, 8
#: Blocks of a tier that are made together, as a power of two.
TOGETHER = 8
#: Blocks that are scored for the floor.
SEEDS = 16
#: Scores that differ by less are not told apart.
SLACK = 1e-9


@dataclass
class Search:
    """The result (id, score) of a search, and what it took."""

    result: DataFrame
    floor: float
    essential: list[str]
    blocks: int  # of the query's terms
    blocks_read: int  # of the essential terms; blocks of the others are read only for chunks found


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> DataFrame:
        """(batch, n, dl): the batches that count."""
        schema = "batch int, n long, dl long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/batches") if self._exists() else self.spark.createDataFrame([], schema)

    def add(self, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add chunks as a new batch; its number."""
        batch = (self.batches().agg(F.max("batch")).first()[0] or 0) + 1
        made = stored(runs(chunks, id_col, text_col), "runs")  # the one reading of the texts
        whole = made.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("dl"), F.sum("nulls").alias("nulls")).first()
        if whole["nulls"]:
            raise ValueError("a chunk of an index needs an id")
        made, mean = made.where("term is not null"), max(whole["dl"] / max(whole["n"], 1), 1.0)
        often = made.select("term", "tfs", "dls").mapInArrow(_tier_counts(mean), "term string, " + ", ".join(f"n{t} long" for t in range(TIERS)))
        often = often.groupBy("term").agg(*(F.sum(f"n{t}").alias(f"n{t}") for t in range(TIERS)))
        bits = F.array(*(F.when(F.col(f"n{t}") > 0, F.greatest(F.lit(0), F.ceil(F.log2(F.col(f"n{t}") / BLOCK)))).otherwise(0).cast("int") for t in range(TIERS)))
        often = often.where(reduce(Column.__add__, (F.col(f"n{t}") for t in range(TIERS))) > BLOCK)
        often = stored(often.select("term", bits.alias("bits")), "often")  # its size tells Spark how to join it
        lists = [made.schema[c] for c in ("ids", "hashes", "tfs", "dls")]
        parts = T.StructType([*T.StructType.fromDDL("term string, tier int, bits int, part int"), *lists])
        dealt = made.select("term", "ids", "hashes", "tfs", "dls").join(often, "term", "left").mapInArrow(_deal(mean, parts), parts)
        bucket = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("bucket")
        key = ["bucket", "term", "tier", "part"]
        dealt = dealt.select(bucket, *parts.names).repartitionByRange(*key).sortWithinPartitions(*key)
        blocks = T.StructType([*T.StructType.fromDDL("bucket int, term string, tier int, bits int, block int, n int, max_tf int, min_dl int"), *(x for x in lists if x.name != "hashes")])
        order = ["bucket", "term", F.desc("max_tf"), "tier", "block"]
        # What a killed job may have left under this number is replaced.
        out = dealt.mapInArrow(_merge(blocks), blocks).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "static")
        out.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        counts = self.spark.createDataFrame([(batch, whole["n"], whole["dl"])], "batch int, n long, dl long")
        counts.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return batch

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """The blocks of some terms, or of all, in the batches that count."""
        counted = [r["batch"] for r in self.batches().where("dl > 0").collect()]  # the others have no postings
        if not counted:
            return self.spark.createDataFrame([], "term string, tier int, bits int, block int, n int, max_tf int, min_dl int, ids array<bigint>, tfs array<int>, dls array<int>, batch int, bucket int")
        # Only folders of batches that count are listed.
        found = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/batch={n}" for n in counted))
        return found if terms is None else found.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))

    def term_frequencies(self) -> DataFrame:
        """(term, df), from the heads of the blocks."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("df"))

    def search(self, query: str, k: int = 10, id_col: str = "doc_id") -> Search:
        terms = query_terms(query)
        empty = self.blocks([]).select(F.explode("ids").alias(id_col), F.lit(0.0).alias("score"))
        whole = self.batches().agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl")).first()
        if not terms or not whole["n"] or not whole["avgdl"]:
            return Search(empty, 0.0, [], 0, 0)
        n, avgdl = F.lit(whole["n"]), F.lit(whole["avgdl"])
        read = self.blocks(terms)
        df = {r["term"]: r["df"] for r in read.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if not df:
            return Search(empty, 0.0, [], 0, 0)
        weights = {t: math.log(1 + (whole["n"] - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        weight = _by_term({t: idf(n, F.lit(d)) for t, d in df.items()})
        read = read.withColumn("bound", weight * tf_part(F.col("max_tf"), F.col("min_dl"), avgdl))
        best = {r["term"]: r for r in read.groupBy("term").agg(F.max("bound").alias("bound"), F.min("min_dl").alias("dl"), F.count("*").alias("blocks")).collect()}

        def scored(blocks: DataFrame) -> DataFrame:
            each = blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x"))
            return each.select("term", F.col("x.ids").alias("id"), (weight * tf_part(F.col("x.tfs"), F.col("x.dls"), avgdl)).alias("part"))

        key = ["batch", "term", "tier", "block"]
        heads = read.select(*key, "bound").orderBy(F.desc("bound"), *key).limit(SEEDS)
        seeds = scored(read.join(F.broadcast(heads.select(*key)), key))  # SEEDS rows
        top = seeds.groupBy("id").agg(F.sum("part").alias("s")).orderBy(F.desc("s")).limit(k).collect()
        floor = top[-1]["s"] - SLACK if len(top) == k else 0.0

        # Terms whose best scores stay under the floor together find no chunk of the result on their own.
        rest, lesser, total = [], sorted(df, key=lambda t: best[t]["bound"]), 0.0
        for t in lesser:
            if total + best[t]["bound"] >= floor:
                break
            total += best[t]["bound"]
            rest.append(t)
        essential = lesser[len(rest) :]
        every = sum(b["bound"] for b in best.values())
        reach = [self._reaches(t, floor - (every - best[t]["bound"]), weights[t], best[t]["dl"], whole["avgdl"]) for t in essential]
        chosen = read.where(F.col("bucket").isin([bucket_of(t) for t in essential]) & reduce(Column.__or__, reach))
        found = scored(chosen)
        if rest:
            # Chunks that can still reach the floor, to be looked up.
            able = found.groupBy("id").agg(F.sum("part").alias("s")).where(F.col("s") + total >= floor)
            able = stored(able.select("id"), "able")
            more = read.where(F.col("term").isin(rest) & F.col("bucket").isin([bucket_of(t) for t in rest]))
            kinds = more.select("batch", "term", "tier", "bits").distinct().collect()  # TIERS rows at most for each batch and term
            at = F.array(*[F.struct(*(F.lit(r[c]).alias(c) for c in key[:3]), _block(F.col("id"), F.lit(r["bits"])).alias("block")) for r in kinds])
            wanted = able.select(F.explode(at).alias("x")).select("x.*").distinct()
            found = found.unionByName(scored(more.join(wanted, key, "left_semi"))).join(able, "id", "left_semi")
        # Parts are added in the order of their terms, so that a score does not depend on how it was found.
        parts = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("x"))  # a row for each term at most
        score = F.aggregate("x", F.lit(0.0), lambda s, p: s + p["part"])
        result = parts.select(F.col("id").alias(id_col), score.alias("score")).orderBy(F.desc(F.round("score", 9)), id_col).limit(k)
        return Search(result, floor, sorted(essential), sum(b["blocks"] for b in best.values()), chosen.count())

    @staticmethod
    def _reaches(term: str, least: float, weight: float, min_dl: int, avgdl: float) -> Column:
        """Blocks of a term whose bound is at least `least`, with a bound of the frequency that Parquet can read pages by."""
        own = F.col("term") == term
        if least <= 0:
            return own
        share = least / weight
        if share >= K1 + 1:
            return F.lit(False)
        tf = share * K1 * (1 - B + B * min_dl / avgdl) / (K1 + 1 - share)
        return own & (F.col("max_tf") >= math.ceil(tf - 1e-6)) & (F.col("bound") >= least)


def _block(chunk_id: Column, bits: Column) -> Column:
    """The leading bits of the id's hash: by two shifts, as one by all 64 bits does nothing."""
    return F.shiftrightunsigned(F.call_function("shiftrightunsigned", F.xxhash64(chunk_id), 63 - bits), 1).cast("int")


def _flat(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).flatten().to_numpy(zero_copy_only=False)


def _rows(part: pa.RecordBatch) -> np.ndarray:
    """For each posting of a batch of runs, its row."""
    return np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("tfs")).to_numpy(zero_copy_only=False))


def _tier(part: pa.RecordBatch, mean: float) -> np.ndarray:
    tf, dl = _flat(part, "tfs").astype("f8"), _flat(part, "dls")
    return np.minimum(np.floor(tf * TIERS / (tf + K1 * (1 - B + B * dl / mean))), TIERS - 1).astype("i8")


def _leading(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The leading bits of hashes of 32 bits; none: 0."""
    return hashes >> (32 - bits)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of some sorted keys changes."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return np.flatnonzero(new)


def _lists(values: pa.Array, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values).cast(kind)


def _tier_counts(mean: float) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = np.bincount(_rows(part) * TIERS + _tier(part, mean), minlength=part.num_rows * TIERS).reshape(-1, TIERS)
            yield pa.RecordBatch.from_arrays([part.column("term"), *(pa.array(counts[:, t]) for t in range(TIERS))], ["term", *(f"n{t}" for t in range(TIERS))])

    return run


def _deal(mean: float, schema: T.StructType) -> Callable:
    """Runs of hot terms, which have bits, cut by tier and by the part of the tier; all others as they are."""
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            row, own = _rows(part), part.column("bits")
            hot = own.is_valid().to_numpy(zero_copy_only=False)
            bits = np.zeros((part.num_rows, TIERS), "i8")
            bits[hot] = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, TIERS)
            tier = np.where(hot[row], _tier(part, mean), 0)
            bits = bits[row, tier]
            place = _leading(_flat(part, "hashes"), np.maximum(bits - TOGETHER, 0))
            order = np.lexsort((place, tier, row))
            row, tier, place, bits = row[order], tier[order], place[order], bits[order]
            starts = _starts(row, tier, place)
            columns = [part.column("term").take(pa.array(row[starts])), *(pa.array(x[starts], pa.int32()) for x in (tier, bits, place))]
            columns += [_lists(part.column(k.name).flatten().take(pa.array(order)), starts, k.type) for k in list(arrow)[4:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def _merge(schema: T.StructType) -> Callable:
    """Blocks of runs that are sorted by their keys; the runs of a key may go on in the next batch."""
    arrow = to_arrow_schema(schema)

    def blocks(part: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        row, bits = _rows(part), part.column("bits").to_numpy()
        block, ids = _leading(_flat(part, "hashes"), bits[_rows(part)]), part.column("ids").flatten()
        rank = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else pc.rank(ids, tiebreaker="first").to_numpy()
        order = np.lexsort((rank, block, group[row]))
        row, block = row[order], block[order]
        starts = _starts(group[row], block)
        tf, dl = _flat(part, "tfs")[order], _flat(part, "dls")[order]
        heads = part.select(["bucket", "term", "tier", "bits"]).take(pa.array(row[starts])).columns
        numbers = [block[starts], np.diff(np.append(starts, len(row))), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)]
        lists = [_lists(x, starts, k.type) for x, k in zip((ids.take(pa.array(order)), pa.array(tf), pa.array(dl)), list(arrow)[8:], strict=True)]
        return pa.RecordBatch.from_arrays([*heads, *(pa.array(x, pa.int32()) for x in numbers), *lists], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for part in parts:
            if not part.num_rows:
                continue
            whole = pa.concat_batches([*held, part])
            term = whole.column("term").dictionary_encode().indices.to_numpy()
            starts = _starts(term, whole.column("tier").to_numpy(), whole.column("part").to_numpy())
            group = np.zeros(whole.num_rows, "i8")
            group[starts] = 1
            if starts[-1]:
                yield blocks(whole.slice(0, starts[-1]), np.cumsum(group)[: starts[-1]])
            held = [whole.slice(starts[-1])]
        if held:
            yield blocks(held[0], np.zeros(held[0].num_rows, "i8"))

    return run


def _by_term(values: dict[str, Column]) -> Column:
    out = None
    for term, value in values.items():
        out = F.when(F.col("term") == term, value) if out is None else out.when(F.col("term") == term, value)
    return out
