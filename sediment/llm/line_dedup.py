"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Each batch of documents gives its line keys with the number of documents and the largest document id.
It is merge-anti-joined with the stored runs: keys never seen before become a run of their own, so each
key stands in one run. When a level holds `fanout` runs they are compacted into one of the next level.
The keys of the batch that some run holds are set aside, and only these are added up at the end, with
their first counts; a key of one batch alone is never merged with anything, and goes or stays by the
count that it has in its run.

Defined results: a null or empty text is one empty line; a null text stays null; rows with a null
id are returned unchanged and are not counted; a repeated row counts as the same document and gets
the same decision; texts of any length are read whole; an empty table gives an empty table; other columns pass through, except that the
added n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import free_name, materialize, plain_name, sliced, work_folder

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = b" \t\n\x0b\x0c\r"
#: Line keys of all documents for each bucket of a run.
BUCKET_ROWS = 2_000_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte digest of a line's key, or None if the key is shorter than min_chars code points."""
    key = line.translate(_LOWER).strip(_BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def document_keys(docs: DataFrame, min_chars: int = 40, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc, batch): the distinct long line keys of each row."""

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            ids, digests = [], []
            for doc, text in zip(part.column("doc").to_pylist(), _bytes_of(part, "text"), strict=True):
                own = {k for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n")) if k}
                ids += [doc] * len(own)
                digests += own
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            doc = np.array(ids, "i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc), pa.array((doc % batches).astype("i4"))],
                names=["h1", "h2", "doc", "batch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    return rows.mapInArrow(keys, "h1 long, h2 long, doc long, batch int")


class LineRuns:
    """Levelled sorted runs of line hashes in a work folder; every key stands in one run.

    Runs and batches are tables bucketed and sorted by key, with equal numbers of buckets. So a batch is
    merge-anti-joined with the runs, and runs are merged, bucket by bucket without an exchange. What the
    anti-joins leave, keys never seen before, is the batch's own run. The other keys of the batch go to
    `again`; only they are ever added up.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.again: DataFrame | None = None
        self.tables: list[str] = []
        self.prefix = f"line_runs_{uuid.uuid4().hex}"

    def _stored(self, df: DataFrame) -> DataFrame:
        """df as a bucketed and sorted table; df is dealt by key already, or by batch."""
        name = f"{self.prefix}_{len(self.tables)}"
        writer = df.write.format("parquet").option("path", f"{self.folder}/{name}").option("compression", "zstd")
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The keys of a stored batch that no run holds."""
        for run in self.runs():
            batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Two stored runs as one: counts are added, the larger last document stays."""
        more = two.withColumnsRenamed({"n_docs": "n", "last_doc": "last"}).hint("merge")
        n_docs = (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs")
        return one.join(more, ["h1", "h2"], "full").select("h1", "h2", n_docs, F.greatest("last_doc", "last").alias("last_doc"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2, doc); other batches must not hold its documents."""
        batch = keys.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        batch = self._stored(batch.repartition(self.buckets, "h1", "h2"))
        if self.runs():
            fresh = self._stored(self.unseen(batch))
            known = self._stored(batch.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"))
            self.again = known if self.again is None else self._stored(self.merged(self.again, known))
            batch = fresh
        self.levels[0].append(batch)
        level = 0
        while len(self.levels[level]) >= 2:
            whole = self._stored(self.merged(*self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(whole)

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, last_doc) of the keys of `least` documents or more."""
        found = []
        again = self.again
        for run in self.runs():
            if again is not None:
                more = again.withColumnsRenamed({"n_docs": "n", "last_doc": "last"}).hint("merge")
                run = run.join(more, ["h1", "h2"], "left")
                run = run.select("h1", "h2", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
            found.append(run.where(F.col("n_docs") >= least).select("h1", "h2", "last_doc"))
        out = found[0]
        for run in found[1:]:
            out = out.unionByName(run)
        return out

    def drop(self) -> None:
        """Forget the tables' names; the files go with the work folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the lines dropped whose key is in min_docs documents or more, except in the largest id.

    The line keys are staged once, as small numbers; texts are shuffled once, to meet the keys that
    their own document loses.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    staged = materialize(document_keys(docs, min_chars, batches, id_col, text_col), folder, "keys", "batch")
    store = LineRuns(spark, folder, max(8, -(-staged.count() // BUCKET_ROWS)))
    for n in range(batches):
        store.add(staged.where(F.col("batch") == n).select("h1", "h2", "doc"))
    # Stored: a join with a table of keys can be split where one line stands in very many documents.
    often = materialize(store.frequent(min_docs), folder, "often")
    store.drop()
    gone = staged.select("h1", "h2", "doc").join(often, ["h1", "h2"]).where("doc < last_doc")
    base = plain_name(docs, ["n_lines", "n_dropped"])
    gone_id, gone_keys = free_name(base, "_gone_id"), free_name(base, "_gone")
    gone = gone.groupBy(F.col("doc").alias(gone_id)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone_keys))
    joined = base.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left").drop(gone_id)

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            texts, lines, dropped = [], [], []
            for text, gone in zip(_bytes_of(part, text_col), part.column(gone_keys).to_pylist(), strict=True):
                all_lines = (text or b"").split(b"\n")
                kept = all_lines
                if gone:
                    known = {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone}
                    kept = [x for x in all_lines if line_key(x, min_chars) not in known]
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
                texts.append(None if text is None else b"\n".join(kept))
            at = part.schema.get_field_index(text_col)
            out = part.set_column(at, pa.field(text_col, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()))
            out = out.drop_columns([gone_keys])
            out = out.append_column("n_lines", pa.array(lines, pa.int64()))
            yield out.append_column("n_dropped", pa.array(dropped, pa.int64()))

    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in base.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(rewrite, schema)
