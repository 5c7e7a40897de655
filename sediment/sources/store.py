"""Stores in shared folders: chunks replaced by partition, and several tables published at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.catalog import delete_cascade
from sediment.sources.work import stored

#: Partitions whose names are given to a scan as a list; more are joined.
LISTED = 500


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class ChunkStore:
    """Chunks of documents, partitioned by project and by a hash of the document.

    A project has `parts` partitions: enough that one holds few documents, not one folder for each of
    millions. Replacing documents reads and writes only the partitions they are in (dynamic partition
    overwrite); a search scoped to a project or a document reads only theirs. The project may be null
    (a conversation's documents); it may not be an empty text, which Spark's partitions cannot tell
    from null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: int = 64, project: str = "project_id", document: str = "document_id"):
        self.spark, self.path, self.parts, self.project, self.document = spark, path.rstrip("/"), parts, project, document
        self.columns = [f.name for f in schema.fields]
        inner = [f for f in schema.fields if f.name != project]
        self.schema = T.StructType([*inner, schema[project], T.StructField("part", T.IntegerType())])

    def part_of(self, document: Column) -> Column:
        return (F.crc32(document.cast("string").cast("binary")) % self.parts).cast("int")

    def _all(self) -> DataFrame:
        """All chunks with part and _folder, the folder of their partition."""
        fs, place = _file_system(self.spark, self.path)
        if not fs.exists(place):
            return self.spark.createDataFrame([], self.schema).withColumn("_folder", F.lit(""))
        return self.spark.read.schema(self.schema).parquet(self.path).withColumn("_folder", F.regexp_replace("_metadata.file_path", "/[^/]+$", ""))

    def read(self, project: str | None = None, document=None) -> DataFrame:
        """The chunks of a project, of a document, or of all; the scan is pruned to their partitions."""
        out = self._all()
        if project is not None:
            out = out.where(F.col(self.project) == project)
        if document is not None:
            out = out.where((F.col("part") == self.part_of(F.lit(document))) & (F.col(self.document) == F.lit(document)))
        return out.select(*self.columns)

    def of_projects(self, projects: DataFrame) -> DataFrame:
        """The chunks of the projects of some rows."""
        names = [r[0] for r in projects.select(self.project).distinct().limit(LISTED + 1).collect()]
        if len(names) > LISTED:
            some = projects.select(F.col(self.project).alias("_project")).distinct()
            return self._all().join(some, F.col(self.project).eqNullSafe(F.col("_project")), "left_semi").select(*self.columns)
        return self._all().where(self._one_of(self.project, names)).select(*self.columns)

    @staticmethod
    def _one_of(column: str, values: list) -> Column:
        found = F.col(column).isin([v for v in values if v is not None])
        return found | F.col(column).isNull() if None in values else found

    def _touched(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The partitions of rows, and what the store holds in them."""
        touched = stored(rows.select(self.project, self.part_of(F.col(self.document)).alias("part")).distinct(), "touched")
        some = [(r[0], r[1]) for r in touched.limit(LISTED + 1).collect()]
        old = self._all()
        if len(some) > LISTED:
            named = touched.select(F.col(self.project).alias("_project"), F.col("part").alias("_part"))
            return touched, old.join(named, F.col(self.project).eqNullSafe(F.col("_project")) & (F.col("part") == F.col("_part")), "left_semi")
        by_project: dict = {}
        for name, part in some:
            by_project.setdefault(name, []).append(part)
        wanted = F.lit(False)
        for name, numbers in by_project.items():
            wanted = wanted | (F.col(self.project).eqNullSafe(F.lit(name)) & F.col("part").isin(numbers))
        return touched, old.where(wanted)

    def replace(self, documents: DataFrame, rows: DataFrame) -> None:
        """Replace all chunks of documents (project, document) by rows; documents without rows lose theirs. All other chunks stay."""
        gone = documents.select(F.col(self.project).alias("_project"), F.col(self.document).alias("_document")).distinct()
        if not documents.where(f"{self.project} = ''").isEmpty():
            raise ValueError("an empty project cannot be told from a null one; use null")
        touched, old = self._touched(documents)
        kept = old.join(gone, F.col(self.project).eqNullSafe(F.col("_project")) & F.col(self.document).eqNullSafe(F.col("_document")), "left_anti")
        # Both stored first: the partitions read are those that are overwritten.
        had = stored(old.select(self.project, "part", F.col("_folder").alias("folder")).distinct(), "had")
        new = rows.select(*self.columns).withColumn("part", self.part_of(F.col(self.document)))
        both = stored(kept.select(*self.schema.names).unionByName(new.select(*self.schema.names)), "chunks")
        spread = both.repartition(self.project, "part", F.pmod(F.xxhash64(self.document), F.lit(8)))  # several tasks for a large partition
        spread.sortWithinPartitions(self.document).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.project, "part").parquet(self.path)
        # Partitions that are empty now are not among those overwritten.
        left = both.select(F.col(self.project).alias("_project"), F.col("part").alias("_part")).distinct()
        empty = touched.join(left, F.col(self.project).eqNullSafe(F.col("_project")) & (F.col("part") == F.col("_part")), "left_anti")
        named = empty.select(F.col(self.project).alias("_project"), F.col("part").alias("_part"))
        for r in had.join(named, F.col(self.project).eqNullSafe(F.col("_project")) & (F.col("part") == F.col("_part"))).select("folder").distinct().collect():
            fs, place = _file_system(self.spark, r["folder"])
            fs.delete(place, True)

    def delete(self, documents: DataFrame) -> None:
        """Delete the chunks of documents (project, document)."""
        self.replace(documents, self.spark.createDataFrame([], self.schema))


class VersionedStore:
    """Several tables that change together.

    Tables are written to folders of their own; a manifest names the folder of each table and is put in
    place by one rename, last. Until then readers see the version before, whatever became of the job;
    from then on the new one. A reader keeps the version that it began with until `prune`. Of two
    writers that began with the same version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The newest version, 0 for none."""
        fs, place = _file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """The folder of each table in a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/v{version:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[name])

    def publish(self, changed: dict[str, DataFrame], replace_all: bool = False, base: int | None = None) -> int:
        """Write tables and publish them with the unchanged ones (none, if all are replaced); the new version.

        base is the version that the change was worked out from, the newest by default.
        """
        base = self.version() if base is None else base
        folders = {} if replace_all else self.tables(base)
        for name, table in changed.items():
            folders[name] = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
            table.write.parquet(folders[name])
        self._swap(base + 1, folders)
        return base + 1

    def _swap(self, version: int, folders: dict[str, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        temporary, final = f"{self.path}/manifests/.{uuid.uuid4().hex}", f"{self.path}/manifests/v{version:09d}.json"
        fs, place = _file_system(self.spark, temporary)
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # an existing file is an error
        try:
            context.rename(place, jvm.org.apache.hadoop.fs.Path(final), none)
        except Exception as error:
            fs.delete(place, False)
            if "FileAlreadyExists" in str(error):
                raise RuntimeError(f"version {version} was published meanwhile") from None
            raise

    def delete_cascade(self, keys: dict[str, str], gone: DataFrame, id_col: str) -> int:
        """Delete the rows of tables whose key is among the ids of gone, from all tables at once."""
        base = self.version()
        tables = {n: self.read(n, base) for n in keys}
        return self.publish(delete_cascade(tables, keys, gone, id_col), base=base)

    def prune(self, keep: int = 2) -> None:
        """Delete the versions before the last `keep`, and folders that none of the kept names."""
        newest = self.version()
        kept = {folder.rsplit("/", 1)[1] for v in range(max(1, newest - keep + 1), newest + 1) for folder in self.tables(v).values()}
        for part, stays in (("data", lambda n: n in kept), ("manifests", lambda n: n.startswith("v") and int(n[1:-5]) > newest - keep)):
            fs, place = _file_system(self.spark, f"{self.path}/{part}")
            for status in fs.listStatus(place) if fs.exists(place) else ():
                if not stays(status.getPath().getName()):
                    fs.delete(status.getPath(), True)
