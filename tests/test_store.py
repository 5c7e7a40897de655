import pytest
from pyspark.sql import functions as F

from sediment.operators import indexing
from sediment.sources.store import ChunkStore, VersionedStore

SCHEMA = "project_id string, document_id long, chunk_index int, content string"


@pytest.fixture
def rows(spark):
    data = [(p, d, n, f"{p}-{d}-{n}") for p in ("7", "a b/c", None) for d in range(20) for n in range(3)]
    return spark.createDataFrame(data, SCHEMA)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def docs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "project_id string, document_id long")


def test_one_document_rewrites_one_partition(spark, tmp_path, rows):
    store = ChunkStore(spark, f"file://{tmp_path}/chunks", rows.schema, parts=8)
    assert store.read().collect() == []
    store.replace(rows.select("project_id", "document_id"), rows)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.collect()))
    before = files(tmp_path)
    new = spark.createDataFrame([("7", 5, 0, "new")], SCHEMA)
    store.replace(docs(spark, ("7", 5)), new)
    after = files(tmp_path)
    gone = {p.parent for p in before if p not in after}
    assert len(gone) == 1 and {p.parent for p in after if p not in before} == gone  # one partition, all else untouched
    assert all(after[p] == t for p, t in before.items() if p in after)
    want = [r for r in rows.collect() if (r["project_id"], r["document_id"]) != ("7", 5)] + new.collect()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, want))


def test_scoped_reads_are_pruned(spark, tmp_path, rows):
    store = ChunkStore(spark, f"file://{tmp_path}/chunks", rows.schema, parts=8)
    store.replace(rows.select("project_id", "document_id"), rows)
    scan = store.read("7", 5)
    plan = scan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "project_id" in plan and "part" in plan
    assert len(scan.inputFiles()) >= 1 and scan.count() == 3
    assert store.read("7").count() == 60 and store.read("a b/c").select("project_id").distinct().first()[0] == "a b/c"
    assert store.of_projects(docs(spark, (None, 1), ("7", 1))).count() == 120


def test_documents_without_chunks_lose_theirs(spark, tmp_path, rows):
    store = ChunkStore(spark, f"file://{tmp_path}/chunks", rows.schema, parts=3)
    few = rows.where("document_id < 2")
    store.replace(few.select("project_id", "document_id"), few)
    store.delete(docs(spark, (None, 0), (None, 1), ("7", 0), ("nowhere", 3)))
    left = {(r["project_id"], r["document_id"]) for r in store.read().collect()}
    assert left == {("7", 1), ("a b/c", 0), ("a b/c", 1)}
    with pytest.raises(ValueError):
        store.delete(docs(spark, ("", 1)))


def test_many_partitions_are_joined(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("sediment.sources.store.LISTED", 2)
    store = ChunkStore(spark, f"file://{tmp_path}/chunks", rows.schema, parts=8)
    store.replace(rows.select("project_id", "document_id"), rows)
    odd = rows.where("document_id % 2 = 1")
    store.replace(odd.select("project_id", "document_id"), odd.withColumn("content", F.lit("x")))
    got = store.read()
    assert got.count() == 180 and got.where("content = 'x'").count() == 90 and got.where("content = 'x' and document_id % 2 = 0").count() == 0
    assert store.of_projects(rows).count() == 180


def test_indexing_into_a_store(spark, tmp_path):
    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    cache = spark.createDataFrame([], "key string, embedding array<float>")
    store = indexing.chunk_store(spark, f"file://{tmp_path}/chunks", parts=4)
    first = spark.createDataFrame([("p", "d1", "a.txt", "one text"), ("p", "d2", "b.txt", "two texts"), ("q", "d3", "c.txt", "one text")], "project_id string, document_id string, name string, text string")
    assert indexing.index_into(store, first, cache, embed).count() == 2  # equal texts are embedded once
    assert store.read().count() == 3 and store.read().where("embedding is null").count() == 0
    second = spark.createDataFrame([("p", "d2", "b.txt", "one text"), ("p", "d4", "x.txt", "")], first.schema)
    assert indexing.index_into(store, second, cache, embed).collect() == []  # the vector was taken from d1
    got = {r["document_id"]: r["content"] for r in store.read("p").collect()}
    assert got == {"d1": "one text", "d2": "one text"}
    assert store.read("q").count() == 1


@pytest.fixture
def published(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.tables() == {}
    ids = spark.range(10)
    assert store.publish({"projects": ids, "files": ids.withColumnRenamed("id", "project_id"), "notes": ids}) == 1
    return store


def state(store, version=None):
    return {n: sorted(r[0] for r in store.read(n, version).collect()) for n in store.tables(version)}


def test_cascade_is_published_at_once(spark, published):
    assert published.delete_cascade({"projects": "id", "files": "project_id"}, spark.range(3), "id") == 2
    assert state(published) == {"projects": list(range(3, 10)), "files": list(range(3, 10)), "notes": list(range(10))}
    assert state(published, 1)["files"] == list(range(10))  # a reader of the version before
    assert published.tables(1)["notes"] == published.tables(2)["notes"]  # unchanged tables are not written again


def test_a_killed_job_leaves_the_old_store_whole(spark, published, monkeypatch):
    before = state(published)
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    for change in ({"projects": spark.range(1), "files": broken}, {"files": broken, "projects": spark.range(1)}):
        with pytest.raises(Exception, match="lost"):
            published.publish(change, replace_all=True)
        assert published.version() == 1 and state(published) == before

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all tables written, the manifest not
        m.setattr(published, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            published.delete_cascade({"projects": "id", "files": "project_id"}, spark.range(3), "id")
    assert state(published) == before
    assert published.publish({"projects": spark.range(2)}, replace_all=True) == 2 and state(published) == {"projects": [0, 1]}


def test_two_writers_and_prune(spark, published, tmp_path):
    published.publish({"notes": spark.range(2)}, base=1)
    with pytest.raises(RuntimeError, match="meanwhile"):
        published.publish({"notes": spark.range(5)}, base=1)
    assert state(published)["notes"] == [0, 1] and all(p.name.startswith((".v", "v")) for p in (tmp_path / "store/manifests").iterdir())
    published.publish({"notes": spark.range(3)})
    published.prune(keep=1)
    assert state(published) == {"projects": list(range(10)), "files": list(range(10)), "notes": [0, 1, 2]}
    assert len(list((tmp_path / "store/data").iterdir())) == 3 and len(list((tmp_path / "store/manifests").glob("v*.json"))) == 1
