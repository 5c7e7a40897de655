"""Operators of the catalog, exports and small formats that no query reaches."""

import datetime as dt

from pyspark.sql import functions as F

from sediment.functions import formats as fm
from sediment.operators import catalog, citations, edits
from sediment.sources import exports
from sediment.sources.embedding import reply_vectors


def one(spark, column, **values):
    kinds = {int: "long", str: "string", list: "array<string>"}
    schema = ", ".join(f"{k} {'array<long>' if isinstance(v, list) and v and isinstance(v[0], int) else kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_bulk_get_keeps_order_and_gaps(spark):
    keys = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a"), (3, "b")], "n int, id string")
    store = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [(r["id"], r["v"]) for r in catalog.bulk_get(keys, store, "id", "n").collect()] == [("b", 2), ("x", None), ("a", 1), ("b", 2)]


def test_before_week(spark):
    logs = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 8),), (None,)], "week_start date")
    assert [r[0] for r in catalog.before_week(logs, "2024-01-08").collect()] == [dt.date(2024, 1, 8)]


def test_bundle_and_export(spark, tmp_path):
    tables = {
        "projects": spark.createDataFrame([("p",), ("q",)], "id string"), "files": spark.createDataFrame([("f", "p"), ("g", "q")], "id string, project_id string"),
        "conversations": spark.createDataFrame([("c", "p"), ("d", "q"), ("e", None)], "id string, project_id string"),
        "messages": spark.createDataFrame([("m", "c"), ("n", "d"), ("o", "e")], "id string, conversation_id string"),
        "chunks": spark.createDataFrame([("k", "p", "x"), ("l", "q", "y")], "id string, project_id string, document_id string"),
        "documents": spark.createDataFrame([("x",), ("y",)], "id string"),
    }
    bundle = exports.project_bundle(tables, "p")
    assert {n: sorted(r["id"] for r in t.collect()) for n, t in bundle.items()} == {"files": ["f"], "conversations": ["c"], "chunks": ["k"], "project": ["p"], "messages": ["m"], "documents": ["x"]}
    exports.export_store(tables, str(tmp_path / "store"))
    back = exports.import_store(spark, str(tmp_path / "store"), list(tables))
    assert all(sorted(map(tuple, back[n].collect()), key=str) == sorted(map(tuple, t.collect()), key=str) for n, t in tables.items())


def test_latest_artifact(spark):
    rows = [("c", 1, b"a", "x"), ("c", 3, None, "y"), ("c", 2, b"b", "z"), ("c", 2, b"c", "a"), ("d", 1, None, "q")]
    df = spark.createDataFrame(rows, "conv string, at int, edited_blob binary, name string")
    assert [(r["conv"], r["name"]) for r in edits.latest_artifact(df, "conv", "at", ("name",)).collect()] == [("c", "a")]


def test_small_formats(spark):
    assert [one(spark, fm.short_count(F.col("n")), n=n) for n in (0, 999, 1000, 1234, 2_500_000)] == ["0", "999", "1.0K", "1.2K", "2.5M"]
    assert [one(spark, fm.column_alignment(F.col("c")), c=c) for c in (["1", "2,5", "x"], ["1", "x", "y"], ["", " "], ["%5", "-3", "₺4"])] == ["right", "left", "left", "right"]
    box = one(spark, fm.bounding_box(F.col("x"), F.col("y")), x=[3, 1, 7, 2], y=[9, 4, 5, 6])
    assert box.asDict() == {"x": 1, "y": 4, "width": 6, "height": 5}


def test_reply_shapes(spark):
    bodies = ['{"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}', '{"data": [{"embedding": [3.0]}, {"embedding": [4.0]}]}', '{"embeddings": [[5.0], [6.0]]}', " [[7, 8]]", '{"x": 1}', "oops", "[1]", None]
    got = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, b string").select("n", reply_vectors(F.col("b")).alias("v")).orderBy("n").collect()
    assert [r["v"] for r in got] == [[[1.0], [2.0]], [[3.0], [4.0]], [[5.0], [6.0]], [[7.0, 8.0]], None, None, None, None]


def test_lines_of_a_file(spark):
    rows = [("a", 1, 0.5, False, 10, 20), ("a", 2, None, True, 21, 30), ("a", 1, 0.7, False, 50, None), ("b", None, None, False, None, None), (None, 3, 0.1, False, 1, 2)]
    df = spark.createDataFrame(rows, "file string, page int, score double, direct boolean, a long, b long")
    got = {r["file"]: (r["chunks"], r["pages"], r["best"], r["direct"], [tuple(x) for x in r["lines"]]) for r in citations.by_file(df, "file", "page", "score", "direct", "a", "b").collect()}
    assert got == {"a": (3, [1, 2], 0.7, True, [(10, 30), (50, 50)]), "b": (1, [], None, False, []), None: (1, [3], 0.1, False, [(1, 2)])}
