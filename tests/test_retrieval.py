import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.functions import hashing
from sediment.functions import text as tx
from sediment.functions import vectors as vx
from sediment.operators import classify, hybrid, lexical, select, vector


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("VEGA-2 f-16", ["vega2", "vega", "2", "f16", "16"]), ("Ankara'nın İĞNE", ["ankara", "igne"]), ("a bb, 7!", ["bb", "7"]), ("", []), (None, []), ("güneş’in -- x-", ["gunes"]),
])
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens, text) == want


def test_text_functions(spark):
    assert one(spark, tx.fold, "ŞİIığÜâ") == "siiigua"
    assert one(spark, tx.cache_key, "  Ne \n  VAR? ") == "ne var?"
    assert one(spark, tx.token_estimate, "abcdefg```code```") == 2 + 3
    assert one(spark, tx.token_estimate, None) == 0
    assert one(spark, tx.html_to_text, "<h1>A</h1><ul><li>b &amp;lt; c</li></ul><p>x<br/>y</p>") == "A\n\n• b < c\nx\ny"
    assert one(spark, tx.without_thinking, "<think>a</think>b<think>c") == "b"
    assert one(spark, tx.without_thinking, "x</think> y") == "y"
    assert one(spark, tx.json_array_in, "```json\n[1, [2]] ok") == "[1, [2]]"
    assert one(spark, tx.is_tabular, "|a|b|\n|c|d|\nx") and not one(spark, tx.is_tabular, "a\nb\nc")
    assert one(spark, tx.safe_file_name, ' a/b:"c". ') == "a b c" and one(spark, tx.safe_file_name, "CON") == "_CON"
    assert [one(spark, tx.is_numeric_cell, v) for v in ("1.234,5", "-12 %", "₺5", "a1", "")] == [True, True, True, False, False]
    assert one(spark, hashing.djb2_base36, "") == "45h"


def test_vectors(spark):
    row = spark.sql("select array(1d, 0d) a, array(1d, 1d) b, array(0d, 0d) z, array(1d) s").select(vx.cosine(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("z")), vx.cosine(F.col("a"), F.col("s")), vx.euclidean(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(0.5**0.5) and row[1] == 0 and row[2] is None and row[3] == 1


@pytest.fixture
def chunks(spark):
    rows = [(1, "VEGA-1 engine manual", [1.0, 0.0]), (2, "VEGA-2 engine manual", [0.9, 0.1]), (3, "garden", [0.0, 1.0]), (4, "VEGA-2", None), (5, "VEGA-2 x", [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>")


def test_bm25_tells_variants_apart(chunks):
    best = lexical.bm25(chunks.where("doc_id < 3"), "vega-2").orderBy(F.desc("lex_score")).first()
    assert best["doc_id"] == 2


def test_hybrid(chunks):
    q = vector.query_vector([1.0, 0.0])
    have = vector.scoped(chunks)
    rows = hybrid.hybrid_search(have, "vega-2 engine", q, k=3).collect()
    assert rows[0]["doc_id"] == 2 and rows[0]["score"] == 1.0
    dense = [(r["doc_id"], round(r["score"], 3)) for r in hybrid.hybrid_search(have, "zzz", q, k=3).collect()]
    assert dense == [(1, 1.0), (2, round(0.9 / 0.82**0.5, 3))]  # no lexical hit: raw scores
    assert [r["doc_id"] for r in hybrid.hybrid_search(have, " ", q, k=2).collect()] == [1, 2]
    assert hybrid.hybrid_search(have, "vega-2", None, k=9).count() == 3
    assert hybrid.hybrid_search(have.limit(0), "vega", q).collect() == []


def test_mmr_and_packs(spark):
    x = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]]
    rows = spark.createDataFrame([(0, i, v, s) for i, (v, s) in enumerate(zip(x, (0.9, 0.89, 0.5), strict=True))], "q int, doc_id long, embedding array<double>, score double")
    got = [r["doc_id"] for r in select.mmr(rows, "q", 2, 0.5).orderBy("position").collect()]
    assert got == [0, 2]
    items = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (0, 3, 4)], "g int, id long, n int").withColumn("o", F.col("id"))
    assert sorted(r["id"] for r in select.pack_skip(items, ["g"], "o", "n", 10, "id").collect()) == [1, 3]
    assert [r["id"] for r in select.pack_stop(items, ["g"], ["id"], "n", 10).collect()] == [1]
    cache = spark.createDataFrame([(str(i), i) for i in range(10)], "key string, last_used_at long")
    assert select.keep_recent(cache, 9, 4).count() == 4 and select.keep_recent(cache, 10, 4).count() == 10


def test_classify(spark):
    rows = [("merhaba",), ("Hello, thanks!",), ("hi, what is a hypertable?",), ("compare A and B",), ("peki fonksiyon yaz",), ("tell me more",), ("highway stories",)]
    got = {r["query"]: r["query_type"] for r in classify.with_parameters(spark.createDataFrame(rows, "query string")).collect()}
    assert list(map(got.get, (r[0] for r in rows))) == ["conversational", "conversational", "factual", "comparison", "code", "exploratory", "exploratory"]


def test_euclidean_order(spark):
    x = np.random.default_rng(0).random((20, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    got = [r["doc_id"] for r in vector.nearest_euclidean(df, vector.query_vector(x[3].tolist()), 5).collect()]
    assert got == np.argsort(np.linalg.norm(x - x[3], axis=1))[:5].tolist()
