import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.operators import vector
from sediment.operators.dense_index import DenseIndex


@pytest.fixture(scope="module")
def rows(spark):
    """3000 vectors around 40 directions, a group of 600 equal ones, and some that have no cosine."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = base[rng.integers(0, 40, 3000)] + 0.35 * rng.standard_normal((3000, 16))
    data = [(n, v.tolist()) for n, v in enumerate(x)] + [(5000 + n, x[7].tolist()) for n in range(600)]
    data += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0] * 3), (9004, [None] + [1.0] * 15), (9005, [float("nan")] * 16)]
    return spark.createDataFrame(data, "doc_id long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = DenseIndex(spark, f"file://{tmp_path_factory.mktemp('dense')}")
    made.train(rows, 40)
    for n in range(2):
        made.add(rows.where(F.col("doc_id") % 2 == n))
    return made


def test_every_row_is_in_one_list(index, rows):
    kept = index.probed([])
    assert kept.count() == rows.count() == kept.select("doc_id").distinct().count()
    assert sorted(r["doc_id"] for r in kept.where("list = -1").collect()) == list(range(9000, 9006))


def test_all_lists_are_exact_and_few_recall(index, rows):
    asked = [r["embedding"] for r in rows.where("doc_id % 300 = 0 and doc_id < 3000").orderBy("doc_id").collect()]
    for q in asked[:2]:
        want = vector.dense_topk(rows, vector.query_vector(q), 20, None)
        assert [tuple(r) for r in index.search(q, 20).select("doc_id", F.round("score", 9)).collect()] == [tuple(r) for r in want.select("doc_id", F.round("score", 9)).collect()]
    recall, share = index.recall(asked[:5], 10, 5)
    assert recall >= 0.95 and share <= 0.35, (recall, share)


def test_a_search_reads_only_its_lists(index, rows):
    q = rows.where("doc_id = 7").first()["embedding"]
    found = index.search(q, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "list" in plan and 1 <= index.probed(q, 2).select("list").distinct().count() <= 2
    assert [r["score"] for r in found.collect()] == pytest.approx([1.0] * 5)


def test_nothing_to_learn_from(spark, tmp_path, rows):
    made = DenseIndex(spark, f"file://{tmp_path}")
    made.train(rows.limit(0), 8)
    made.add(rows.where("doc_id < 3"))
    assert made.probed([]).where("list = -1").count() == 3 and len(made.search([1.0] * 16, 2).collect()) == 2
