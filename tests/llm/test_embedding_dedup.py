import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sediment.llm import embedding_dedup


def brute(rows, least):
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    comp = {i: i for i, _ in rows}
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 1 << 60).min(axis=1))
        if (new == low).all():
            break
        low = new
    comp |= dict(zip(ids, low.tolist(), strict=True))
    links = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    return sorted((i, links.get(i, 0), comp[i], comp[i] == i) for i, _ in rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in [1] * 150 + [2, 3, 5, 9, 60]:
        base = rng.standard_normal(8)
        for _ in range(size):
            rows.append((n, (base + 0.05 * rng.standard_normal(8)).tolist()))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(4)] + [(n + 9, (2 * np.array(rows[3][1])).tolist())]
    rows += [(n + 10, None), (n + 11, [0.0] * 8), (n + 12, [float("nan")] + [1.0] * 7), (n + 13, [None] + [1.0] * 7), (n + 14, [1.0] * 3), (n + 15, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = embedding_dedup.near_duplicates(df, 0.95, task_rows=64)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 0.95)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(str, (tuple(r) for r in embedding_dedup.near_duplicates(df).collect())))
    assert got == ["(1, 2, 1, True)", "(1, 2, 1, True)", "(None, 2, 1, False)"]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_every_row_and_length_links(spark):
    """Repeated and null ids with different vectors, and vectors of several lengths."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (None, [0.0, 2.0]), (None, [-1.0, 0.0])]
    rows += [(n, [float(n % 2), 1.0, 0.5]) for n in range(10, 14)] + [(5, [3.0]), (6, [4.0]), (7, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dims", F.lit("clash"))
    got = sorted(str(tuple(r)) for r in embedding_dedup.near_duplicates(df).collect())
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (None, 0, None, False)]
    want += [(10, 1, 10, True), (12, 1, 10, False), (11, 1, 11, True), (13, 1, 11, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    assert got == sorted(map(str, want))


def test_audit_asks_each_query():
    """A group of 1000 must not outweigh a pair whose only link a narrow beam misses."""

    class Narrow:
        vectors = np.repeat(np.eye(2), [1000, 2], axis=0)

        def within(self, q, least, beam):
            near = [np.flatnonzero(self.vectors @ x >= least) for x in q]
            return [n if beam > 50 or len(n) > 2 else np.array([1000 + i % 2]) for i, n in enumerate(near)]

    ids = np.arange(1002)
    own = embedding_dedup.Searcher(ids, np.ones(1002, "i8"), Narrow(), 0.95, 48, 0.99, 48)
    assert {(1000, 1000, 1), (1001, 1001, 1)} <= set(own.links(ids[990:], Narrow.vectors[990:])) and own.beam == 96


def test_planted_pairs_and_a_large_group(spark, tmp_path):
    """64 dimensions: 6000 vectors apart, 300 pairs at every cosine above the threshold, one group of 700."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((300, 64))
    away -= (away * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = np.linspace(0.9501, 0.9999, 300)[:, None]
    group = x[301] + 0.02 * rng.standard_normal((700, 64))
    x = np.concatenate([x, cos * x[:300] + np.sqrt(1 - cos**2) * away, group])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "v": "clash", "rep": 1})).repartition(5)
    got = embedding_dedup.near_duplicates(df, 0.95, least_shards=3).toPandas().sort_values("vec_id")
    assert got["n_links"].sum() >= 0.99 * near.sum() and (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert (got["n_links"].to_numpy()[:300] > 0).mean() >= 0.99
    assert got["component_id"].iloc[-700:].nunique() == 1 and (got["kept"] == (got["vec_id"] == got["component_id"])).all()
    folder = f"file://{tmp_path}"
    classes = embedding_dedup.classes_of(df, folder)[1]
    found = embedding_dedup.found_links(classes, folder, 0.95, 100_000, 3, 1_000_000, 48, 0.99, 48)
    audit = embedding_dedup.audited_recall(found).first()
    assert audit["wanted"] > 0 and audit["recall"] >= 0.99
