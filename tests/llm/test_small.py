"""Nulls, empty tables, clashing columns and held-out accuracy of the operators without a test file of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import common, decontaminate, language_id, line_dedup, quality, toxicity

ODD = [(1, "a b", "x", None), (None, None, None, "y"), (2, "", "z", None), (1, "a b", "x", None), (3, "w " * 30_000, None, None)]
ODD_SCHEMA = "doc_id long, text string, score string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def test_toxicity(spark, docs, labels):
    kept = labels.where(common.crc_remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, kept, least_docs=3)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    out = np.array([(r.score >= 0.5) == (r.toxic == 1) for r in scored.itertuples()])
    assert out.mean() > 0.9
    hit = scored[(scored.toxic == 1) & (scored.score > 0.5)].iloc[0]
    spans = hit.toxic_spans
    assert len(spans) and all(0 <= s["start"] < s["end"] <= len(hit.text) for s in spans)
    got = toxicity.score_toxicity(odd(spark), model)
    assert got.count() == 5 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(odd(spark).limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), kept)
    assert toxicity.score_toxicity(odd(spark), none).where("score >= 0.5").count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 1, 0, 3])
    units, move = rng.standard_normal((8, 2)), rng.standard_normal((2, 2))
    got, at = toxicity.marginals(units, sizes, move), 0
    for n in sizes:
        total, one = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(units[at + k, t] for k, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            one += w * np.array(tags)
        assert np.allclose(got[at : at + n], one / total if n else one)
        at += n


def test_language(spark, docs):
    held = common.crc_remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    out = language_id.predict(docs.where(held), model, reject=False).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    got = {r["text"]: r for r in language_id.predict(odd(spark), model).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == "und" and got[""]["score"] == 0
    far = spark.createDataFrame([(1, "漢字かな交じり文の例文です。")], "doc_id long, text string")
    assert language_id.predict(far, model).first()["lang_pred"] == "und"
    empty = language_id.fit(docs.limit(0))
    assert language_id.predict(odd(spark), empty).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, labels):
    kept = labels.where(common.crc_remainder("doc_id", 4) != 2)
    model = quality.fit(docs, kept)
    held = docs.join(labels.where(common.crc_remainder("doc_id", 4) == 2), "doc_id")
    out = quality.score_quality(held, model).toPandas()
    assert ((out.score >= 0.7) == (out.quality == 1)).mean() > 0.9
    got = quality.score_quality(odd(spark), model)
    assert got.count() == 5 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(odd(spark), quality.fit(docs, kept.limit(0))).count() == 5


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (8, None), (None, "x y"), (9, " ")], "item_id long, text string")
    leak = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    near = leak.replace("theta ", "").replace("beta", "bet")
    rows = [(1, "nothing here " * 40 + leak + " more words" * 40), (2, "nothing here " * 200), (3, near), (None, leak), (4, None), (1, "nothing here " * 40 + leak + " more words" * 40)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(small, items).collect())
    assert got == [(1, 7), (3, 7)]
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(small, items).collect()) == ["2", "4", "None"]
    assert decontaminate.find_matches(small, items.limit(0)).collect() == [] == decontaminate.find_matches(small.limit(0), items).collect()


def test_common_words_equals_table():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        size = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
        mask = {}
        for n, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << n
        assert decontaminate.common_words(mask, 12, b) == size[12, 20]


def test_lines(spark):
    line = "  This Line is long enough to be a key of forty letters "
    rows = [(n, f"own {n}\n{line}\nend") for n in range(4)] + [(9, line.upper() + "\n" + line.strip()), (None, line), (10, None), (11, "short\nshort"), (9, line.upper() + "\n" + line.strip())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert {(n, 3, 1, f"own {n}\nend") for n in range(4)} <= got
    assert (None, 1, 0, line) in got and (10, 1, 0, None) in got and (9, 2, 0, line.upper() + "\n" + line.strip()) in got
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_runs(spark, tmp_path):
    """Each key stands in one run; joins and merges of stored runs need no exchange; counts equal a plain count."""
    rng = np.random.default_rng(8)
    docs = rng.integers(0, 400, 3000)
    keys = rng.zipf(1.3, 3000) % 900
    rows = [(int(k), int(k) * 7, int(d), int(d) % 5) for k, d in zip(keys, docs, strict=True)]
    df = spark.createDataFrame(rows, "h1 long, h2 long, doc long, batch int")
    store = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", 8)
    for n in range(5):
        store.add(df.where(F.col("batch") == n).select("h1", "h2", "doc"))
    runs = [run.select("h1").collect() for run in store.runs()]
    assert sum(map(len, runs)) == len({r["h1"] for run in runs for r in run}) == len(set(keys.tolist()))
    assert len(runs) == 2  # five batches: a run of four and a run of one
    for plan in (store.unseen(store.runs()[0]), store.merged(*store.runs())):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
    want = df.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("last_doc")).where("n >= 5").select("h1", "h2", "last_doc")
    assert sorted(map(tuple, store.frequent(5).collect())) == sorted(map(tuple, want.collect()))
    store.drop()


def test_components(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5), (20, 10), (10, 30)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges, f"file://{tmp_path}/cc").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10}


def test_components_of_paths_and_trees(spark, tmp_path):
    """Against union-find; a node has one row. The first path once stopped with two roots."""
    rng = np.random.default_rng(5)
    graphs, at = [[[(2, 3), (3, 4), (4, 5), (5, 1)]], []], 10
    for n in range(120):
        size = int(rng.integers(4, 14))
        ids = (at + rng.permutation(size)).tolist()
        graphs[1].append([(ids[k], ids[k - 1 if n % 2 else int(rng.integers(k))]) for k in range(1, size)])
        at += size
    for k, groups in enumerate(graphs):
        edges = [e for own in groups for e in own]
        root = {x: x for e in edges for x in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        got = common.connected_components(spark.createDataFrame(edges, "u long, v long"), f"file://{tmp_path}/cc{k}").collect()
        assert sorted((r["node"], r["component"]) for r in got) == sorted((x, find(x)) for x in root)


def test_decontamination_of_long_items(spark, docs):
    """Passages of 15 to 340 words cut from documents, and copies with every eighth word replaced."""
    texts = [(r["doc_id"], decontaminate.WORD.findall(r["text"].lower())) for r in docs.where("text is not null").orderBy("doc_id").collect()]
    long = [(d, w) for d, w in texts if len(w) >= 360][:12]
    items, near = [], []
    for n, (d, w) in enumerate(long):
        for size in (15, 50, 150, 300, 340):
            own = w[n : n + size]
            items.append((len(items), " ".join(own), d))
            near.append((10**9 + items[-1][0], " ".join(f"zz{k}" if k % 8 == 5 else x for k, x in enumerate(own))))
    corpus = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    found = decontaminate.find_matches(corpus, spark.createDataFrame(items, "item_id long, text string, doc_id long"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(long) == 12
    assert {(d, i) for i, _, d in items} | {(d, d - 10**9) for d, _ in near} <= got


def test_decontamination_against_brute_force(spark, docs):
    """Every document and item whose longest common subsequence around any place reaches the thresholds is found, and no other."""
    small = docs.where("doc_id % 3 = 0").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng, items = np.random.default_rng(4), [(r["item_id"], r["text"]) for r in bench.collect()]
    fill = [w for r in small.limit(20).collect() for w in decontaminate.WORD.findall((r["text"] or "").lower())]
    light = []  # paraphrases: a share of the words replaced or left out, in the midst of other text
    for n, (_, text) in enumerate(items):
        own = decontaminate.WORD.findall(text.lower())
        lost = rng.random(len(own)) < (0.08, 0.15, 0.2, 0.5)[n % 4]
        own = [w for k, w in enumerate(own) if not lost[k] or k % 2]
        own = [fill[int(rng.integers(len(fill)))] if lost[k] and k < len(lost) else w for k, w in enumerate(own)]
        around = [fill[int(k)] for k in rng.integers(len(fill), size=60)]
        light.append((10**9 + n, " ".join(around[:30] + own + around[30:])))
    corpus = small.unionByName(spark.createDataFrame(light, "doc_id long, text string"))
    known = decontaminate.read_items(items)
    s, want = decontaminate.Settings(), set()
    numbered = decontaminate.term_numbers(corpus, known.terms).collect()
    idf = np.zeros(len(known.terms))
    held, passages = decontaminate.passage_counts(decontaminate.term_numbers(corpus, known.terms), len(known.terms))
    idf = np.log((passages + 1) / (held + 1)) + 0.1
    answers = [frozenset(sorted(set(w.tolist()), key=lambda x: (-idf[x], x))[: s.answer_words]) for w in known.words]
    for r in numbered:
        words = np.frombuffer(r["words"], "i4")
        for i, own in enumerate(known.words):
            if np.isin(own, words).mean() < s.common_with_answer:
                continue
            for at in range(0, max(1, len(words) - len(own)), 5):
                near = words[at : at + 2 * len(own)]
                near = near[near >= 0].tolist()
                common = decontaminate.common_words(known.masks[i], len(own), near) / len(own)
                if common >= s.common or (common >= s.common_with_answer and len(answers[i].intersection(near)) >= s.answer * len(answers[i])):
                    want.add((r["doc_id"], known.ids[i]))
                    break
    rows = decontaminate.find_matches(corpus, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(want) > 30 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    for r in rows:
        if r["doc_id"] >= 10**9:
            assert abs(r["first_word"] - 30) <= 25


def test_first_match():
    assert decontaminate.first_match([1, 2, 3], [9, 1, 9, 2, 9, 3, 9], 3) == 1
    assert decontaminate.first_match([1, 2, 3], [1, 1, 2, 3, 4], 3) == 1
