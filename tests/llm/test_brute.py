"""Whole queries against plain restatements of them, and odd inputs of every operator."""

import public_tokenizers
import pytest
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm import common, decontaminate, embedding_dedup, features, language_id, line_dedup, ngram_join, packing, quality, queries, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_quality_query_is_an_exact_vote(spark):
    """op5 over all documents equals a vote worked out one document at a time over all labelled vectors."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels.where(common.crc_remainder("doc_id", 4) != 2).select("doc_id", "quality"))
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        want = model.share
        if text:
            x = features.weighted(features.gram_counts([text.encode()], quality.DIMS, quality.SIZES), model.idf)[0] @ model.axes
            cos = [float(np.dot(x, v) / max(np.linalg.norm(x), 1e-9)) for v in model.vectors]
            near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[:25]
            weight = [np.exp(12.0 * (cos[i] - cos[near[0]])) * model.weights[i] for i in near]
            want = sum(w * model.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[doc]["score"] - want) < 1e-3 and got[doc]["predicted"] == int(got[doc]["score"] >= 0.7)


def test_quality_ties_at_the_last_place(spark):
    """Texts of few kinds, both labels on each: equal cosines all over, and at the 25th place."""
    kinds = ["the quick brown fox", "a lazy dog sleeps", "rain in Spain", "lorem ipsum dolor", "winter is coming", "to be or not", "all is well"]
    rng = np.random.default_rng(8)
    rows = [(n, kinds[n % 7], int(rng.random() < 0.2 + 0.1 * (n % 7))) for n in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    for r in quality.score_quality(df, model).collect():
        x = features.weighted(features.gram_counts([r["text"].encode()], quality.DIMS, quality.SIZES), model.idf) @ model.axes
        cos = (x / np.linalg.norm(x) @ model.vectors.T)[0]
        near = sorted(range(len(cos)), key=lambda i: (-round(float(cos[i]), 5), i))[:25]
        weight = np.array([np.exp(12.0 * (cos[i] - cos[near[0]])) * model.weights[i] for i in near])
        assert abs(r["score"] - (weight * model.labels[near]).sum() / weight.sum()) < 1e-3


def test_letters_are_category_l(spark):
    df = spark.createDataFrame([("½ ² ① 12 _", 1), ("½ a", 2)], "text string, doc_id long")
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model, reject=False).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_spans_stand_where_the_words_stand(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs.join(labels.where("toxic = 1"), "doc_id").limit(5), model).collect()
    r = max(scored, key=lambda r: len(r["toxic_spans"]))
    words = [r["text"][s["start"] : s["end"]] for s in r["toxic_spans"]]
    text = "İstanbul İzmir " + r["text"] + " İİ"
    got = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    found = [text[s["start"] : s["end"]] for s in got["toxic_spans"]]
    inner = words[1:-1]  # words at the ends have other neighbours now
    assert len(inner) > 2 and any(found[k : k + len(inner)] == inner for k in range(len(found)))
    assert len(toxicity.words_of(text)) == len(toxicity.places_of(text))


def test_language_query_takes_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(common.crc_remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF).collect()}
    for r in docs.collect():
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        x = features.weighted(features.gram_counts([language_id.cleaned(r["text"])], language_id.DIMS), model.idf)[0]
        cos = [float(np.dot(x, c)) for c in model.centres]
        best = {lang: max(c for c, n in zip(cos, model.lang_of, strict=True) if n == k) for k, lang in enumerate(model.langs)}
        assert best[got[r["doc_id"]]["lang_pred"]] >= max(best.values()) - 1e-5


def test_toxicity_query_scores_by_marginals(spark):
    """op1 over all documents equals scores worked out one document at a time; spans are the tokens over one half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(common.crc_remainder("doc_id", 5) != 0).select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    for r in docs.where("doc_id % 4 = 0").collect():
        words = toxicity.words_of(r["text"])
        own = [toxicity.features_of(w) for w in words]
        gap = np.array([model.own[w] + model.first[a] + model.last[b] for w, a, b in own])
        for k in range(1, len(own)):
            gap[k] += model.left[own[k - 1][0]]
            gap[k - 1] += model.right[own[k][0]]
        p = toxicity.marginals(np.stack([np.zeros(len(gap)), gap], axis=1).reshape(-1, 2), np.array([len(gap)]), model.move)
        x = toxicity.document_features(p, np.array([len(gap)]))[0]
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + np.exp(-np.clip(x @ model.score, -30, 30)))) < 1e-6
        assert len(got[r["doc_id"]]["toxic_spans"]) == int((p >= 0.5).sum())


LONG = "word " * 60_000 + "x" * 100_000
ROWS = [(1, "one two three four five six " * 20, "c"), (1, "one two three four five six " * 20, "c"), (None, None, None), (2, "", "d"), (3, LONG, "e"), (4, LONG, None)]
#: Names that the operators use themselves.
CLASH = ["uid", "v", "rep", "n", "text_", "length", "piece", "token", "k", "doc", "h1", "digest", "_uid", "_row", "lang_", "score", "n_lines", "n_bytes", "kept", "words", "_gone", "_gone_id", "_ranges"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, note string").withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.mark.parametrize("name", ["score_toxicity", "predict", "score_quality", "jaccard", "near_copies", "pack", "leaks", "lines", "counts", "repeats"])
def test_odd_rows(spark, odd, name):
    """Nulls, empty and very long texts, repeated rows and clashing names; then the same without rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    run = {
        "score_toxicity": lambda d: toxicity.score_toxicity(d, toxicity.empty_field()),
        "predict": lambda d: language_id.predict(d, language_id.fit(docs.select("doc_id", "text", "lang"))),
        "score_quality": lambda d: quality.score_quality(d, quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))),
        "jaccard": ngram_join.jaccard_components,
        "near_copies": ngram_join.drop_near_copies,
        "pack": lambda d: packing.pack(d, PATH),
        "leaks": lambda d: decontaminate.drop_contaminated(d, bench.withColumn("words", F.lit(1))),
        "lines": line_dedup.drop_repeated_lines,
        "counts": lambda d: token_counts.count_tokens(d, PATH),
        "repeats": substring_dedup.remove_repeats,
    }[name]
    out = run(odd)
    rows = out.collect()
    assert run(odd.limit(0)).collect() == []
    if name == "near_copies":
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "3", "None"]
    elif name == "jaccard":
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 3), (4, 3)]
    elif name == "pack":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None} and sum(r["piece"] == 0 for r in rows) == 6
    else:
        assert len(rows) == 6 and all(r["note"] == {1: "c", 2: "d", 3: "e"}.get(r["doc_id"]) for r in rows)
        assert all(r[c] == f"own {c}" for r in rows for c in CLASH if c in out.columns and dict(out.dtypes)[c] == "string")


def test_vectors_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in CLASH if c != "vec_id"})
    got = sorted(str(tuple(r)) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == sorted(map(str, [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]))


def test_pipeline_run_equals_its_stages_and_leaves_no_work_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    before = common.work_folders()
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, docs.select(*columns).collect()))
    assert len(common.work_folders()) == len(before) + 1
