import corpus_pipeline


def test_pipeline_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and ids
        left[name], docs = len(ids), out
    assert left["line_dedup"] == left["toxicity"]
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_clashing_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, "a b", 1.0, None), (None, None, None, "x"), (2, "", 2.0, None)], "doc_id long, text string, score double, n_dropped string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
        assert stage(spark, docs.limit(0), sf).count() == 0
