import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import text as tx
from sediment.operators import inverted_index, lexical

TEXTS = ["Ankara'nın e-posta adresi", "COVID-19 rock'n'roll", "a 1 b2 -x- y--z", "İstanbul IŞIK ılık", "", None, "l’été 5'te x", "state-of-the-art's art", "ǅ Σας ΣΑΣ", "x_y 3_4", "don't-stop", "日本語 テキスト-x"]


def test_terms_equal_columns(spark):
    """The terms of the Arrow path are those of the column function, words of all kinds included."""
    rng = random.Random(3)
    alphabet = "aBİIıçŞâ1２-'’ _.-\n\t éßΣ漢½𝄞"
    rows = [(n, t) for n, t in enumerate(TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: sorted(lexical.terms_of(r["text"])) for r in df.collect()}
    for r in df.select("doc_id", tx.tokens(F.col("text")).alias("t")).collect():
        assert got[r["doc_id"]] == sorted(r["t"])
    for r in lexical.cut(df).collect():
        assert sorted(t for t, n in zip(r["terms"], r["tfs"], strict=True) for _ in range(n)) == got[r["id"]] and r["dl"] == len(got[r["id"]])


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan")


def test_texts_are_read_once(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = lexical.matches(docs, ["the", "que"])
    assert "text" not in found.columns and "documents.parquet" not in "".join(found.inputFiles())
    asked = lexical.bm25(docs, "the tion que")
    assert "documents.parquet" not in "".join(asked.inputFiles())  # scores come from the narrow table
    assert scans(lexical.postings(docs)) == 1 == scans(lexical.term_frequencies(docs))
    both = lexical.document_frequency(lexical.postings(docs)).join(lexical.term_frequencies(docs).withColumnRenamed("df", "n"), "term", "full")
    assert both.where("df is distinct from n").isEmpty()


@pytest.fixture(scope="module")
def corpus(spark):
    """3000 chunks of a skewed vocabulary: one term in all, some in a few."""
    rng = random.Random(11)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for n in range(3000):
        body = ["the"] * rng.choice([1, 1, 1, 2, 9]) + rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=rng.choice([0, 3, 30, 200]))
        rows.append((n * 7919 % 100_003, " ".join(body + ["rare"] * (n % 997 == 5) * rng.randint(1, 4))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    made = inverted_index.InvertedIndex(spark, f"file://{tmp_path_factory.mktemp('index')}")
    for n in range(3):
        assert made.add(corpus.where(F.col("doc_id") % 3 == n)) == n + 1
    return made


QUERIES = [("the rare w3", 3), ("the", 10), ("rare", 500), ("the w0 w1 w2 w200", 10), ("w399 w398", 1), ("nothing here", 5), ("", 5), ("the The THE rare-rare", 40)]


def test_search_equals_bm25(index, corpus):
    for query, k in QUERIES:
        got = [(r["doc_id"], round(r["score"], 8)) for r in index.search(query, k).result.collect()]
        want = lexical.bm25(corpus, query).orderBy(F.desc(F.round("lex_score", 9)), "doc_id").limit(k)
        assert got == [(r["doc_id"], round(r["lex_score"], 8)) for r in want.collect()], query


def test_blocks_are_left_unread(index):
    found = index.search("the rare w3", 3)
    assert "the" not in found.essential and found.floor > 0 and found.blocks_read * 2 < found.blocks
    one = index.search("w0", 5)
    assert one.blocks_read * 2 <= one.blocks


def test_blocks_are_even_and_bounded(index):
    rows = index.blocks().collect()
    for r in rows:
        assert r["n"] == len(r["ids"]) == len(r["tfs"]) == len(r["dls"]) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])
        assert r["n"] < 2 * inverted_index.BLOCK and r["bucket"] == inverted_index.bucket_of(r["term"])
    assert len({(r["tier"], r["block"]) for r in rows if r["term"] == "the" and r["batch"] == 1}) >= 4


def test_search_reads_only_its_buckets(index):
    plan = index.blocks(["the", "w3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "PushedFilters: [In(term" in plan
    files = index.blocks(["the"]).select("ids").inputFiles()
    assert files
    heads = index.blocks(["the"]).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in heads.split("ReadSchema")[1]


def test_adding_rewrites_nothing(spark, index, corpus, tmp_path):
    made = inverted_index.InvertedIndex(spark, f"file://{tmp_path}")
    assert made.search("the").result.collect() == [] and made.blocks().collect() == []
    made.add(corpus.where("doc_id % 3 = 0"))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    made.add(corpus.where("doc_id % 3 = 1"))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items()) and len(list(tmp_path.rglob("*.parquet"))) > len(files)
    # A batch whose row was never written is not read.
    before = made.search("the rare", 5).result.collect()
    spark.read.parquet(f"file://{tmp_path}/postings").where("batch = 1").drop("batch").write.parquet(f"file://{tmp_path}/postings/batch=9")
    assert made.search("the rare", 5).result.collect() == before
    with pytest.raises(ValueError):
        made.add(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    made.add(corpus.limit(0))
    assert made.search("the rare", 5).result.collect() == before


def test_texts_become_runs_of_terms(corpus):
    """A term gives a row for each run, not for each chunk, and the statistics come along."""
    got = lexical.runs(corpus.coalesce(2)).collect()
    terms, whole = [r for r in got if r["term"] is not None], [r for r in got if r["term"] is None]
    want = {(r["id"], t): (n, r["dl"]) for r in lexical.cut(corpus).collect() for t, n in zip(r["terms"], r["tfs"], strict=True)}
    assert {(i, r["term"]): (f, d) for r in terms for i, f, d in zip(r["ids"], r["tfs"], r["dls"], strict=True)} == want
    assert len(terms) <= 2 * 402 and sum(r["n"] for r in terms) == len(want)
    assert sum(r["n"] for r in whole) == 3000 and sum(r["nulls"] for r in whole) == 0


def test_what_a_killed_job_left_is_replaced(spark, corpus, tmp_path):
    """A batch that was written but does not count leaves its number to the next; ids of strings."""
    some = corpus.where("doc_id % 5 = 0").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    made = inverted_index.InvertedIndex(spark, f"file://{tmp_path}")
    made.add(corpus.where("doc_id % 5 = 1").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    (tmp_path / "batches").rename(tmp_path / "never")
    assert made.add(some) == 1
    got = [(r["doc_id"], round(r["score"], 8)) for r in made.search("the rare w3", 5).result.collect()]
    want = lexical.bm25(some, "the rare w3").orderBy(F.desc(F.round("lex_score", 9)), "doc_id").limit(5).collect()
    assert got == [(r["doc_id"], round(r["lex_score"], 8)) for r in want]
    assert made.blocks().agg(F.sum("n")).first()[0] == lexical.postings(some).count()
