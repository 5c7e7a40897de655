from pyspark.sql import functions as F

from sediment.functions import dates, formats
from sediment.functions import text as tx
from sediment.operators import catalog, conversation, edits, indexing, select


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_predicates(spark):
    got = one(spark, [("length", None, 503), ("stop", "İzmir Ş", 404), (None, "x", None)], "reason string, title string, status int",
              tx.is_truncated(F.col("reason")), tx.matches_title(F.col("title"), F.lit(" izmir s ")), tx.may_fall_back(F.col("status")))
    assert got == [(True, False, True), (False, True, False), (False, False, True)]
    sizes = one(spark, [(10, 10, 100, 100), (9, 10, 100, 100), (None, 10, 100, 100)], "w int, h int, sw int, sh int", tx.picture_worth_reading(*map(F.col, ("w", "h", "sw", "sh"))))
    assert [r[0] for r in sizes] == [True, False, True]


def test_tables_of_html(spark):
    html = "<p>a &amp;lt; b</p><TABLE><tr><th>x</th><th>y</th></tr><tr><td>1<br></td><td>two words</td></tr></TABLE><ul><li>c</li></ul><img src=\"OCR_IMG_3\">"
    got = one(spark, [(html,), (None,), ("1 < 2",)], "t string", tx.html_to_text(F.col("t")))
    assert got == [("a < b\n\n| x | y |\n| --- | --- |\n| 1 | two words |\n\n• c\n\n%%OCR_IMG_3%%",), (None,), ("1 < 2",)]
    tables = ["a\tb\nc\td\nx", "| a |\n| b |\n| c |", "a\nb\nc", "a\tb\nc", "a\tb\n\nc\nd"]
    assert [r[0] for r in one(spark, [(t,) for t in tables], "t string", tx.is_tabular(F.col("t")))] == [True, True, False, False, False]


def test_fences_and_attachments(spark):
    got = one(spark, [("h", "x = 1", "python"), ("h", "t", None)], "h string, c string, l string", tx.fenced_code(*map(F.col, "hcl")))
    assert got == [("h\n```python\nx = 1\n```",), ("h\nt",)]
    note = "hi\n**Files: a.docx, b.txt, c d.PDF**\nsee e.docx"
    assert one(spark, [(note,)], "t string", tx.editable_attachments(F.col("t"), "Files:")) == [(["a.docx", "c d.PDF"],)]


def test_tool_arguments(spark):
    cases = ['{"q": "x", "n": 2}', "", "{bad", "[1]", '{"q": "x", "z": 1}', '{"n": 1}', '{"q": 5}']
    got = one(spark, [(c,) for c in cases], "t string", formats.tool_arguments(F.col("t"), {"q": "string", "n": "number"}, ["q"])["error"])
    assert [r[0] for r in got] == [None, "missing_field", "invalid_json", "not_an_object", "unknown_field", "missing_field", "wrong_type"]


def test_dates_and_catalog(spark):
    got = one(spark, [("2024-01-02T03:04:05Z",), ("1704164645000",), ("soon",)], "t string", dates.revived(F.col("t")).cast("long"))
    assert got == [(1704164645,), (1704164645,), (None,)]
    rows = spark.createDataFrame([("a:1", 5, None, True), ("b:2", 7, "p", None), ("a:3", 7, None, False)], "key string, used int, project_id string, favourite boolean")
    assert [r["key"] for r in catalog.most_recent(rows, "used", "key", 2).collect()] == ["a:3", "b:2"]
    assert rows.count() == 3 and catalog.purge_other_namespaces(rows, "a:").count() == 2
    assert catalog.without_project(rows).count() == 2 and catalog.favourites(rows).count() == 1


def test_cell_edit_reasons(spark):
    rows = [(False, None, None, None, None), (True, True, True, "a", "a"), (True, False, False, "a", "a"), (True, False, True, " ", "a"), (True, False, True, "abc", "x"), (True, False, True, "abc", "b")]
    got = one(spark, rows, "found boolean, formula boolean, supported boolean, text string, find string", edits.cell_edit_reason(*map(F.col, ("found", "formula", "supported", "text", "find"))))
    assert [r[0] for r in got] == ["missing", "formula", "unsupported", "blank", "not_found", None]


def test_word_difference_is_shortest():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
        ops = edits.word_ops(" ".join(a) + " ", " ".join(b) + " ")
        assert sum(len(o["text"].split()) for o in ops if o["op"] == "same") == size[-1][-1]
    long = [f"w{n % 977}" for n in range(8000)]
    assert len(edits.word_ops(" ".join(long), " ".join(long[::-1]))) > 10


def test_deep_forks_and_cycles(spark):
    rows = [(n, n - 1) for n in range(2, 301)] + [(1, None), (500, 501), (501, 500), (502, 501), (600, 999)]
    got = {r["conv_id"]: (r["root"], r["depth"]) for r in conversation.fork_depth(spark.createDataFrame(rows, "conv_id long, parent_id long")).collect()}
    assert all(got[n] == (1, n - 1) for n in range(1, 301)) and got[600] == (600, 0)
    assert got[500] == got[501] == got[502] == (None, None) and len(got) == len(rows)


def test_rewinds(spark):
    messages = spark.createDataFrame([(1, n, n == 4) for n in range(5)] + [(2, 0, False)], "conv_id long, turn long, rewound boolean")
    targets = spark.createDataFrame([(1, 3), (1, 2), (2, 9)], "conv_id long, from_turn long")
    out = conversation.rewind_from(messages, targets)
    assert sorted((r["conv_id"], r["turn"], r["rewound"]) for r in out.collect()) == [(1, 0, False), (1, 1, False), (1, 2, True), (1, 3, True), (1, 4, True), (2, 0, False)]
    assert sorted(tuple(r) for r in conversation.newly_rewound(messages, targets).collect()) == [(1, 2), (1, 3)]
    assert conversation.visible(messages).count() == 5


def test_packs(spark):
    rows = spark.createDataFrame([("g", n, 5) for n in range(1000)] + [("h", 1, 999), ("h", 2, 1)], "g string, n long, cost long")
    got = select.pack_stop(rows, ["g"], ["n"], "cost", 100).collect()
    assert sorted(r["n"] for r in got if r["g"] == "g") == list(range(20)) and not [r for r in got if r["g"] == "h"]
    skip = select.pack_skip(spark.createDataFrame([("r", 1, 5), ("r", 2, 9), ("r", 3, 4)], "g string, n long, cost long"), ["g"], "n", "cost", 10, "n")
    assert [(r["n"], r["used"]) for r in skip.orderBy("n").collect()] == [(1, 5.0), (3, 9.0)]


def test_diversity_takes_the_class_weight(spark):
    rows = [(q, n, v, s, w) for q, w in ((1, 1.0), (2, 0.1)) for n, v, s in ((1, [1.0, 0.0], 1.0), (2, [1.0, 0.01], 0.9), (3, [0.0, 1.0], 0.5))]
    df = spark.createDataFrame(rows, "q long, doc_id long, embedding array<double>, score double, w double")
    got = {(r["q"], r["position"]): r["doc_id"] for r in select.mmr(df, "q", 2, "w").collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (2, 0): 1, (2, 1): 3}


def test_index_documents(spark):
    docs = spark.createDataFrame([("p", 1, "a.txt", "same text"), ("p", 2, "b.txt", "new text"), ("p", 3, "c.txt", None)], "project_id string, document_id long, name string, text string")
    old = indexing.chunks_of_documents(spark.createDataFrame([("p", 9, "z.txt", "same text"), ("p", 2, "b.txt", "stale")], docs.schema)).withColumn("embedding", F.array(F.lit(7.0)).cast("array<float>"))
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    store, new = indexing.index_documents(docs, old, cache, lambda texts: [[float(len(t))] for t in texts])
    assert sorted((r["document_id"], r["content"], r["embedding"]) for r in store.collect()) == [(1, "same text", [7.0]), (2, "new text", [8.0]), (9, "same text", [7.0])]
    assert new.count() == 1
    store, new = indexing.index_documents(docs, old, cache, lambda texts: [[float(len(t))] for t in texts], reuse=False)
    assert sorted((r["document_id"], r["embedding"]) for r in store.collect()) == [(1, [9.0]), (2, [8.0]), (9, [7.0])]
