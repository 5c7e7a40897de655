import io
import time
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from sediment.operators import catalog, chunking, citations, edits, repo
from sediment.plans import registry, retrieval
from sediment.sources import embedding, exports, logs, office

CODE = "import os\n\ndef one():\n    a = 1\n    b = 2\n    return a + b + 1000000000\n\nclass Two:\n    x = 1\n    y = 2\n    def z(self):\n        return 3\n"


def test_chunks_keep_tables_whole_and_lose_no_line():
    table = "\n".join(f"| a{i} | b{i} |" for i in range(60))
    text = "# Top\n\n" + "word " * 300 + "\n\n## Part\n\n" + table + "\n\nend."
    got = chunking.chunk_file("x.md", text)
    assert any(c["has_table"] and table in c["content"] for c in got)
    assert "Top > Part" in {c["heading"] for c in got}
    assert chunking.chunk_file("x.md", None) == [] == chunking.chunk_file("x.md", " \n")
    rows = "\n".join(f"{i}\t{'v' * 50}" for i in range(200))
    sheets = chunking.chunk_file("s.xlsx", "## One\nh1\th2\n" + rows + "\n## Two\nplain")
    assert all(c["content"].startswith("## One\nh1\th2") for c in sheets if c["has_table"]) and len(sheets) > 3
    slides = chunking.chunk_file("s.pptx", "[Slide 1]\nhello\n[Slide 2]\n\n[Slide 3]\n" + "text here. " * 500)
    assert slides[0]["content"] == "[Slide 1]\nhello" and all(c["content"].startswith("[Slide 3]") for c in slides[1:])


def test_sheets_and_slides_lose_nothing():
    got = chunking.chunk_file("s.xlsx", "## S\na\tb\n1\t2\nlonely note row\n3\t4")
    assert [(c["content"], c["has_table"]) for c in got] == [("## S\na\tb\n1\t2", True), ("## S\nlonely note row", False), ("## S\na\tb\n3\t4", True)]
    assert [c["content"] for c in chunking.chunk_file("s.xlsx", "## S\n```tsv\nh\tk\n```")] == ["## S\nh\tk"]
    assert [c["chunk_index"] for c in got] == [0, 1, 2]
    assert [c["content"] for c in chunking.chunk_file("a.pptx", "just one line")] == ["just one line"]
    assert [c["content"] for c in chunking.chunk_file("a.pptx", "before\n[Slide 1]\nx")] == ["before", "[Slide 1]\nx"]
    assert len(chunking.chunk_file("a.pptx", "word " * 2000)) > 1


def test_long_text_under_many_headings_is_linear():
    text = "\n".join(f"## Part {n}\n\n" + "some words here. " * 30 for n in range(4000))
    began = time.process_time()
    got = chunking.chunk_file("x.md", text)
    assert time.process_time() - began < 10 and got[-1]["heading"] == "Part 3999"


def test_members_of_typed_languages():
    java = "package a;\n\npublic class One {\n    private int x = 1;\n    private int y = 2;\n\n    public int sum(int k) {\n        return x + y + k;\n    }\n\n    static String name(List<String> all) {\n        return all.get(0);\n    }\n}\n"
    assert [c["symbol"] for c in chunking.chunk_file("A.java", java)] == ["One", "sum", "name"]


def test_code_chunks_cover_all_lines():
    got = chunking.chunk_file("a.py", CODE)
    assert [c["symbol"] for c in got] == ["one", "Two", "z"] and got[0]["start_line"] == 1
    covered = {n for c in got for n in range(c["start_line"], c["end_line"] + 1)}
    assert covered >= set(range(1, len(CODE.rstrip().split("\n")) + 1))
    long = "def f():\n" + "\n".join(f"    value_{i} = {i}" for i in range(300))
    parts = chunking.chunk_file("a.py", long)
    assert len(parts) > 3 and parts[1]["start_line"] == parts[0]["end_line"] - 2


def test_chunk_documents_and_pages(spark):
    docs = spark.createDataFrame([(1, "a.pptx", "[Slide 1]\nx\n[Slide 2]\ny"), (2, "b.txt", None)], "doc_id long, name string, text string")
    got = chunking.page_numbers(chunking.chunk_documents(docs)).orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["page"]) for r in got] == [(1, 1), (1, 2)]


def test_compress_and_steps():
    text = "Intro here. Cats sleep. Dogs bark loudly. Birds sing in trees. Fish swim deep. Cows eat grass. Hens lay eggs."
    short = chunking.compress(text, "bark")
    assert "Dogs bark loudly." in short and "Hens" not in short and short.startswith("Intro here.")
    assert chunking.compress(text, "zebra") == text
    assert chunking.reasoning_steps("a" * 50 + "\n\n" + "b" * 50) == ["a" * 50, "b" * 50]
    assert len(chunking.reasoning_steps("\n\n".join(["s" * 45] * 50))) == 30


def test_edits(spark):
    docs = spark.createDataFrame([(1, "one two\n\nthree {{name}} {{ name }}")], "doc_id long, text string")
    units = edits.numbered_units(docs, "doc_id", "text")
    wanted = spark.createDataFrame([(1, 0, "two", "2"), (1, 1, "x", "y"), (1, 2, None, "all"), (1, 2, "zz", "y")], "doc_id long, unit int, find string, replace string")
    got = [(r["unit"], r["status"], r["after"]) for r in edits.check_edits(units, wanted, "doc_id").orderBy("unit", "find").collect()]
    assert got == [(0, "ok", "one 2"), (1, "missing", None), (2, "ok", "all"), (2, "not_found", None)]
    found = edits.placeholders(units, "doc_id").collect()
    assert [(r["name"], [tuple(p) for p in r["places"]]) for r in found] == [("name", [(2, "{{ name }}"), (2, "{{name}}")])]
    values = spark.createDataFrame([(1, "name", "Eve"), (1, "other", " ")], "doc_id long, name string, value string")
    filled = edits.fill(edits.placeholders(units, "doc_id"), values, "doc_id")
    assert sorted((r["unit"], r["find"], r["replace"]) for r in filled.collect()) == [(2, "{{ name }}", "Eve"), (2, "{{name}}", "Eve")]
    assert edits.check_edits(units, filled, "doc_id").where("status <> 'ok'").count() == 0
    ops = edits.word_ops("a b c", "a x c d")
    assert "".join(o["text"] for o in ops if o["op"] != "added") == "a b c" and "".join(o["text"] for o in ops if o["op"] != "removed") == "a x c d"
    reply = spark.createDataFrame([('ok: ```[{"paragraph": 1, "replace": "x"}, {"paragraph": -1, "replace": "y"}, {"find": "q"}]```',)], "t string")
    assert [e["paragraph"] for e in reply.select(edits.parse_edits(F.col("t"))).first()[0]] == [1]


def test_catalog_and_citations(spark):
    a = spark.createDataFrame([("1.2", "1.10"), ("2", "2.0.0"), ("v3.1", "3")], "a string, b string")
    assert [r[0] for r in a.select(catalog.version_compare(F.col("a"), F.col("b"))).collect()] == [-1, 0, 1]
    r = spark.createDataFrame([(1, 10, 20), (1, 21, 30), (1, 40, 41), (2, 5, 5)], "f int, a int, b int")
    assert sorted(tuple(x) for x in citations.merge_ranges(r, ["f"], "a", "b").collect()) == [(1, 10, 30), (1, 40, 41), (2, 5, 5)]
    p = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 7), (1, 3)], "f int, p int")
    assert citations.page_ranges(p, ["f"], "p").first()["pages"] == "1-3, 7"


def test_repository(spark):
    files = spark.createDataFrame([("r/src/a.py",), ("r/node_modules/b.js",), ("r/vendor",), ("r/yarn.lock",)], "path string")
    assert [x[0] for x in files.select(repo.skipped_path(F.col("path"))).collect()] == [False, True, False, True]
    assert [x["path"] for x in repo.common_root(files, "path").orderBy("path").limit(1).collect()] == ["node_modules/b.js"]
    assert [x["line"] for x in repo.file_tree(files, "path", 2).collect()][-1] == "and 2 more"


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01 10:00:00|web|m1\r",), ("bad|x",), ("nodate|a|b",), ("",)], "value string")
    assert tuple(logs.bad_lines(logs.parse_usage_lines(lines)).first()) == (2, 3)
    m = spark.createDataFrame([("# HELP a",), ("a{x=\"1\"} 3.5",), ("a 9",), ("b_total 2 1700000000",)], "value string").withColumn("line", F.monotonically_increasing_id())
    assert {r["name"]: r["value"] for r in logs.parse_metrics(m).collect()} == {"a": 3.5, "b_total": 2.0}
    book = exports.xlsx_bytes({"One": [["n", "t"], [1, "a&b"], [2.5]], "Two": [["x"]]})
    assert office.xlsx_sheets(book) == {"One": [["n", "t"], ["1", "a&b"], ["2.5", ""]], "Two": [["x"]]}
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "n.txt").write_text("hello")
    (tmp_path / "old.ppt").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in office.read_files(spark, str(tmp_path)).collect()}
    assert got["n.txt"] == ("hello", None) and got["b.xlsx"][0].startswith("## One\n```tsv\nn\tt") and got["old.ppt"][1] and got["bad.docx"][1]


def test_zip_and_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for name, data in {"top/a.py": "x = 1", "top/node_modules/b.js": "y", "top/c.bin": "a\0b", "top/d.txt": " "}.items():
            z.writestr(name, data)
    got = {r["path"]: (r["text"], r["skipped"]) for r in office.read_repositories(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("x = 1", None), "node_modules/b.js": (None, "path"), "c.bin": (None, "binary"), "d.txt": (None, "empty")}
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/long.txt", "x" * 5_000_000)
        z.writestr("a/wide.txt", "漢" * 200_000)
    assert [(p, t is None, s) for p, t, s in office.zip_entries((tmp_path / "big.zip").read_bytes())] == [("long.txt", True, "large"), ("wide.txt", False, None)]
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert office.docx_text(buffer.getvalue()) == "# Title\n| a | b |\n| --- | --- |"


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "id long, content string")
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    out, new = embedding.embed_missing(chunks, cache, lambda texts: [[float(len(t))] for t in texts])
    assert new.count() == 2 and all(r["embedding"] for r in out.collect())
    again, none = embedding.embed_missing(chunks, new, lambda texts: [[9.0]] * len(texts))
    assert none.count() == 0


def test_import_bundle(spark):
    ids = {n: spark.createDataFrame([(o, "n" + o)], "old_id string, new_id string") for n, o in (("project", "p"), ("files", "f"), ("conversations", "c"), ("messages", "m"), ("documents", "d"))}
    ids["chunks"] = spark.createDataFrame([("k1", "n1"), ("k2", "n2")], "old_id string, new_id string")
    bundle = {
        "project": spark.createDataFrame([("p",)], "id string"),
        "chunks": spark.createDataFrame([("k1", "p", "d", "zz"), ("k2", "p", "gone", "c")], "id string, project_id string, document_id string, conversation_id string"),
    }
    got = exports.import_bundle(bundle, ids)
    assert [tuple(r) for r in got["chunks"].select("id", "project_id", "document_id", "conversation_id").collect()] == [("n1", "np", "nd", None)]


def test_compress_holds_few_texts(spark):
    """A batch is worked through in slices of bounded bytes; the result is that of each text."""
    texts = ["a" * 10, None, "", "b" * chunking.SLICE_BYTES, "c", "d" * (2 * chunking.SLICE_BYTES), *["e"] * 1100]
    cuts = list(chunking.slices(pa.array(texts)))
    assert [at for at, _ in cuts] == [0, *(sum(n for _, n in cuts[:k]) for k in range(1, len(cuts)))] and sum(n for _, n in cuts) == len(texts)
    assert all(n == 1 or n <= chunking.SLICE and sum(len(t or "") for t in texts[at : at + n]) <= chunking.SLICE_BYTES for at, n in cuts)
    some = [None, "", "One engine here. Two is far. Three is far. Four is far. Five is far. Six is far. Seven is far."] * 300
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(some)], "id long, text string").coalesce(1)
    got = {r["id"]: r["t"] for r in rows.select("id", chunking.compress_chunk("text", F.lit("engine")).alias("t")).collect()}
    assert got == {n: None if t is None else chunking.compress(t, "engine") for n, t in enumerate(some)} and len(got[2]) < len(some[2])


def test_compress_counts_words_of_three_letters(spark):
    """Of the question all words but function words count, in whatever text; the table is that of a plain restatement."""
    text = "Intro here. Cats sleep. A fox bit the hen. Birds sing with joy. Fish swim deep. Cows eat grass. Hens lay eggs. Owls hoot."
    assert chunking.compress(text, "the fox") == "Intro here.\nCats sleep.\nA fox bit the hen.\nBirds sing with joy."
    assert chunking.compress(text, "foxes") == chunking.compress(text, "fox") != text
    assert chunking.compress(text, "the with a") == text == chunking.compress(text, "")
    asked = ["est", "ouble", "que", "tion"]
    assert sorted(chunking.content_terms(retrieval.ASKED)) == asked
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["text"] for r in registry.QUERIES["compress_passages"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for n, whole in texts.items():
        parts = chunking.sentences_of(whole or "")
        hits = [k for k, part in enumerate(parts) if any(t.startswith(a) or a.startswith(t) for t in chunking.content_terms(part) for a in asked)]
        short = "\n".join(part for k, part in enumerate(parts) if k == 0 or any(abs(k - h) <= 1 for h in hits))
        table = sum("\t" in x or x.strip().startswith("|") for x in (whole or "").split("\n")) > 1
        assert got[n] == (short if hits and len(parts) > 3 and not table and len(short) < 0.8 * len(whole) else whole)
    assert sum(got[n] != texts[n] for n in texts) > 20
