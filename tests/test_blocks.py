from sediment.operators import blocks
from sediment.sources import office

TEXT = "# Title\nhello\nworld\n\n- a\n- b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n## Part\n```\ncode\n```\n" + "\n\n".join(f"p{i}" for i in range(10))


def test_markdown_and_slides(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "# Only"), (3, None)], "doc_id long, text string")
    got = blocks.blocks_of(docs, "doc_id", "text").cache()
    kinds = [r["kind"] for r in got.where("doc_id = 1").orderBy("block").collect()]
    assert kinds[:6] == ["heading", "paragraph", "bullets", "table", "heading", "code"] and len(kinds) == 16
    slides = blocks.to_slides(got, "doc_id").where("doc_id = 1").groupBy("slide", "title").count().orderBy("slide").collect()
    assert [tuple(r) for r in slides] == [(1, "Title", 4), (2, "Part", 9), (3, "Part (continued)", 3)]
    assert {r["doc_id"]: r["only_headings"] for r in blocks.warnings_of(got, "doc_id").collect()} == {1: False, 2: True}


def test_docx_round_trip():
    data = blocks.docx_bytes(blocks.markdown_blocks(TEXT))
    text = office.docx_text(data)
    assert text.startswith("# Title\nhello world\n• a\n• b\n| x | y |\n| --- | --- |\n| 1 | 2 |\n## Part\ncode")


def test_changes_and_marks():
    assert blocks.smallest_change("one two three", "one tWo three") == (4, 7, "tWo")
    assert blocks.smallest_change("same", "same") is None
    assert blocks.smallest_change("in 2011 x", "in 2026 x") == (3, 7, "2026")
    assert blocks.highlight("<p>a b</p>", ["a", "p"]) == "<p><mark>a</mark> b</p>"


def test_pages_and_pictures(spark):
    pages = spark.createDataFrame([(1, 2, "x"), (1, 1, "long " * 20)], "doc_id long, page int, text string")
    ocr = spark.createDataFrame([(1, 2, "seen")], "doc_id long, page int, ocr_text string")
    assert blocks.pages_to_text(pages, ocr).first()["text"].endswith("[Page 2]\nseen")
    docs = spark.createDataFrame([(1, "a %%OCR_IMG_0%% b %%OCR_IMG_1%%"), (2, "c")], "doc_id long, text string")
    seen = spark.createDataFrame([(1, 0, "pic")], "doc_id long, image int, ocr_text string")
    assert {r["doc_id"]: r["text"] for r in blocks.inject_ocr(docs, seen, "doc_id", "text").collect()} == {1: "a pic b ", 2: "c"}
