"""Generated documents: Markdown to blocks, blocks to slides, warnings, a document writer, previews."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.rows import flat_map_rows

BLOCK = "block int, kind string, level int, text string, items array<string>, rows array<array<string>>"
SLIDE_BLOCKS = 8


def markdown_blocks(text: str | None) -> list[tuple]:
    """(block, kind, level, text, items, rows): headings, paragraphs, lists, tables and fenced code of a text."""
    out: list[list] = []
    lines, n = (text or "").replace("\r\n", "\n").split("\n"), 0

    def add(kind: str, level: int | None = None, body: str | None = None, items: list | None = None, rows: list | None = None) -> None:
        out.append([len(out), kind, level, body, items, rows])

    while n < len(lines):
        line = lines[n].strip()
        n += 1
        if not line:
            continue
        if line.startswith("```"):
            begin = n
            while n < len(lines) and not lines[n].strip().startswith("```"):
                n += 1
            add("code", body="\n".join(lines[begin:n]))
            n += 1
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            add("heading", len(m[1]), m[2])
        elif m := re.match(r"(?:[-*•]|\d+[.)])\s+(.*)", line):
            kind = "numbers" if line[0].isdigit() else "bullets"
            if out and out[-1][1] == kind and lines[n - 2].strip():
                out[-1][4].append(m[1])
            else:
                add(kind, items=[m[1]])
        elif line.startswith("|") and line.endswith("|") and len(line) > 1:
            cells = [c.strip() for c in line[1:-1].split("|")]
            if out and out[-1][1] == "table" and lines[n - 2].strip():
                if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                    out[-1][5].append(cells)
            else:
                add("table", rows=[cells])
        elif out and out[-1][1] == "paragraph" and n > 1 and lines[n - 2].strip():
            out[-1][3] += " " + line
        else:
            add("paragraph", body=line)
    return [tuple(b) for b in out]


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return flat_map_rows(named, lambda row: [(row["id"], *b) for b in markdown_blocks(row["text"])], f"{id_col} {kind}, {BLOCK}")


def to_slides(blocks: DataFrame, id_col: str) -> DataFrame:
    """blocks with slide and title: a slide begins at each heading of level 1 or 2, and again after eight blocks, continued."""
    own = Window.partitionBy(id_col).orderBy("block")
    opens = (F.col("kind") == "heading") & (F.col("level") <= 2)
    out = blocks.withColumn("_part", F.sum(opens.cast("int")).over(own)).withColumn("_opens", opens)
    inside = Window.partitionBy(id_col, "_part").orderBy("block")
    out = out.withColumn("_n", F.sum((~F.col("_opens")).cast("int")).over(inside))
    out = out.withColumn("_page", F.greatest(F.floor((F.col("_n") - 1) / SLIDE_BLOCKS), F.lit(0)))
    out = out.withColumn("title", F.first(F.when(F.col("_opens"), F.col("text"))).over(inside))
    out = out.withColumn("title", F.when(F.col("_page") > 0, F.concat(F.coalesce("title", F.lit("")), F.lit(" (continued)"))).otherwise(F.col("title")))
    slide = F.dense_rank().over(Window.partitionBy(id_col).orderBy("_part", "_page"))
    return out.withColumn("slide", slide).drop("_part", "_opens", "_n", "_page")


def warnings_of(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, only_headings, empty_tables): what is wrong with a generated document."""
    return blocks.groupBy(id_col).agg(F.bool_and(F.col("kind") == "heading").alias("only_headings"), F.count_if((F.col("kind") == "table") & (F.size("rows") < 2)).alias("empty_tables"))


def docx_bytes(blocks: list[tuple]) -> bytes:
    """A document of blocks as markdown_blocks gives them."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def paragraph(text: str | None, style: str | None = None) -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text or "")}</w:t></w:r></w:p>'

    body = []
    for _, kind, level, text, items, rows in blocks:
        if kind == "heading":
            body.append(paragraph(text, f"Heading{level}"))
        elif kind in ("bullets", "numbers"):
            body += [paragraph(f"• {x}" if kind == "bullets" else f"{n}. {x}") for n, x in enumerate(items, 1)]
        elif kind == "table":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
        else:
            body += [paragraph(x) for x in (text or "").split("\n")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>")
    return buffer.getvalue()


def smallest_change(before: str, after: str) -> tuple[int, int, str] | None:
    """(start, end, text): the least span of before to replace, widened to whole words; None if nothing differs."""
    if before == after:
        return None
    start = 0
    while start < min(len(before), len(after)) and before[start] == after[start]:
        start += 1
    end = 0
    while end < min(len(before), len(after)) - start and before[-1 - end] == after[-1 - end]:
        end += 1
    while start and not before[start - 1].isspace():
        start -= 1
    while end and not before[len(before) - end].isspace():
        end -= 1
    return start, len(before) - end, after[start : len(after) - end]


def highlight(html: str, changed: list[str]) -> str:
    """html with the changed texts marked outside of tags, longest first."""
    wanted = sorted({escape(c) for c in changed if c.strip()}, key=len, reverse=True)
    if not wanted:
        return html
    pattern = re.compile("|".join(map(re.escape, wanted)))
    return "".join(p if p.startswith("<") else pattern.sub(lambda m: f"<mark>{m[0]}</mark>", p) for p in re.split(r"(<[^>]*>)", html))


def pages_to_text(pages: DataFrame, ocr: DataFrame | None = None, doc: str = "doc_id", page: str = "page", text: str = "text", least: int = 50) -> DataFrame:
    """(doc, text) from extracted pages with marker lines; a page of under `least` characters takes its text from ocr (doc, page, ocr_text)."""
    out = pages
    if ocr is not None:
        out = out.join(ocr, [doc, page], "left").withColumn(text, F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < least, F.coalesce("ocr_text", text)).otherwise(F.col(text)))
    body = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(page, body.alias("t")))), lambda x: x["t"])
    return out.groupBy(doc).agg(F.array_join(parts, "\n\n").alias(text))


def inject_ocr(docs: DataFrame, results: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with %%OCR_IMG_n%% replaced by the text of (id, image, ocr_text); pictures without one leave nothing."""
    given = results.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col("image").cast("string"), "ocr_text"))).alias("_ocr"))
    parts = F.split(text_col, "%%")
    filled = F.transform(parts, lambda p: F.when(p.rlike(r"^OCR_IMG_\d+$"), F.coalesce(F.try_element_at("_ocr", F.regexp_extract(p, r"(\d+)$", 1)), F.lit(""))).otherwise(p))
    return docs.join(given, id_col, "left").withColumn(text_col, F.array_join(filled, "")).drop("_ocr")
