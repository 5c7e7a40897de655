"""Office files and zipped repositories from binaryFile rows, one file at a time inside a task."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from sediment.operators.repo import GENERATED, SKIPPED_FOLDERS
from sediment.operators.rows import flat_map_rows

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _find(node, name: str) -> list:
    return [x for x in node.iter() if _local(x) == name]


def _cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ").strip()


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a table between pipes; short rows are padded."""
    wide = max(map(len, rows), default=0)
    padded = [[_cell(c) for c in r] + [""] * (wide - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in padded]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) if lines else ""


def docx_text(data: bytes) -> str:
    """Paragraphs and tables of a document, in order; headings with their marks, pictures as placeholders."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(_find(ElementTree.fromstring(z.read("word/document.xml")), "body")))
    out, pictures = [], 0
    for node in body:
        if _local(node) == "tbl":
            out.append(pipe_table([["".join(t.text or "" for t in _find(c, "t")) for c in _find(r, "tc")] for r in _find(node, "tr")]))
        elif _local(node) == "p":
            text = "".join(("\t" if _local(t) == "tab" else t.text or "") for t in node.iter() if _local(t) in ("t", "tab"))
            style = next((v for s in _find(node, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            if m := re.fullmatch(r"Heading([1-6])", style):
                text = "#" * int(m[1]) + " " + text
            for _ in _find(node, "blip"):
                text += f"\n%%OCR_IMG_{pictures}%%"
                pictures += 1
            out.append(text)
    return "\n".join(out).strip()


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def xlsx_sheets(data: bytes) -> dict[str, list[list[str]]]:
    """The cells of every sheet as text; the extent is taken from the cells, not from the stated range."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in _find(si, "t")) for si in _find(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in _find(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = rels[sheet.get(_REL + "id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            cells = {}
            for c in _find(ElementTree.fromstring(z.read(path)), "c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                value = next((v.text or "" for v in c if _local(v) == "v"), "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in _find(c, "t"))
                if m:
                    cells[int(m[2]) - 1, column_number(m[1])] = value
            tall = max((r for r, _ in cells), default=-1) + 1
            wide = max((c for _, c in cells), default=-1) + 1
            out[sheet.get("name")] = [[cells.get((r, c), "") for c in range(wide)] for r in range(tall)]
        return out


def xlsx_text(data: bytes) -> str:
    """Every sheet under its name, as tab-separated rows in a fence."""
    return "\n\n".join(f"## {name}\n```tsv\n" + "\n".join("\t".join(r) for r in rows) + "\n```" for name, rows in xlsx_sheets(data).items() if rows)


def pptx_text(data: bytes, ocr: Callable[[bytes], str] | None = None) -> str:
    """Slides in the order of the presentation's list (by number where there is none): shapes, tables, notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
        if {"ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"} <= names:
            rels = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target"))) for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            listed = [rels.get(s.get(_REL + "id")) for s in _find(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldId")]
            slides = [s for s in listed if s in names] or slides
        out = []
        for n, path in enumerate(slides, 1):
            parts = [f"[Slide {n}]"]
            tree = ElementTree.fromstring(z.read(path))
            tables = {id(x): x for x in _find(tree, "tbl")}
            inside = {id(p) for t in tables.values() for p in t.iter()}
            for node in tree.iter():
                if id(node) in tables:
                    parts.append(pipe_table([["".join(t.text or "" for t in _find(c, "t")) for c in _find(r, "tc")] for r in _find(node, "tr")]))
                elif _local(node) == "p" and id(node) not in inside and (text := "".join(t.text or "" for t in _find(node, "t")).strip()):
                    parts.append(text)
            rel_path = path.replace("slides/", "slides/_rels/") + ".rels"
            for r in ElementTree.fromstring(z.read(rel_path)) if rel_path in names else ():
                target = posixpath.normpath(posixpath.join("ppt/slides", r.get("Target", "")))
                if "notesSlide" in (r.get("Type") or "") and target in names:
                    notes = " ".join(t.text or "" for t in _find(ElementTree.fromstring(z.read(target)), "t")).strip()
                    parts += [f"Notes: {notes}"] if notes else []
                elif ocr and "image" in (r.get("Type") or "") and target in names and (seen := ocr(z.read(target)).strip()):
                    parts.append(seen)
            out.append("\n".join(parts))
        return "\n\n".join(out)


def zip_entries(data: bytes, most_chars: int = 200_000) -> Iterator[tuple[str, str | None, str | None]]:
    """(path, text, skipped): entries of a repository; paths and sizes are looked at before contents are read, bad entries are told.

    A character takes four bytes at most, so no more than that of an entry is ever unpacked, whatever its header says.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        tops = {i.filename.split("/", 1)[0] if "/" in i.filename else None for i in infos}
        cut = len(tops.pop()) + 1 if len(tops) == 1 and None not in tops else 0
        for info in infos:
            path = info.filename[cut:]
            if set(path.split("/")[:-1]) & set(SKIPPED_FOLDERS) or re.search(GENERATED, path):
                yield path, None, "path"
                continue
            try:
                with z.open(info) as entry:
                    raw = entry.read(4 * most_chars + 1)
                text = raw.decode("utf-8", "replace")
            except (zipfile.BadZipFile, OSError, NotImplementedError):
                yield path, None, "unreadable"
                continue
            head = text[:8192]
            if "\0" in head or head.count("�") > 0.05 * len(head):
                yield path, None, "binary"
            elif not text.strip():
                yield path, None, "empty"
            else:
                yield (path, text, None) if len(text) <= most_chars and len(raw) <= 4 * most_chars else (path, None, "large")


READERS = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


def parse_file(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) by extension; text kinds are decoded, old and unknown binary kinds are refused."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension in READERS:
        try:
            return READERS[extension](data), None
        except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
            return None, f"damaged {extension}: {type(e).__name__}"
    if extension in ("ppt", "doc", "xls", "pdf", "exe", "bin"):
        return None, f"unsupported kind: {extension}"
    text = data.decode("utf-8", "replace")
    return (None, "binary content") if "\0" in text[:8192] else (text, None)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    return flat_map_rows(files, lambda row: [(row["path"], *parse_file(row["path"], row["content"]))], "path string, text string, error string")


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, text, skipped) of the zipped repositories below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    return flat_map_rows(files, lambda row: [(row["path"], *e) for e in zip_entries(row["content"])], "archive string, path string, text string, skipped string")
