"""Exports and imports: whole stores, one project, aggregate sheets."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators.catalog import remap
from sediment.sources.office import column_letters

VERSION = 1


def export_store(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def import_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def project_bundle(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """The rows of one project: its files, conversations, their messages, its chunks, and the documents that chunks refer to."""
    out = {n: tables[n].where(F.col("project_id") == project_id) for n in ("files", "conversations", "chunks")}
    out["project"] = tables["projects"].where(F.col("id") == project_id)
    ids = out["conversations"].select(F.col("id").alias("conversation_id"))
    out["messages"] = tables["messages"].join(ids, "conversation_id", "left_semi")
    kept = out["chunks"].select(F.col("document_id").alias("id")).distinct()
    out["documents"] = tables["documents"].join(kept, "id", "left_semi")
    return out


def write_bundle(bundle: dict[str, DataFrame], path: str) -> None:
    for name, table in bundle.items():
        table.withColumn("version", F.lit(VERSION)).write.mode("overwrite").json(f"{path}/{name}")


def import_bundle(bundle: dict[str, DataFrame], ids: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The bundle under new ids from (old_id, new_id) tables: rows without a required owner go, optional references are emptied."""
    out = {}
    for name, (own, refs) in {
        "project": ("project", {}), "files": ("files", {"project_id": ("project", True)}), "conversations": ("conversations", {"project_id": ("project", True)}),
        "messages": ("messages", {"conversation_id": ("conversations", True)}), "documents": ("documents", {}),
        "chunks": ("chunks", {"project_id": ("project", True), "document_id": ("documents", True), "conversation_id": ("conversations", False)}),
    }.items():
        if name not in bundle:
            continue
        table = remap(bundle[name], ids[own], "id", True)
        for column, (to, required) in refs.items():
            if column in table.columns:
                table = remap(table, ids[to], column, required)
        out[name] = table
    return out


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of small tables: numbers as numbers, all else as text."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="r{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
        for n, rows in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, value in enumerate(row):
                    at = f"{column_letters(c)}{r}"
                    if isinstance(value, (int, float)) and not isinstance(value, bool):
                        cells.append(f'<c r="{at}"><v>{value}</v></c>')
                    elif value is not None:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return buffer.getvalue()


def report_workbook(reports: dict[str, DataFrame], most_rows: int = 10_000) -> bytes:
    """A workbook of aggregates, a sheet each; an aggregate of over most_rows rows is refused."""
    sheets = {}
    for name, table in reports.items():
        rows = [list(r) for r in table.limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"{name} has over {most_rows} rows; write it as Parquet")
        sheets[name] = [table.columns, *rows]
    return xlsx_bytes(sheets)
