"""Document edits: numbered units, checks, placeholders, word differences."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS = "array<struct<paragraph:int,find:string,replace:string,reason:string>>"


def numbered_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit, text) of the paragraphs that are not blank; blank ones are counted too."""
    out = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("unit", "text"))
    return out.where(F.trim("text") != "")


def parse_edits(reply):
    """Edits in a model's reply: the array in it, rows without a valid unit or a replacement dropped."""
    from sediment.functions.text import json_array_in

    return F.filter(F.from_json(json_array_in(reply), EDITS), lambda e: (e["paragraph"] >= 0) & e["replace"].isNotNull())


def check_edits(units: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    """edits (id, unit, find, replace) with status, the number of places and the text after. No find replaces the whole unit."""
    out = edits.join(units, [id_col, "unit"], "left")
    places = (F.length("text") - F.length(F.replace(F.col("text"), F.col("find"), F.lit("")))) / F.length("find")
    whole = F.col("find").isNull() | (F.col("find") == "")
    out = out.withColumn("places", F.when(F.col("text").isNull(), 0).when(whole, 1).otherwise(places).cast("int"))
    out = out.withColumn("status", F.when(F.col("text").isNull(), "missing").when(F.col("places") == 0, "not_found").otherwise("ok"))
    after = F.when(whole, F.col("replace")).otherwise(F.replace(F.col("text"), F.col("find"), F.col("replace")))
    return out.withColumn("after", F.when(F.col("status") == "ok", after))


def placeholders(units: DataFrame, id_col: str) -> DataFrame:
    """(id, name, places, first): the {{names}} of a template, trimmed, by first appearance; places are the distinct (unit, raw), raw as written."""
    raw = F.posexplode(F.regexp_extract_all("text", F.lit(r"\{\{[^}]*\}\}"), F.lit(0))).alias("at", "raw")
    found = units.select(id_col, "unit", raw).withColumn("name", F.trim(F.substring("raw", F.lit(3), F.length("raw") - 4))).where("name <> ''")
    places = F.sort_array(F.collect_set(F.struct("unit", "raw"))).alias("places")
    return found.groupBy(id_col, "name").agg(places, F.min(F.struct("unit", "at")).alias("first"))


def fill(found: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """Edits from (id, name, value), one for each place; blank values fill nothing."""
    given = values.where(F.trim("value") != "")
    out = found.join(given, [id_col, "name"]).select(id_col, "value", F.explode("places").alias("place"))
    return out.select(id_col, "place.unit", F.col("place.raw").alias("find"), F.col("value").alias("replace"))


def cell_edit_reason(found: Column, formula: Column, supported: Column, text: Column, find: Column) -> Column:
    """Why an edit of a spreadsheet's cell is refused, or null: the first that holds of these."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return (
        F.when(~F.coalesce(found, F.lit(False)), "missing").when(F.coalesce(formula, F.lit(False)), "formula").when(~F.coalesce(supported, F.lit(False)), "unsupported")
        .when(blank, "blank").when((F.coalesce(find, F.lit("")) != "") & (F.instr(text, find) == 0), "not_found")
    )


def word_ops(before: str, after: str) -> list[dict]:
    """Word difference by longest common subsequence; white space stays with the word before it. Ties remove first.

    Equal ends are set aside. Of the rest, one row of lengths is held, and one bit for each pair of words.
    """
    a, b = (re.findall(r"\S+\s*|\s+", t or "") for t in (before, after))
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(w, len(numbers)) for w in words[head:]], "i4") for words in (a, b))
    row, remove = np.zeros(len(y) + 1, "i4"), []
    for i in range(len(x) - 1, -1, -1):
        best = np.maximum(row[:-1], row[1:] + (y == x[i]))
        new = np.append(np.maximum.accumulate(best[::-1])[::-1], 0)
        remove.append(np.packbits(row[:-1] >= new[1:]))
        row = new
    remove.reverse()
    out: list[dict] = []

    def add(op: str, text: str) -> None:
        if out and out[-1]["op"] == op:
            out[-1]["text"] += text
        else:
            out.append({"op": op, "text": text})

    for word in a[:head]:
        add("same", word)
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            add("same", a[head + i])
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or remove[i][j >> 3] >> (7 - (j & 7)) & 1):
            add("removed", a[head + i])
            i += 1
        else:
            add("added", b[head + j])
            j += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])))
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([word_ops(a, b) for a, b in zip(before, after, strict=True)])


def latest_artifact(artifacts: DataFrame, conv: str, created: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest artifact of each conversation that has its bytes; of equally new ones the first by ties."""
    w = Window.partitionBy(conv).orderBy(F.desc(created), *ties)
    return artifacts.where("edited_blob is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
