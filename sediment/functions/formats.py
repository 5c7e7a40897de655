"""Small formats: tables in HTML, channels, math marks, cells, names, counts, memory lists, routing keys."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions.text import is_numeric_cell, strip, tr_lower


def channel(c: Column, name: str) -> Column:
    """The messages of one channel of a reply in channels, joined by line breaks."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<\|channel\|>{name}<\|message\|>(.*?)(?=<\|end\|>|<\|return\|>|<\|channel\|>|<\|start\|>|$)"))
    return strip(F.array_join(found, "\n"))


def in_channels(c: Column) -> Column:
    return c.contains("<|channel|>")


def is_complete(c: Column) -> Column:
    return c.contains("<|return|>") | (c.contains("<|channel|>final") & c.rlike(r"<\|end\|>\s*$"))


def math_dollars(c: Column) -> Column:
    r"""\( \) as $ and \[ \] as $$."""
    c = F.regexp_replace(c, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(c, r"(?s)\\\((.*?)\\\)", r"\$$1\$")


def cell_value(c: Column) -> Column:
    """A number for plain integers and decimals; a dot before exactly three digits is a grouping mark, so it stays text (null here)."""
    plain = F.regexp_replace(strip(c), ",", ".")
    return F.when(strip(c).rlike(r"^-?\d{1,15}([.,]\d+)?$") & ~strip(c).rlike(r"^-?\d{1,3}\.\d{3}$"), plain.try_cast("double"))


def column_alignment(cells: Column) -> Column:
    """right for an array of cells of which 60 % of those not empty are numbers, else left."""
    full = F.filter(cells, lambda x: strip(x) != "")
    return F.when((F.size(full) > 0) & (F.size(F.filter(full, is_numeric_cell)) >= 0.6 * F.size(full)), "right").otherwise("left")


def short_count(c: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    return F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1_000_000)).when(c >= 1000, F.format_string("%.1fK", c / 1000)).otherwise(c.cast("string"))


def bounding_box(xs: Column, ys: Column) -> Column:
    """(x, y, width, height) around the corners of a quadrilateral."""
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def memory_items(c: Column) -> Column:
    """The items of a memory text: its lines, without bullets and blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*[-*•]\s*", ""))), lambda x: x != "")


def memory_append(memory: Column, item: Column, most: int = 4000) -> Column:
    """(status, memory): added, duplicate, invalid (not 8 to 400 characters) or full; memory changes only if added."""
    def same(x: Column) -> Column:
        return F.regexp_replace(tr_lower(x), r"[\s.!]+", " ")

    item = strip(item)
    grown = F.when(strip(F.coalesce(memory, F.lit(""))) == "", F.concat(F.lit("- "), item)).otherwise(F.concat(memory, F.lit("\n- "), item))
    status = (
        F.when(~F.length(item).between(8, 400), "invalid").when(F.exists(memory_items(memory), lambda x: strip(same(x)) == strip(same(item))), "duplicate")
        .when(F.length(grown) > most, "full").otherwise("added")
    )
    return F.struct(status.alias("status"), F.when(status == "added", grown).otherwise(memory).alias("memory"))


def title_of(reply: Column) -> Column:
    """The title in a model's JSON reply, else its first line, at most 60 characters."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.substring(strip(F.coalesce(F.get_json_object(F.nullif(body, F.lit("")), "$.title"), F.split(strip(reply), "\n")[0])), 1, 60)


def model_key(c: Column) -> Column:
    """A model's name without owner, case and marks."""
    return F.regexp_replace(F.lower(F.element_at(F.split(c, "/"), -1)), r"[^a-z0-9]+", "")


def match_priority(asked: Column, offered: Column) -> Column:
    """1 for equal names, 2 for equal keys, 3 if one key begins with the other, else null."""
    a, b = model_key(asked), model_key(offered)
    return F.when(asked == offered, 1).when(a == b, 2).when(a.startswith(b) | b.startswith(a), 3)


def routing_key(c: Column, size: int = 24) -> Column:
    """A key of fixed length: the id's letters and digits, filled up from its hash."""
    return F.substring(F.concat(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""), F.md5(F.coalesce(c, F.lit("")))), 1, size)


def overflowed(body: Column) -> Column:
    """An error body that says that the context is too long."""
    low = F.lower(body)
    marks = ("context length", "maximum context", "context window", "too many tokens", "prompt is too long")
    out = low.contains(marks[0])
    for m in marks[1:]:
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


@dataclass
class ObjectScan:
    """What is known of a text that grows: the characters from the open object on, and where the reading of them stopped.

    Braces in strings do not count, nor does what follows a backslash; quotes between objects mean nothing.
    """

    tail: str = ""
    scanned: int = 0
    depth: int = 0
    quoted: bool = False
    escaped: bool = False

    def feed(self, piece: str) -> list[str]:
        """The texts of the objects that the piece ends."""
        out: list[str] = []
        text, at = self.tail + piece, self.scanned
        begin = 0
        while at < len(text):
            if self.escaped:
                self.escaped, at = False, at + 1
                continue
            found = (_MARKS if self.depth else _OPENS).search(text, at)
            if not found:
                at = len(text)
                break
            mark, at = found.group(), found.end()
            if not self.depth:
                begin, self.depth = found.start(), 1
            elif mark == "\\":
                self.escaped = True
            elif mark == '"':
                self.quoted = not self.quoted
            elif not self.quoted:
                self.depth += 1 if mark == "{" else -1
                if not self.depth:
                    out.append(text[begin:at])
        if not self.depth:
            begin = len(text)
        self.tail, self.scanned = text[begin:], len(text) - begin
        return out


_OPENS, _MARKS = re.compile("{"), re.compile(r'[{}"\\]')


def complete_objects(buffer: str, start: int = 0) -> tuple[list[dict], int]:
    """The whole objects of a growing text from a place on, and the place after the last; what is no JSON is passed over."""
    scan, out = ObjectScan(), []
    found = scan.feed(buffer[start:])
    for text in found:
        try:
            out.append(json.loads(text))
        except json.JSONDecodeError:
            continue
    after = start
    for text in found:
        after = buffer.index(text, after) + len(text)
    return out, after


def tool_arguments(c: Column, fields: dict[str, str], required: list[str]) -> Column:
    """struct(arguments map<string,string>, error): a tool's arguments as JSON, checked against a closed schema.

    fields maps names to string, number or boolean. error is invalid_json, not_an_object, unknown_field,
    missing_field or wrong_type, the first that holds, or null; blank text is an empty object.
    """
    text = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("{}")).otherwise(c)
    value = F.try_parse_json(text)
    names = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    given = F.from_json(F.when(value.isNotNull() & text.rlike(r"^\s*\{"), text), "map<string,string>")
    error = F.when(value.isNull(), "invalid_json").when(~text.rlike(r"^\s*\{"), "not_an_object")
    error = error.when(F.size(F.array_except(names, F.array(*map(F.lit, fields)).cast("array<string>"))) > 0, "unknown_field")
    error = error.when(F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), names)) > 0, "missing_field")
    shapes = {"string": r'^"', "number": r"^-?[0-9]", "boolean": "^(true|false)$"}
    wrong = F.lit(False)
    for name, kind in fields.items():
        part = F.to_json(F.try_variant_get(value, f'$["{name}"]', "variant"))
        wrong = wrong | F.coalesce(~part.rlike(shapes[kind]), F.lit(False))
    error = error.when(wrong, "wrong_type")
    return F.struct(F.when(error.isNull(), given).alias("arguments"), error.alias("error"))
