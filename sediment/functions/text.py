"""Text functions as native columns: folding, tokens, keys, estimates, HTML, fences, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to ASCII.
FOLD_FROM, FOLD_TO = "şğıçöüâîû", "sgicouaiu"
TRIM = r"^[\s ]+|[\s ]+$"


def tr_lower(c: Column) -> Column:
    """Lower case with the dotted and dotless i told apart."""
    return F.lower(F.translate(c, "İI", "iı"))


def fold(c: Column) -> Column:
    """Lower case and folded to the ASCII letters of FOLD_TO."""
    return F.translate(tr_lower(c), FOLD_FROM, FOLD_TO)


def strip(c: Column) -> Column:
    """Without white space at both ends, no-break space included."""
    return F.regexp_replace(c, TRIM, "")


def is_term(c: Column) -> Column:
    """Two characters or more, or a digit."""
    return (F.length(c) >= 2) | c.rlike("[0-9]")


def tokens(c: Column) -> Column:
    """Search terms: letters and digits; a suffix after an apostrophe is cut; a hyphenated word gives its whole and its parts.

    Terms of one character stay only as parts that are digits. A null text has no terms.
    """
    text = F.translate(tr_lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)
    text = F.regexp_replace(text, r"['’][\p{L}\p{N}'’-]*", "")

    def of(word: Column) -> Column:
        parts = F.filter(F.split(word, "-"), lambda x: x != "")
        kept = F.filter(parts, is_term)
        return F.when(F.size(parts) > 1, F.concat(F.array(F.translate(word, "-", "")), kept)).otherwise(kept)

    return F.flatten(F.transform(F.split(text, r"[^\p{L}\p{N}-]+"), of))


def cache_key(c: Column) -> Column:
    """A query's cache key: trimmed, white space collapsed, lower case; punctuation stays."""
    return tr_lower(F.regexp_replace(strip(c), r"\s+", " "))


def token_estimate(c: Column) -> Column:
    """Estimated tokens: 3.5 characters each outside fenced code, 4 inside."""
    text = F.coalesce(c, F.lit(""))
    code = F.aggregate(F.regexp_extract_all(text, F.lit(r"(?s)(```.*?```)")), F.lit(0), lambda a, x: a + F.length(x))
    return (F.ceil((F.length(text) - code) / 3.5) + F.ceil(code / 4)).cast("int")


def chunk_tokens(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int")


def image_tokens(count: Column, detail: str = "auto") -> Column:
    """Fixed costs of an image: 85 low, 765 high, 500 otherwise."""
    return count * F.lit({"low": 85, "high": 765}.get(detail, 500))


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


#: What a tag leaves in the text, by its name; a closing tag has a slash.
TAG_TEXT = {"/p": "\n\n", "br": "\n", "br/": "\n", "/div": "\n", "/li": "\n", "li": "• "}
TAG_TEXT |= {f"{slash}h{n}": "\n\n" for n in range(1, 7) for slash in ("", "/")}
#: Entities that are decoded, after the ampersand.
ENTITY_TEXT = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'"}


def _looked_up(table: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), other)


def _pieces(c: Column, pattern: str, of) -> Column:
    """c cut into pieces by a pattern, each replaced by of(piece)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), of), "")


def _tag_text(piece: Column) -> Column:
    picture = F.regexp_extract(piece, r'(?i)^<img[^>]*src="OCR_IMG_([0-9]+)"', 1)
    name = F.lower(F.regexp_extract(piece, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    text = F.when(picture != "", F.concat(F.lit("\n%%OCR_IMG_"), picture, F.lit("%%\n"))).otherwise(_looked_up(TAG_TEXT, name, F.lit("")))
    return F.when(piece.rlike("^<[^>]+>$"), text).otherwise(piece)


def html_table(c: Column) -> Column:
    """A table's rows between pipes, short rows padded, pipes in cells escaped, with a rule after the first; no rows give an empty text."""
    def text(cell: Column) -> Column:
        plain = strip(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", " "), r"\s+", " "))
        return F.replace(plain, F.lit("|"), F.lit("\\|"))

    rows = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>")), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>")), text))
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    wide = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(lines) > 0, F.array_join(whole, "\n")).otherwise("")


def html_to_text(c: Column) -> Column:
    """Plain text of HTML: tables as rows between pipes, block ends as line breaks, bullets, pictures as marks, other tags gone, six entities decoded."""
    tables = _pieces(c, r"(?is)<table[^>]*>.*?</table>|(?:(?!<table[^>]*>.*?</table>).)+", lambda x: F.when(x.rlike("(?i)^<table"), F.concat(F.lit("\n\n"), html_table(x), F.lit("\n\n"))).otherwise(x))
    text = F.when(F.lower(c).contains("<table"), tables).otherwise(c)
    text = _pieces(text, r"<[^>]+>|[^<]+|<", _tag_text)
    text = F.regexp_replace(text, "(?i)&amp;", "&")
    entity = lambda x: _looked_up(ENTITY_TEXT, F.lower(F.regexp_extract(x, "^&(.+);$", 1)), x)
    text = F.when(F.instr(text, "&") > 0, _pieces(text, r"(?i)&(?:nbsp|lt|gt|quot|#39);|[^&]+|&", entity)).otherwise(text)
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def is_tabular(c: Column) -> Column:
    """At least three lines that are not blank, of which two, and half of them, hold a tab or stand between pipes."""
    lines = F.size(F.regexp_extract_all(c, F.lit(r"(?m)^.*[^\s ].*$"), F.lit(0)))
    cells = F.size(F.regexp_extract_all(c, F.lit(r"(?m)^(?:.*\t.*|[\s&&[^\n]]*\|.*\|[\s&&[^\n]]*)$"), F.lit(0)))
    return (lines >= 3) & (cells >= 2) & (cells >= F.floor(lines * 0.5))


def matches_title(title: Column, asked: Column) -> Column:
    """A folded title that holds the folded, trimmed words asked for; a blank question matches all."""
    wanted = fold(strip(F.coalesce(asked, F.lit(""))))
    return (wanted == "") | F.contains(fold(F.coalesce(title, F.lit(""))), wanted)


def is_truncated(finish_reason: Column) -> Column:
    """A reply cut at its length."""
    return F.coalesce(finish_reason.isin("length", "max_tokens"), F.lit(False))


def may_fall_back(status: Column) -> Column:
    """Another model may be asked: no status (a network failure) or a server's failure."""
    return status.isNull() | status.between(500, 599)


def picture_worth_reading(width: Column, height: Column, slide_width: Column, slide_height: Column) -> Column:
    """A picture of at least one per cent of its slide; one of unknown size is read."""
    return F.coalesce(width * height / (slide_width * slide_height) >= 0.01, F.lit(True))


def request_tokens(messages: Column) -> Column:
    """The estimate for a whole request from array<struct<content>>: 3.5 characters a token and four more for each message."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.ceil(F.length(F.coalesce(m["content"], F.lit(""))) / 3.5) + 4)


def output_limit(asked: Column, used: Column, window: int, most: int, default: int) -> Column:
    """The tokens that a reply may have: `most` at most, and what the window leaves after 1,024 of reserve, if that is over 256."""
    wanted, left = F.least(F.coalesce(asked, F.lit(default)).cast("long"), F.lit(most)), F.lit(window) - used - 1024
    return F.when((wanted > left) & (left > 256), left).otherwise(wanted)


def fenced_code(header: Column, content: Column, language: Column) -> Column:
    """A chunk under its header; code stands in a fence with its language."""
    return F.concat(header, F.when(language.isNull(), F.concat(F.lit("\n"), content)).otherwise(F.concat(F.lit("\n```"), language, F.lit("\n"), content, F.lit("\n```"))))


def editable_attachments(c: Column, mark: str) -> Column:
    """The names after the mark, on the first line that has it, of files that can be edited."""
    rest = F.regexp_replace(F.regexp_extract(c, "(?m)" + re.escape(mark) + "(.*)$", 1), r"\*+$", "")
    return F.filter(F.transform(F.split(rest, ","), strip), lambda x: x.rlike(r"(?i)\.(docx|pptx|xlsx|pdf)$"))


def large_paste(c: Column) -> Column:
    """Not blank, and over 600 characters or over 10 lines."""
    return (strip(c) != "") & ((F.length(c) > 600) | (F.size(F.split(c, "\n")) > 10))


def chunk_label(name: Column, page: Column, start: Column, end: Column) -> Column:
    """file:line-line for code, file with its page, or the file alone."""
    lines = F.concat(name, F.lit(":"), start.cast("string"), F.when(end != start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit("")))
    return F.when(start.isNotNull() & end.isNotNull(), lines).when(page.isNotNull(), F.concat(name, F.lit(", "), page.cast("string"))).otherwise(name)


def without_thinking(c: Column) -> Column:
    """A reply without reasoning: closed blocks, an unclosed one to the end, and all before a lone closing tag."""
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"(?s)<think>.*$", "")
    return strip(F.regexp_replace(c, r"(?s)^.*</think>", ""))


def json_array_in(c: Column) -> Column:
    """The text from the first [ to the last ], code fences aside; null if there is none."""
    found = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def safe_file_name(c: Column, most: int = 60, fallback: str = "document") -> Column:
    """Without separators and control characters, trimmed of dots and spaces, at most `most` characters; reserved names get an underscore."""
    name = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', " ")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[. ]+|[. ]+$", "")
    name = F.regexp_replace(F.substring(name, 1, most), r"[. ]+$", "")
    reserved = name.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when(name == "", F.lit(fallback)).when(reserved, F.concat(F.lit("_"), name)).otherwise(name)


def is_numeric_cell(c: Column) -> Column:
    """A number as tables write it: digits grouped by dots, a decimal comma or dot, a sign, a currency or percent sign."""
    return strip(c).rlike(r"^[-+]?\s*[₺$€£]?\s*\d{1,3}(\.\d{3})*(,\d+)?\s*[%₺$€£]?$|^[-+]?\s*[₺$€£]?\s*\d+([.,]\d+)?\s*[%₺$€£]?$")
