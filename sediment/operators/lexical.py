"""Terms of chunks, corpus statistics and BM25.

Texts are cut once, in Arrow batches, by a cache of the words between white space: a word's terms are
worked out when a worker first meets it, so that a text costs about one split and one count. The terms
are those of functions.text.tokens (tests hold both against each other).
"""

from __future__ import annotations

import string
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sediment.functions.text import FOLD_FROM, FOLD_TO
from sediment.sources.work import stored

K1, B = 1.5, 0.75

_DOTS, _FOLD = str.maketrans("İI", "iı"), str.maketrans(FOLD_FROM, FOLD_TO)
_SUFFIX = regex.compile(r"['’][\p{L}\p{N}'’-]*")
_BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")
_COMPOUND = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}\p{N}]+(?:-+[\p{L}\p{N}]+)+")
_DIGIT = regex.compile("[0-9]")
#: What may stand around a word without a bearing on it: an apostrophe may not, since what follows it goes.
_MARKS = "".join(c for c in string.punctuation if c != "'")
#: Words a worker remembers before it starts anew; words longer than this many characters are never remembered.
CACHED_WORDS, CACHED_CHARS = 200_000, 64
#: Postings that a task gathers by term before it sends them on.
RUN = 1_000_000


def terms_of(text: str | None) -> list[str]:
    """The terms of a text: parts of words, then the wholes of hyphenated words."""
    if not text:
        return []
    text = _SUFFIX.sub("", text.translate(_DOTS).lower().translate(_FOLD))
    parts = [p for p in _BETWEEN.split(text) if len(p) >= 2 or _DIGIT.search(p)]
    return parts + [c.replace("-", "") for c in _COMPOUND.findall(text)] if "-" in text else parts


class Terms(dict):
    """Terms of words; no term spans white space, so that a text's are those of its words."""

    def __missing__(self, word: str) -> list[str]:
        found = terms_of(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def count(self, text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, times in Counter(text.split() if text else ()).items():
            bare = word.strip(_MARKS)
            if bare.isalnum():  # letters and numbers alone are one term, or none
                term = bare.lower() if bare.isascii() else bare.translate(_DOTS).lower().translate(_FOLD)
                if len(term) >= 2 or _DIGIT.search(term):
                    out[term] = out.get(term, 0) + times
            else:
                for term in self[word]:
                    out[term] = out.get(term, 0) + times
        return out


class Codes(dict):
    """Numbers of terms, in the order in which they are first met."""

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n


def _over_texts(chunks: DataFrame, id_col: str, text_col: str, columns: str, rows_of: Callable[[list, list], list[tuple]]) -> DataFrame:
    """(id, columns): rows_of(ids, counted terms) over some chunks at a time."""
    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms()
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                found = rows_of(part.column("id").to_pylist(), [cache.count(t) for t in part.column("text").to_pylist()])
                columns = list(zip(*found, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def cut(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, terms, tfs): each chunk's number of terms, its distinct terms and how often each occurs; no shuffle."""
    return _over_texts(chunks, id_col, text_col, "dl int, terms array<string>, tfs array<int>", lambda ids, found: [(i, sum(c.values()), list(c), list(c.values())) for i, c in zip(ids, found, strict=True)])


def postings(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): one row per chunk and term. Ids are unique, as those of chunks are, so nothing is shuffled."""
    each = cut(chunks, id_col, text_col).select(F.col("id").alias(id_col), F.explode_outer(F.arrays_zip("terms", "tfs")).alias("x"))
    return each.where("x is not null").select(id_col, F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))


def runs(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n, total, nulls, ids, hashes, tfs, dls): the postings of some chunks at a time, gathered by term, so that a term
    gives a row for RUN postings rather than for each chunk; hashes are the leading 32 bits of the hashes of the ids. A row
    without a term says of its chunks how many they are, how many terms they have in all and how many lack an id. No shuffle.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.shiftrightunsigned(F.xxhash64(id_col), 32).alias("hash"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*T.StructType.fromDDL("term string, n int, total long, nulls int"), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *T.StructType.fromDDL("hashes array<long>, tfs array<int>, dls array<int>")])
    arrow = to_arrow_schema(schema)

    def gathered(ids: list, hashes: list, dls: array, sizes: array, codes: array, tfs: array, terms: list[str]) -> pa.RecordBatch:
        ids, hashes, dls, codes = pa.concat_arrays(ids), pa.concat_arrays(hashes), np.array(dls), np.array(codes)
        order = np.argsort(codes, kind="stable")
        at = np.repeat(np.arange(len(ids)), sizes)[order]
        counts = np.bincount(codes, minlength=len(terms))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts), [len(codes)]]), pa.int32())  # the last row is that of the chunks
        lists = [ids.take(pa.array(at)), hashes.take(pa.array(at)), pa.array(np.array(tfs)[order]), pa.array(dls[at])]
        heads = [[*terms, None], [*counts.tolist(), len(ids)], [0] * len(terms) + [int(dls.sum(dtype="i8"))], [0] * len(terms) + [ids.null_count]]
        columns = [pa.array(c, k.type) for c, k in zip(heads, arrow, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(ends, x.cast(k.type.value_type)).cast(k.type) for x, k in zip(lists, list(arrow)[4:], strict=True))], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, code = Terms(), Codes()
        held = ids, hashes, dls, sizes, codes, tfs = [], [], array("i"), array("i"), array("i"), array("i")
        for whole in parts:
            for begin in range(0, whole.num_rows, 500):
                part = whole.slice(begin, 500)
                ids.append(part.column("id"))
                hashes.append(part.column("hash"))
                for text in part.column("text").to_pylist():
                    found = cache.count(text)
                    dls.append(sum(found.values()))
                    sizes.append(len(found))
                    codes.extend(map(code.__getitem__, found))
                    tfs.extend(found.values())
                if len(codes) >= RUN:
                    yield gathered(*held, list(code))
                    code.clear()
                    for x in held:
                        del x[:]
        if ids:
            yield gathered(*held, list(code))

    return rows.mapInArrow(run, schema)


def lengths(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl): terms of each chunk, chunks without terms included."""
    found = _over_texts(chunks, id_col, text_col, "dl int", lambda ids, found: [(i, sum(c.values())) for i, c in zip(ids, found, strict=True)])
    return found.withColumnRenamed("id", id_col)


def corpus_stats(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: doc_count and avgdl."""
    return lengths(chunks, id_col, text_col).agg(F.count("*").alias("doc_count"), F.avg("dl").alias("avgdl"))


def document_frequency(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return index.groupBy("term").agg(F.count(id_col).alias("df"))


def term_frequencies(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): chunks that hold each term, counted within each batch first, so that a chunk gives no row per term."""

    def held(_: list, found: list[dict[str, int]]) -> list[tuple]:
        return [(None, term, n) for term, n in Counter(t for c in found for t in c).items()]

    counted = _over_texts(chunks.select(F.lit(None).cast("int").alias("_id"), text_col), "_id", text_col, "term string, df long", held)
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's frequency counts for in a chunk; times its idf, this is its share of the score."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(query: str) -> list[str]:
    return sorted(set(terms_of(query)))


def matches(chunks: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, n, hits), stored: a row for each chunk that holds one of the terms, with n 0 and (term, tf) in hits, and rows of
    statistics: over n chunks the sum of their lengths and, in hits, how many hold each term.

    This is the one reading of the texts that a search needs.
    """
    wanted = frozenset(terms)

    def rows_of(ids: list, found: list[dict[str, int]]) -> list[tuple]:
        rows, total, held = [], 0, Counter()
        for i, counts in zip(ids, found, strict=True):
            hits, dl = [(t, counts[t]) for t in wanted & counts.keys()], sum(counts.values())
            total += dl
            if hits:
                held.update(t for t, _ in hits)
                rows.append((i, dl, 0, [{"term": t, "tf": n} for t, n in sorted(hits)]))
        return [*rows, (None, total, len(ids), [{"term": t, "tf": n} for t, n in held.items()])]

    return stored(_over_texts(chunks, id_col, text_col, "dl long, n long, hits array<struct<term: string, tf: long>>", rows_of), "matches")


def statistics(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, avgdl) as one row, and (term, df), of matches."""
    counts = found.where("n > 0")
    return counts.agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl")), counts.select(F.explode("hits").alias("x")).groupBy("x.term").agg(F.sum("x.tf").alias("df"))


def bm25(chunks: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lex_score) of the chunks that hold a term of the query; terms of the query count once.

    The texts are read and cut once, when this is called; what is left is a narrow table of the chunks
    that match. Its statistics, a row for each term, come to the driver.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.limit(0).select(id_col, F.lit(0.0).alias("lex_score"))
    found = matches(chunks, terms, id_col, text_col)
    whole, held = (x.collect() for x in statistics(found))
    if not held:
        return chunks.limit(0).select(id_col, F.lit(0.0).alias("lex_score"))
    df = F.create_map(*[F.lit(x) for r in held for x in (r["term"], r["df"])])
    hits = found.where("n = 0").select(F.col("id").alias(id_col), "dl", F.explode("hits").alias("x"))
    part = idf(F.lit(whole[0]["n"]), df[F.col("x.term")]) * tf_part(F.col("x.tf"), F.col("dl"), F.lit(whole[0]["avgdl"]))
    return hits.groupBy(id_col).agg(F.sum(part).alias("lex_score")).where("lex_score > 0")
