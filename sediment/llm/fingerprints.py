"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's words are lower-cased (A-Z) runs of bytes other than ASCII white space; its shingles are five
words in a row (with fewer words, all of them as one), hashed to 64 bits. A sketch keeps every
shingle hash below a fixed fraction of all hashes, so that its size grows with the text, two
sketches are comparable whatever the lengths, and the union of sketches is the sketch of the union.
So that short texts have something to compare, a sketch with fewer than `least` hashes goes on to its
`least` smallest; its threshold then says so. Below the lower threshold of two sketches both are
whole, and likeness (Jaccard) and containment are told there.

`with_successor` gives each row the text of the row after it in an order by id, in one shuffle of the
texts: ranges between quantiles of the ids, sorted; the first row of a range is also sent to the
range before it as a guest, and a task reads its range as a stream, one row behind.

A fingerprint is text: base64 of big-endian unsigned 64-bit words, the threshold and then the hashes
in ascending order.

Defined results: a null text is empty; empty texts have no hashes, likeness 1 to each other and 0 to
all else; equal texts have equal fingerprints; texts of any length are read whole, a block at a time; in
the order by id null ids come last and rows of equal ids go by their texts, largest first, null last;
a single row is its own successor; repeated rows are rows of their own; other columns pass through
(added names replace clashing ones); an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sediment.llm.common import free_name, plain_name

WORDS = 5
#: One in so many hashes is kept.
SCALE = 16
LEAST = 64
BLOCK = 1 << 20  # bytes hashed at a time, whatever the length of a text
#: Rows of a range, and the most ranges: so many ids are broadcast at most.
RANGE_ROWS, MOST_RANGES = 4000, 20_000

_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread bits, one to one (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value for each byte, the same for both cases of A-Z.
_VALUE = _mix(np.arange(256, dtype="u8") + np.uint64(_BASE))
_VALUE[65:91] = _VALUE[97:123]
_POWER = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(BLOCK, _BASE, "u8")]))
_INVERSE = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(BLOCK, pow(_BASE, -1, 1 << 64), "u8")]))
_STEPS = np.array([pow(0xD6E8FEB86659FD93, n, 1 << 64) for n in range(WORDS)], "u8")


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of some bytes; a word is the polynomial of its bytes, also over the ends of blocks."""
    hashes, starts = [], []
    left = size = 0  # of the word that the block before ended in
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        inside = ~_SPACE[block]
        edge = np.flatnonzero(np.diff(inside.astype("i1"), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[block] * _POWER[: len(block)], dtype="u8")])
        found = (sums[end] - sums[begin]) * _INVERSE[begin]
        begin = begin + at
        if size and len(found) and inside[0]:  # goes on
            found[0] = (left + pow(_BASE, size, 1 << 64) * int(found[0])) & _ALL
            begin[0] = starts[-1][-1]
            hashes[-1], starts[-1] = hashes[-1][:-1], starts[-1][:-1]
        open_end = len(found) and inside[-1]
        left, size = (int(found[-1]), at + len(block) - int(begin[-1])) if open_end else (0, 0)
        hashes.append(found)
        starts.append(begin)
    if not hashes:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each five words in a row; fewer words are one shingle."""
    if not len(words):
        return words
    width = min(len(words), WORDS)
    count = len(words) - width + 1
    total = np.zeros(count, "u8")
    for n in range(width):
        total += _mix(words[n : n + count]) * _STEPS[n]
    return _mix(total + np.uint64(width))


def sketch(shingles: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """Threshold and kept hashes, ascending."""
    kept = np.unique(shingles)
    limit = np.uint64(_ALL // scale)
    held = int(np.searchsorted(kept, limit, "right"))
    if held < least:
        held = min(least, len(kept))
        limit = kept[held - 1] if held < len(kept) else np.uint64(_ALL)
    return np.concatenate([[limit], kept[:held]]).astype("u8")


def sketches(texts: list[bytes], scale: int = SCALE, least: int = LEAST) -> list[np.ndarray]:
    """The sketch of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < BLOCK // 2):
            size += len(texts[stop]) + 1
            stop += 1
        group = texts[at:stop]
        words, starts = word_hashes(np.frombuffer(b" ".join(group), "u1"))
        ends = np.cumsum([len(t) + 1 for t in group])
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        out += [sketch(shingle_hashes(words[a:b]), scale, least) for a, b in zip(cuts, cuts[1:], strict=False)]
        at = stop
    return out


def to_text(found: np.ndarray) -> str:
    return base64.b64encode(found.astype(">u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype("u8")


def _below(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    limit = min(a[0], b[0])
    return a[1 : 1 + np.searchsorted(a[1:], limit, "right")], b[1 : 1 + np.searchsorted(b[1:], limit, "right")]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingles of two texts; 1 if neither has any."""
    x, y = _below(a, b)
    if not len(a) - 1 and not len(b) - 1:
        return 1.0
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second holds; 1 if the first has none, 0 if it has too few to tell."""
    if not len(a) - 1:
        return 1.0
    x, y = _below(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / max(1, len(x))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    x, y = _below(a, b)
    return np.concatenate([[min(a[0], b[0])], np.union1d(x, y)]).astype("u8")


def _per_batch(df: DataFrame, added: list[tuple[str, T.DataType]], values) -> DataFrame:
    """df with columns that values(batch) gives, some rows at a time."""
    base = plain_name(df, [name for name, _ in added])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                for (name, _), column in zip(added, values(part), strict=True):
                    part = part.append_column(name, column)
                yield part

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added)]))


def fingerprint(docs: DataFrame, text_col: str = "text", scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """docs with fingerprint; no shuffle."""

    def values(part: pa.RecordBatch) -> list[pa.Array]:
        texts = [(t or "").encode() for t in part.column(text_col).to_pylist()]
        return [pa.array([to_text(s) for s in sketches(texts, scale, least)], pa.string())]

    return _per_batch(docs.withColumn(text_col, F.col(text_col).cast("string")), [("fingerprint", T.StringType())], values)


def compare(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """pairs of fingerprints with jaccard and contained, the share of the first that the second holds; null if either is null."""

    def values(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [(from_text(a), from_text(b)) if a and b else None for a, b in zip(part.column(first).to_pylist(), part.column(second).to_pylist(), strict=True)]
        return [pa.array([f(*r) if r else None for r in rows], pa.float64()) for f in (likeness, containment)]

    return _per_batch(pairs, [("jaccard", T.DoubleType()), ("contained", T.DoubleType())], values)


def kept_hashes(fingerprints: DataFrame, keys: list[str], scale: int = SCALE) -> DataFrame:
    """(keys, hash): the hashes under the fixed fraction, each once for each key; merged sketches of groups as rows.

    A group's sketch grows with the group, so it is never held in one row or task.
    """
    top = np.uint64(_ALL // scale)
    schema = T.StructType([*(fingerprints.schema[k] for k in keys), T.StructField("hash", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [from_text(f)[1:] if f else np.zeros(0, "u8") for f in part.column("fingerprint").to_pylist()]
            found = [f[f <= top] for f in found]
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
            columns = [part.column(k).take(at) for k in keys]
            values = np.concatenate([*found, np.zeros(0, "u8")]).view("i8")
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*keys, "hash"])

    return fingerprints.select(*keys, "fingerprint").mapInArrow(run, schema).distinct()


def group_containment(fingerprints: DataFrame, key: str) -> DataFrame:
    """(a, b, shared, contained): of groups of documents, the share of a's shingles that b holds, for pairs that share any.

    A hash that several groups hold gives their pairs; counts meet before the shuffle.
    """
    rows = kept_hashes(fingerprints.where(F.col(key).isNotNull()), [key])
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    held = rows.groupBy("hash").agg(F.collect_list(key).alias("x")).where("size(x) > 1")
    pairs = held.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).where("a <> b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return counts.join(sizes.withColumnRenamed(key, "a"), "a").select("a", "b", "shared", (F.col("shared") / F.col("size")).alias("contained"))


def _ranged(rows: DataFrame, bounds: list[int], id_col: str, columns: list[tuple[str, T.DataType]], make) -> DataFrame:
    """make(batch, range of each row) for the batches of rows; ranges go by descending id, the last is that of null ids."""
    cuts = np.array(bounds, "i8")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                ids = part.column(id_col)
                places = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "right")
                yield make(part, np.where(ids.is_valid().to_numpy(zero_copy_only=False), places, len(cuts) + 1))

    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in columns]))


def _heads(docs: DataFrame, bounds: list[int], id_col: str) -> list[tuple[int, int | None]]:
    """(range, largest id) of the ranges that have rows, in order; only ids are read, and a range gives one row."""

    def largest(part: pa.RecordBatch, places: np.ndarray) -> pa.RecordBatch:
        table = pa.table({"range": places, "id": part.column(0)}).group_by("range").aggregate([("id", "max")])
        return pa.RecordBatch.from_arrays([table["range"].combine_chunks(), table["id_max"].combine_chunks()], names=["range", "id"])

    found = _ranged(docs.select(id_col), bounds, id_col, [("range", T.LongType()), ("id", T.LongType())], largest)
    return [(r["range"], r["id"]) for r in found.groupBy("range").agg(F.max("id").alias("id")).orderBy("range").collect()]


def with_successor(docs: DataFrame, id_col: str, text_col: str, schema: T.StructType, each, range_rows: int = RANGE_ROWS) -> DataFrame:
    """each(rows, texts, own) for rows in the order of descending integer ids: row n has texts[own[n]], the row after it texts[own[n] + 1].

    The row after the last is the first. each gives a batch of the schema.
    """
    docs = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")})
    place, guest = free_name(docs, "range"), free_name(docs, "guest")
    ranges = max(1, min(MOST_RANGES, max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // range_rows))))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(id_col, steps, 100 * ranges)).first()[0] if steps else []
    bounds = sorted(set(bounds or []))
    heads = _heads(docs, bounds, id_col)
    # The head of a range is a guest in the range before it, that of the first range in the last.
    visits = {head: heads[n - 1][0] for n, (_, head) in enumerate(heads)}

    def deal(part: pa.RecordBatch, places: np.ndarray) -> pa.RecordBatch:
        heads_at = [n for n, x in enumerate(part.column(id_col).to_pylist()) if x in visits]
        rows = part.take(pa.array([*range(part.num_rows), *heads_at], pa.int64()))
        to = [*places.tolist(), *(visits[part.column(id_col)[n].as_py()] for n in heads_at)]
        rows = rows.append_column(place, pa.array(to, pa.int32()))
        return rows.append_column(guest, pa.array([False] * part.num_rows + [True] * len(heads_at)))

    columns = [*((f.name, f.dataType) for f in docs.schema), (place, T.IntegerType()), (guest, T.BooleanType())]
    dealt = _ranged(docs, bounds, id_col, columns, deal).repartitionById(len(bounds) + 2, F.col(place))
    dealt = dealt.sortWithinPartitions(place, guest, F.desc_nulls_last(id_col), F.desc_nulls_last(text_col)).drop(place)

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is still to come
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                rows = part if held is None else pa.concat_batches([held, part])
                is_guest = rows.column(guest).to_pylist()
                texts = [t or "" for t in rows.column(text_col).to_pylist()]
                own = [n for n in range(rows.num_rows - 1) if not is_guest[n]]
                held = None if is_guest[-1] else rows.take(pa.array([rows.num_rows - 1]))
                if own:
                    yield each(rows.drop_columns([text_col, guest]).take(pa.array(own)), texts, own)

    return dealt.mapInArrow(stream, schema)


def spliced(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def successor_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """docs without text, with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next:
    how alike a text's fingerprint is to that of its spliced text and to that of the next document."""
    kinds = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType()}
    kinds |= {"near_edited": T.DoubleType(), "near_next": T.DoubleType()}
    base = plain_name(docs, list(kinds))
    kept = [T.StructField(f.name, T.LongType() if f.name == id_col else f.dataType) for f in base.schema if f.name != text_col]

    def each(rows: pa.RecordBatch, texts: list[str], own: list[int]) -> pa.RecordBatch:
        edited = [spliced(texts[n], texts[n + 1]).encode() for n in own]
        found, after = sketches([t.encode() for t in texts], scale, least), sketches(edited, scale, least)
        values = [[len(texts[n]) for n in own], [hashlib.sha256(t).hexdigest() for t in edited], [to_text(found[n]) for n in own], [to_text(s) for s in after]]
        values += [[likeness(found[n], s) for n, s in zip(own, after, strict=True)], [likeness(found[n], found[n + 1]) for n in own]]
        for (name, kind), column in zip(kinds.items(), values, strict=True):
            rows = rows.append_column(name, pa.array(column, to_arrow_type(kind)))
        return rows

    return with_successor(base, id_col, text_col, T.StructType([*kept, *(T.StructField(n, t) for n, t in kinds.items())]), each)
