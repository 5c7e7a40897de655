"""Exact substring dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

A string of `length` bytes can only be repeated if its anchor is: the leftmost smallest hash among its
`gram`-byte substrings, which depends on nothing but the string. So every start in a text belongs to
one anchor, and starts with the same anchor are neighbours.

1. The anchors of all texts are listed (about one in 85 bytes); those whose hash stands in one place
   only are done with.
2. The starts of the other anchors are split in two: those whose string holds the anchor and all of
   the bytes to its left within half a string, and those that hold the right side. Each part has a key,
   the hash of what all of its strings share, and a context, the bytes from its first to its last
   string. Equal contexts of a key are one, with a count; they are counted before they are shuffled.
   Two or more equal contexts repeat all of their strings. (Contexts are equal by 128-bit digests.)
3. Keys with several different contexts go to shards. A shard sorts the suffixes of its contexts as
   Larsson and Sadakane do, doubling the depth and sorting only groups that are not single yet, and
   Kasai's pass gives each string's common prefix with the one before it; `length` bytes or more are
   a repeat.
4. A key with more than `shard_contexts` contexts is dealt over several shards, and their strings are
   merged: each shard gives its distinct strings, as 128-bit digests, and those that a binary search
   finds in several shards are repeated in each.

Defined results: a null text is an empty text and stays null; texts shorter than `length` keep all;
repeated rows are texts of their own, so they repeat each other; null ids are texts like any other;
other columns pass through (added names replace clashing ones); an empty table gives none. A cut
inside a character leaves bytes that are not valid UTF-8: kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import free_name, materialize, plain_name, work_folder

GRAM = 32
BLOCK = 2_000_000  # bytes hashed at a time; a longer text is a block of its own
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Ids that may be broadcast to pick the texts that are needed again.
BROADCAST_IDS = 2_000_000
#: Strings merged by a task.
MERGED_STRINGS = 250_000


class Hashes:
    """Hashes of all substrings of some bytes, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        power = np.full(len(data) + 1, _BASE, "u8")
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        # sums[i] is the value of the first i bytes, the later ones weighing less
        inverse = np.full(len(data) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), "u8")
        inverse[0] = 1
        terms = (data.astype("u8") + np.uint64(1)) * np.multiply.accumulate(inverse)[: len(data)]
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(terms, dtype="u8")])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.power[start]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(32))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        h = (self.sums[size:] - self.sums[:n]) * self.power[:n]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, hash) of every anchor; positions are within the text."""
    sizes = np.array([len(t) for t in texts], "i8")
    data = np.frombuffer(b"".join(texts), "u1")
    if len(data) < length:
        return tuple(np.zeros(0, "i8") for _ in range(5))
    bits = np.uint64(32)  # places in the low bits: equal for all blocks, so that a string's anchor is
    grams = Hashes(data).grams(GRAM)
    places = np.arange(len(grams), dtype="u8")
    low = _window_min(((grams >> bits) << bits) | places, length - GRAM + 1)
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= ends[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    # starts of one text and anchor are a run; those past the text's last string are cut off its end
    last = np.minimum(np.append(begin[1:], len(at)) - 1, ends[owner[begin]] - length)
    keep = valid[begin] & (last >= begin)
    begin, last = begin[keep], last[keep]
    text, anchor = owner[begin], at[begin]
    base = (ends - sizes)[text]
    return text, anchor - base, begin - base, last - base, grams[anchor].view("i8")


def halves(text: bytes, rows: list, length: int) -> list[tuple[int, int, int, int, int]]:
    """(key, digest of the context in two parts, first start, last start) of both parts of each (anchor, first, last)."""
    h, half = Hashes(np.frombuffer(text, "u1")), (length - GRAM) // 2
    a, lo, hi = (np.array(x, "i8") for x in zip(*rows, strict=True))
    out = []
    left, right = np.minimum(hi, a - half), np.maximum(lo, a - half + 1)
    for first, last, start, end, side in ((lo, left, a - half, a + GRAM, 0), (right, hi, a, a + GRAM + half, 1)):
        use = np.flatnonzero(first <= last)
        key = h.of(start[use], end[use]) * np.uint64(2) + np.uint64(side)
        spans = list(zip(first[use].tolist(), last[use].tolist(), a[use].tolist(), strict=True))
        # the place of the anchor in the context is part of what makes contexts equal
        digests = b"".join([xxhash.xxh3_128_digest(text[x : y + length], at - x) for x, y, at in spans])
        c = np.frombuffer(digests, "<i8").reshape(-1, 2)
        out += zip(key.view("i8").tolist(), c[:, 0].tolist(), c[:, 1].tolist(), first[use].tolist(), last[use].tolist(), strict=True)
    return out


#: Symbols in a number: bytes, and one beyond them for the end of a context.
PACKED = 7


def packed_symbols(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The next symbols from each position as one number; room: bytes to the end of the position's context."""
    n, value = len(data), np.zeros(len(data), "i8")
    for k in range(PACKED):
        symbol = np.full(n, 256, "i8")
        symbol[: n - k] = data[k:]
        symbol[room <= k] = 256
        value = (value << 9) | symbol
    return value


def suffix_order(value: np.ndarray, room: np.ndarray) -> np.ndarray:
    """All positions in the order of their suffixes, by Larsson-Sadakane refinement.

    rank holds the place of a position's group at the present depth; each round doubles the depth and
    sorts only groups of two or more. A suffix ends with its context, by a symbol that is above all
    bytes and, of two, smaller where it stands earlier; so in the end no two are equal.
    """
    n, depth = len(value), PACKED
    order = np.argsort(value, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = (value[order[1:]] == value[order[:-1]]) & (room[order[1:]] >= depth)
    rank = np.empty(n, "i8")
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(same, 0, place))
    open_ = same.copy()
    open_[:-1] |= same[1:]
    at = np.flatnonzero(open_)
    while len(at):
        members = order[at]
        inside = room[members] > depth
        after = np.where(inside, rank[np.where(inside, members + depth, 0)], n + members)
        group = rank[members]
        resorted = np.lexsort((after, group))
        members, after, group = members[resorted], after[resorted], group[resorted]
        order[at] = members
        same = np.zeros(len(at), bool)
        same[1:] = (group[1:] == group[:-1]) & (after[1:] == after[:-1])
        rank[members] = np.maximum.accumulate(np.where(same, 0, at))
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = at[open_]
        depth *= 2
    return order


def common_prefixes(value: np.ndarray, room: np.ndarray, before: np.ndarray, base: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Kasai's pass over the starts of all contexts in step: the common prefix, up to `most`, with the suffix before.

    before: the position before each one in suffix order, or -1; a context has its `windows` starts from
    its base on. From one start to the next the common prefix gets shorter by one byte at most.
    """
    out = np.zeros(len(value), "i4")
    order = np.argsort(-windows, kind="stable")
    base, turn = base[order], -windows[order]
    h = np.zeros(len(base), "i8")
    for t in range(int(windows.max(initial=0))):
        m = int(np.searchsorted(turn, -t))
        i = base[:m] + t
        j = before[i]
        own = np.maximum(h[:m] - 1, 0)
        own[j < 0] = 0
        left = np.where(j < 0, 0, np.minimum(room[i], room[j]))
        on = np.flatnonzero((own < most) & (own < left))
        while len(on):
            done = own[on]
            differ = value[i[on] + done] ^ value[j[on] + done]
            top = np.frexp((differ & ~(differ >> 1)).astype("f8"))[1]  # the place of the highest bit
            more = np.minimum(np.where(differ == 0, PACKED, PACKED - 1 - (top - 1) // 9), left[on] - done)
            own[on] = done + more
            on = on[(more == PACKED) & (own[on] < most) & (own[on] < left[on])]
        h[:m] = np.minimum(own, most)
        out[i] = h[:m]
    return out


def shard_matches(contexts: list[bytes], counts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, repeated, first) of all strings of the contexts: repeated if equal to another one here, first of its equals in suffix order."""
    sizes = np.array([len(c) for c in contexts], "i8")
    data = np.frombuffer(b"".join(contexts), "u1")
    ends = np.cumsum(sizes)
    base = ends - sizes
    room = np.repeat(ends, sizes) - np.arange(len(data))
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = base[owner] + within
    value = packed_symbols(data, room)
    order = suffix_order(value, room)
    before = np.full(len(data), -1, "i8")
    before[order[1:]] = order[:-1]
    equal = common_prefixes(value, room, before, base, windows, length)[starts] >= length
    repeated = np.zeros(len(data), bool)
    repeated[starts[equal]] = True
    repeated[before[starts[equal]]] = True
    return owner, within, repeated[starts] | (counts[owner] > 1), ~equal


def held_by_several(digests: np.ndarray) -> np.ndarray:
    """Which strings, given as 16-byte digests of the distinct strings of several shards, another shard has: by binary search in all, merged."""
    merged = np.sort(digests)
    return np.searchsorted(merged, digests, side="right") - np.searchsorted(merged, digests, side="left") > 1


def _ranges(owner: np.ndarray, within: np.ndarray, repeated: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(context, first, last) of the runs of repeated starts."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0))
    for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(at) - 1]]), strict=True):
        yield int(owner[at[a]]), int(within[at[a]]), int(within[at[b]])


def _chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose uid is in ids: the ids are broadcast if they are few, else both sides are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "uid", "left_semi")


def repeated_ranges(docs: DataFrame, length: int, folder: str, shard_contexts: int) -> DataFrame:
    """(uid, a, b): byte ranges [a, b) to remove; uid is the number of a stored row. They may overlap."""
    texts = docs.select("uid", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)

    def list_anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            uids, block, held, all_texts = part.column("uid").to_numpy(), [], 0, part.column("text").to_pylist()
            for n, text in enumerate(all_texts):
                block.append(n)
                held += len(text)
                if held >= BLOCK or n == len(all_texts) - 1:
                    own, a, lo, hi, h = anchors([all_texts[k] for k in block], length)
                    arrays = [uids[np.array(block, "i8")[own]], h, *(x.astype("i4") for x in (a, lo, hi))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["uid", "h", "a", "lo", "hi"])
                    block, held = [], 0

    listed = materialize(texts.mapInArrow(list_anchors, "uid long, h long, a int, lo int, hi int"), folder, "anchors")
    # Stored, as the counts of keys below: a join with a table of keys can be split where one key has many rows.
    often = materialize(listed.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), folder, "often")
    cand = listed.join(often, "h").groupBy("uid").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("rows"), F.count("*").alias("k"))
    cand = materialize(cand.drop("k"), folder, "candidates")

    def list_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for uid, text, own in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "rows")), strict=True):
                rows += [(uid, *x) for x in halves(text, [(r["a"], r["lo"], r["hi"]) for r in own], length)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "key", "c1", "c2", "lo", "hi"])

    wanted = _chosen(texts, cand.select("uid")).join(cand, "uid").select("uid", "text", "rows")
    parts = materialize(wanted.mapInArrow(list_parts, "uid long, key long, c1 long, c2 long, lo long, hi long"), folder, "parts")
    unique = parts.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "hi")).alias("at"))
    unique = materialize(unique.select("key", "c1", "c2", "n", "at.*"), folder, "unique")
    copies = parts.join(unique.where("n > 1").select("key", "c1", "c2"), ["key", "c1", "c2"])
    whole = copies.select("uid", F.col("lo").alias("a"), (F.col("hi") + length).alias("b")).distinct()

    # Keys with several contexts; large ones are salted.
    mixed = unique.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    mixed = materialize(mixed.withColumn("salts", F.ceil(F.col("m") / shard_contexts).cast("int")).select("key", "salts"), folder, "salts")
    chosen = materialize(unique.join(mixed, "key"), folder, "mixed")
    total = chosen.count()
    shards = max(48, -(-total // (2 * shard_contexts)))
    lists = chosen.groupBy("uid").agg(F.collect_list(F.struct("key", "c1", "n", "lo", "hi", "salts")).alias("rows"))
    lists = materialize(lists, folder, "lists")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [
                (uid, r["key"], r["n"], r["lo"], r["hi"], r["salts"], r["c1"] % r["salts"], text[r["lo"] : r["hi"] + length])
                for uid, text, own in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "rows")), strict=True)
                for r in own
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "key", "n", "lo", "hi", "salts", "salt", "text"])

    cuts = _chosen(texts, lists.select("uid")).join(lists, "uid").select("uid", "text", "rows")
    cuts = cuts.mapInArrow(cut, "uid long, key long, n long, lo long, hi long, salts long, salt long, text binary")
    cuts = cuts.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int"))

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All contexts of a shard are sorted together: strings that are equal have one key anyway.
        if not (held := [b for b in batches if b.num_rows]):
            return
        part = pa.Table.from_batches(held).combine_chunks()
        texts = part.column("text").to_pylist()
        sizes = np.array([len(t) for t in texts], "i8")
        uid, n, lo, hi, salts, shard = (part.column(c).to_numpy() for c in ("uid", "n", "lo", "hi", "salts", "shard"))
        owner, within, repeated, first = shard_matches(texts, n, hi - lo + 1, length)
        ranges = np.array([(uid[c], lo[c] + a, lo[c] + b + length) for c, a, b in _ranges(owner, within, repeated)], "i8").reshape(-1, 3)
        pick = np.flatnonzero((salts > 1)[owner] & first)  # distinct strings of salted keys, for the merge
        start = (np.cumsum(sizes) - sizes)[owner[pick]] + within[pick]
        flat = b"".join(texts)
        digests = [None] * len(ranges) + [xxhash.xxh3_128_digest(flat[x : x + length]) for x in start.tolist()]
        begin = lo[owner[pick]] + within[pick]
        columns = [np.concatenate([ranges[:, 0], uid[owner[pick]]]), np.concatenate([ranges[:, 1], begin]), np.concatenate([ranges[:, 2], begin + length])]
        alone = np.concatenate([np.zeros(len(ranges), bool), ~repeated[pick]])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in columns), pa.array(alone), pa.array(digests, pa.binary())], names=["uid", "a", "b", "alone", "digest"]
        )

    by_shard = cuts.repartitionById(shards, F.col("shard"))  # tasks that are not put together again: each holds one shard
    found = materialize(by_shard.mapInArrow(sort_shard, "uid long, a long, b long, alone boolean, digest binary"), folder, "found")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            part = pa.Table.from_batches(held).combine_chunks()
            digests = np.frombuffer(b"".join(part.column("digest").to_pylist()), "S16")
            new = held_by_several(digests) & part.column("alone").to_numpy()
            yield from part.select(["uid", "a", "b"]).filter(pa.array(new)).to_batches()

    # The merge of the shards of a salted key: a string of several shards is repeated in each. A shard gives a string once.
    strings = found.where("digest is not null")
    ways = max(48, -(-strings.count() // MERGED_STRINGS))
    single = strings.repartitionById(ways, F.pmod(F.xxhash64("digest"), F.lit(ways)).cast("int")).mapInArrow(merge, "uid long, a long, b long")
    return found.where("digest is null").select("uid", "a", "b").unionByName(whole).unionByName(single)


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_contexts: int = 2000
) -> DataFrame:
    """docs with kept (the bytes left), n_bytes, n_removed and n_spans."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    base = plain_name(docs, ["kept", "n_bytes", "n_removed", "n_spans"]).withColumn(text_col, F.col(text_col).cast("string"))
    own_uid, own_ranges = free_name(base, "_uid"), free_name(base, "_ranges")
    keyed = materialize(base.withColumn(own_uid, F.monotonically_increasing_id()), folder, "texts")
    ranges = repeated_ranges(keyed.select(F.col(own_uid).alias("uid"), F.col(text_col).alias("text")), length, folder, shard_contexts)
    ranges = ranges.groupBy(F.col("uid").alias(own_uid)).agg(F.collect_set(F.struct("a", "b")).alias(own_ranges))
    ranges = materialize(ranges, folder, "ranges")
    ids = ranges.select(own_uid)
    few = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    touched = keyed.join(ids, own_uid, "left_semi").join(ranges, own_uid).drop(own_uid)
    clean = keyed.join(ids, own_uid, "left_anti").drop(own_uid)
    clean = clean.withColumn(own_ranges, F.lit(None).cast(ranges.schema[own_ranges].dataType))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, own in zip(part.column(text_col).cast(pa.binary()).to_pylist(), part.column(own_ranges).to_pylist(), strict=True):
                text, kept, at, spans = text or b"", [], 0, 0
                end = -1
                for a, b in sorted((r["a"], r["b"]) for r in own or ()):
                    if a > end:
                        spans += 1
                        kept.append(text[max(at, 0) : a])
                    end = at = max(end, b)
                kept.append(text[max(at, 0) :])
                left = b"".join(kept)
                rows.append((left, len(text), len(text) - len(left), spans))
            out = part.drop_columns([own_ranges])
            cols = list(zip(*rows, strict=True)) or [()] * 4
            for name, col in zip(("kept", "n_bytes", "n_removed", "n_spans"), cols, strict=True):
                out = out.append_column(name, pa.array(col, pa.binary() if name == "kept" else pa.int64()))
            yield out

    added = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    return touched.unionByName(clean).mapInArrow(cut, T.StructType([*base.schema.fields, *added]))
