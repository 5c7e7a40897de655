"""Best-fit packing of token sequences under several capacities.

A piece of n tokens is the vector (n tokens, 1 document, n * n attention cost). A sequence has a
capacity for each of the three; a piece may only go where all three leave room. Among the open
sequences that can take it, the piece goes to the one with the smallest weighted residual norm after
it, or with the largest weighted dot product of piece and residual.

Two pieces of equal length are alike, so the plan is made for the table of lengths, which has at most
`max_tokens` rows however large the corpus is: longest first, best fit, many equal sequences at a
time. The pieces are then ranked within their length, salted so that no length lands in one task,
and each rank is looked up in the plan.

Defined results: a null text is an empty text, which is one piece that holds the end id alone; a null
id is kept like any other; repeated rows are packed each for itself; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import materialize, work_folder
from sediment.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: documents over max_tokens are cut at multiples of it, others stay whole."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for whole in parts:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * max_tokens)):
                        own = ids[start : start + 4 * max_tokens]
                        rows.append((doc, n, start // 4, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = np.frombuffer(b"".join(cols[5]), "<u4").astype("i4")
                    ends = np.concatenate([[0], np.cumsum(np.array(cols[3], "i8"))]).astype("i4")
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def plan_bins(lengths: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): which sequence takes which piece.

    lengths: pieces of each length. Sequences with equal contents so far are held as one group.
    """
    cap, w = np.array(capacity, "f8"), np.array(weights, "f8")
    room = np.zeros((0, 3))  # residual capacities of each group
    many = np.zeros(0, "i8")
    held: list[list[tuple[int, int]]] = []  # contents of each group: (length, offset)
    for length in sorted(lengths, reverse=True):
        left, need = int(lengths[length]), np.array([length, 1, length * length], "f8")
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1) & (many > 0))
            if len(fits):
                after = (room[fits] - need) / cap
                score = -((after * after) @ w) if rule == "norm" else ((room[fits] / cap) * (need / cap)) @ w
                at = int(fits[np.argmax(score)])
                bins = int(many[at])
            else:
                room, many, at, bins = np.vstack([room, cap]), np.append(many, 0), len(held), left
                held.append([])
            # Equal pieces go on into the sequence that took one while it is the best: by the norm until it
            # is full, by the dot product only if no other one can take them.
            copies = min(left, int((room[at] // need).min())) if rule == "norm" or not len(fits) else 1
            took = min(bins, left // copies)
            if took < many[at]:  # the others of the group stay as they are
                room, many = np.vstack([room, room[at]]), np.append(many, many[at] - took)
                held.append(list(held[at]))
            many[at] = took
            start = int(cap[0] - room[at, 0])
            held[at] += [(length, start + k * length) for k in range(copies)]
            room[at] -= copies * need
            left -= took * copies
    out, first, ranks = [], 0, dict.fromkeys(lengths, 0)
    for own, n in zip(held, many.tolist(), strict=True):
        for length, offset in own:
            out.append((length, ranks[length], n, first, offset))
            ranks[length] += n
        first += n
    return np.array(sorted(out), "i8").reshape(-1, 5)


def assign_sequences(
    pieces: DataFrame,
    max_tokens: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    rule: str = "norm",
    salt_rows: int = 200_000,
) -> DataFrame:
    """pieces (a stored table with a number _row of each) with sequence_id and offset, less _row.

    max_docs and max_attention default to the values that max_tokens implies; smaller ones bind.
    """
    lengths = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    capacity = (max_tokens, max_docs or max_tokens, max_attention or max_tokens * max_tokens)
    plan = plan_bins(lengths, capacity, weights, rule)
    salts = max(64, -(-sum(lengths.values()) // salt_rows))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_place", rank).join(base.drop("_n"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_place") + F.col("_base"))
    broad = pieces.sparkSession.sparkContext.broadcast(plan)  # a few slots for each length, whatever the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length, rank):
        import pandas as pd

        slots = broad.value
        keys = slots[:, 0] * (1 << 44) + slots[:, 1]
        at = np.searchsorted(keys, length.to_numpy("i8") * (1 << 44) + rank.to_numpy("i8"), side="right") - 1
        got = slots[np.maximum(at, 0)] if len(slots) else np.zeros((len(at), 5), "i8")
        return pd.DataFrame({"sequence_id": got[:, 3] + rank.to_numpy("i8") - got[:, 1], "offset": got[:, 4]})

    found = ranked.withColumn("_at", look_up("length", "_rank"))
    return found.select(*(c for c in pieces.columns if c != "_row"), "_at.sequence_id", "_at.offset")


def pack(
    docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False, piece_tokens: int | None = None, **rules
) -> DataFrame:
    """Pieces of all documents with their sequence and place; with_ids adds the token ids of each piece.

    Documents over piece_tokens (max_tokens if not given) are cut. An attention capacity can bind only
    if pieces are shorter than sequences, as n tokens cost n * n at most.
    """
    folder = work_folder(docs.sparkSession)
    pieces = cut_documents(docs, tokenizer, piece_tokens or max_tokens, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id())
    pieces = materialize(pieces, folder, "pieces")
    return assign_sequences(pieces, max_tokens, **rules)
