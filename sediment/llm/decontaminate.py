"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark. Every text of the corpus is read once into term numbers, which
are stored; all later passes read those. Document frequencies are counted over all passages of the
corpus. A distributed randomised SVD of the TF-IDF passages (each task sums its share of A'A times a
random matrix; the sums have one row per benchmark term) gives the latent space. Passages of all
texts, in overlapping windows of two lengths, are compared with all items by cosine in it; a passage
over the threshold that also holds a fair part of the item's latent mass is a candidate. Items longer
than a window are also compared piece by piece, in overlapping pieces of one window. Terms that very
many passages hold are left out of the space, unless they are among a piece's rarest. Around a candidate the longest common subsequence of words with
the item is taken, and the share of the item's rarest words ("answer") that stand there. A long
common subsequence, or a fair one with the answer, is a match, so that light paraphrases are caught.

Defined results: null and empty texts match nothing; items without words are left out; rows with a
null id give no matches and are never dropped; repeated rows match alike and give one match, as
do equal places of a text (the first); a cosine or share equal to its threshold counts; texts and items
of any length are read whole; other columns of docs pass through drop_contaminated; with an empty corpus
or benchmark there are no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import free_name, materialize, sliced, work_folder

WORD = re.compile(r"[^\W_]+")
STEP = 10  # words between two passages
WINDOWS = (2, 4)  # passage lengths in steps
PIECE = WINDOWS[-1] * STEP  # words of a piece of an item
CELLS = 16_000_000  # cosines held at once
MATCH = "doc_id long, item_id long, first_word long, cosine double, common double, answer double"


@dataclass
class Settings:
    rank: int = 64
    cosine: float = 0.5
    contained: float = 0.35  # of a piece's latent mass, in a passage
    common_term: float = 0.002  # of the passages; more common terms are left out of the space
    common: float = 0.75  # of an item's words, in order
    common_with_answer: float = 0.6
    answer: float = 0.75
    answer_words: int = 6
    block_items: int = 20_000  # items, or pieces of longer ones, of one scan


@dataclass
class Items:
    """Items as term numbers, with what verification needs."""

    ids: list[int]
    terms: dict[str, int]
    words: list[np.ndarray]
    masks: list[dict[int, int]] = field(default_factory=list)
    answers: list[frozenset] = field(default_factory=list)


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    kept = [(i, WORD.findall(t.lower())) for i, t in rows if i is not None and t]
    kept = sorted((i, w) for i, w in kept if w)
    terms = {w: n for n, w in enumerate(sorted({w for _, own in kept for w in own}))}
    words = [np.array([terms[w] for w in own], "i4") for _, own in kept]
    masks = []
    for own in words:
        mask: dict[int, int] = {}
        for n, w in enumerate(own.tolist()):
            mask[w] = mask.get(w, 0) | 1 << n
        masks.append(mask)
    return Items([i for i, _ in kept], terms, words, masks)


def pieces_of(length: int) -> list[tuple[int, int]]:
    """(begin, end) of the whole item and, if it is longer than a window, of overlapping pieces of one window."""
    begins = [*range(0, length - PIECE, PIECE // 2), length - PIECE] if length > PIECE else []
    return [(0, length), *((b, b + PIECE) for b in begins)]


def common_words(mask: dict[int, int], length: int, region: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit in one integer."""
    full = (1 << length) - 1
    state = full
    for w in region:
        if hit := mask.get(w):
            both = state & hit
            state = ((state + both) | (state - both)) & full
    return length - state.bit_count()


def first_match(item: list[int], region: list[int], common: int) -> int:
    """Where the latest longest common subsequence of item and region begins in region, read from its end."""
    mask: dict[int, int] = {}
    for n, w in enumerate(reversed(item)):
        mask[w] = mask.get(w, 0) | 1 << n
    full = state = (1 << len(item)) - 1
    for at in range(len(region) - 1, -1, -1):
        if hit := mask.get(region[at]):
            both = state & hit
            state = ((state + both) | (state - both)) & full
            if len(item) - state.bit_count() == common:
                return at
    return 0


class _Chunks(dict):
    """The term numbers of white-space-separated chunks, kept while there are few enough."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        get = self.terms.get
        self[chunk] = got = np.array([get(w, -1) for w in WORD.findall(chunk.lower())], "i4").tobytes()
        return got


def term_numbers(docs: DataFrame, terms: dict[str, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, words): the term number of every word as int32, -1 for other words."""
    broad = docs.sparkSession.sparkContext.broadcast(terms)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Chunks(broad.value).__getitem__
        for part in sliced(parts):
            out = [b"".join(map(of, t.split())) if t else b"" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(number, "doc_id long, words binary")


def _stepped(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts, the text of each step, and the step of each word. Steps do not cross texts."""
    own = [np.frombuffer(x, "i4") for x in part]
    sizes = np.array([len(x) for x in own], "i8")
    steps = -(-sizes // STEP)
    words = np.concatenate([np.zeros(0, "i4"), *own])
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return words, np.repeat(np.arange(len(part)), steps), np.repeat(np.cumsum(steps) - steps, sizes) + place // STEP


def passage_counts(numbered: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """(passages that hold each term, passages) over the whole corpus; at most n_terms + 1 rows reach the driver."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, "i8")
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                words, owner, step = _stepped(whole.column("words").slice(at, 500).to_pylist())
                hit = np.flatnonzero(words >= 0)
                key = np.sort((step[hit] // WINDOWS[1]) * n_terms + words[hit])
                first = key[np.flatnonzero(np.diff(key, prepend=-1))]
                total[:n_terms] += np.bincount(first % n_terms, minlength=n_terms)
                total[n_terms] += -(-len(owner) // WINDOWS[1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], names=["term", "n"])

    rows = numbered.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms + 1, "i8")
    out[rows["term"].to_numpy("i8")] = rows["n"].to_numpy("i8")
    return out[:n_terms], int(out[n_terms])


def latent_space(numbered: DataFrame, idf: np.ndarray, items: Items, rank: int, passages: int) -> np.ndarray:
    """(terms, rank): right singular vectors of the corpus's and the items' TF-IDF passages.

    One pass: G = A'A W for a random W, then the eigenvectors of G (W'G)^-1 G'.
    """
    n_terms, wide = len(idf), rank + 8
    weight = np.random.default_rng(11).standard_normal((n_terms, wide)).astype("f4")
    broad = numbered.sparkSession.sparkContext.broadcast((idf.astype("f4"), weight))

    def sketch(words: np.ndarray, passage: np.ndarray, total: np.ndarray, idf: np.ndarray, weight: np.ndarray) -> None:
        hit = np.flatnonzero((words >= 0) & (idf[words] > 0))
        if not len(hit):
            return
        w, (_, p) = words[hit], np.unique(passage[hit], return_inverse=True)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        y = np.add.reduceat(weight[w] * idf[w, None], starts, axis=0)
        norm = np.bincount(p, (idf[w] ** 2).astype("f8"))
        y /= np.maximum(norm, 1e-9)[:, None]
        value = idf[w].astype("f8")
        for k in range(y.shape[1]):
            total[:, k] += np.bincount(w, value * y[p, k], minlength=len(total))

    def share(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weight = broad.value
        total = np.zeros(weight.shape)
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                words, _, step = _stepped(part.column("words").slice(at, 1000).to_pylist())
                sketch(words, step // WINDOWS[1], total, idf, weight)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="i4")), *(pa.array(c) for c in total.T)], names=["term", *names])

    names = [f"c{k}" for k in range(wide)]
    shares = numbered.select("words").mapInArrow(share, "term int, " + ", ".join(f"{c} double" for c in names))
    rows = shares.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # a row per benchmark term
    total = np.zeros((n_terms, wide))
    if len(rows):
        total[rows["term"].to_numpy("i8")] = rows[names].to_numpy("f8")
    sizes = np.array([len(w) for w in items.words])
    own = np.zeros_like(total)  # together, the items weigh as much as the corpus
    sketch(np.concatenate(items.words), np.repeat(np.arange(len(sizes)), sizes), own, idf.astype("f4"), weight)
    total += own * max(1.0, passages / len(sizes))
    core = weight.T.astype("f8") @ total
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(initial=0), 1e-12)
    half = total @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank].astype("f4")


def find_matches(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, common, answer): the best passage of each document and item that match.

    first_word counts the document's words up to the first of the longest common subsequence.

    The benchmark is read in blocks of block_items pieces; the corpus is searched once for each block.
    """
    s, folder = settings or Settings(), work_folder(docs.sparkSession)
    rows = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()]
    rows = sorted({r for r in rows if r[0] is not None and r[1]})
    blocks, room = [], 0
    for row in rows:
        pieces = len(pieces_of(len(WORD.findall(row[1].lower()))))
        if not blocks or pieces > room:
            blocks.append([])
            room = s.block_items
        blocks[-1].append(row)
        room -= pieces
    out = docs.sparkSession.createDataFrame([], MATCH)
    for n, block in enumerate(blocks):
        found = _search(docs, read_items(block), s, f"{folder}/{n}")
        out = found if n == 0 else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: Items, s: Settings, folder: str) -> DataFrame:
    if not items.ids:
        return docs.sparkSession.createDataFrame([], MATCH)
    numbered = materialize(term_numbers(docs.where("doc_id is not null"), items.terms), folder, "numbered")
    held, passages = passage_counts(numbered, len(items.terms))
    idf = np.log((passages + 1) / (held + 1)) + 0.1
    # An item's answer: its rarest words. Those of each piece are kept, too, so that every piece can be found.
    live = held <= s.common_term * passages
    pieces, item_of = [], []
    for i, own in enumerate(items.words):
        for begin, end in pieces_of(len(own)):
            rarest = sorted(set(own[begin:end].tolist()), key=lambda w: (-idf[w], w))[: s.answer_words]
            if begin == 0 and end == len(own):
                items.answers.append(frozenset(rarest))
            live[rarest] = True
            pieces.append(own[begin:end])
            item_of.append(i)
    idf = np.where(live, idf, 0)
    space = latent_space(numbered, idf, items, s.rank, passages)
    by_term = (space * idf[:, None]).astype("f4")
    targets = np.stack([by_term[w].sum(axis=0) for w in pieces])
    broad = docs.sparkSession.sparkContext.broadcast((items, by_term, live, targets, np.array(item_of)))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_term, live, targets, item_of = broad.value
        live = np.append(live, False)  # the last: other words
        for whole in parts:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                texts = part.column("words").to_pylist()
                words, owner, step = _stepped(texts)
                found: dict[tuple, tuple] = {}
                hit = np.flatnonzero(live[words])
                if len(hit):
                    begins = np.flatnonzero(np.diff(step[hit], prepend=-1))
                    sums, inside = np.zeros((len(owner), by_term.shape[1]), "f4"), np.zeros(len(owner), "i4")
                    sums[step[hit][begins]] = np.add.reduceat(by_term[words[hit]], begins, axis=0)
                    inside[step[hit][begins]] = np.diff(np.append(begins, len(hit)))
                    _verify(found, texts, sums, inside, owner, items, targets, item_of, s)
                docs_at = part.column("doc_id").to_pylist()
                rows = [(docs_at[d], items.ids[i], *v) for (d, i), v in sorted(found.items())]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])

    found = numbered.mapInArrow(search, MATCH)
    best = F.max_by(F.struct("first_word", "cosine", "common", "answer"), F.struct("common", "answer", "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _verify(found: dict, texts: list[bytes], sums: np.ndarray, inside: np.ndarray, owner: np.ndarray, items: Items, targets: np.ndarray, item_of: np.ndarray, s: Settings) -> None:
    """Candidate passages by cosine with a piece, then common subsequence with its whole item and answer; the best place of each (text, item) goes to found."""
    first_step = np.searchsorted(owner, np.arange(len(texts)))
    looked: set[tuple[int, int, int]] = set()
    size = np.maximum(np.linalg.norm(targets, axis=1), 1e-9)
    towards = (targets / size[:, None]).T
    least = min(4, *(len(a) for a in items.answers))  # words of the space that stand in any item
    words_of: dict[int, np.ndarray] = {}
    for wide in WINDOWS:
        x, n = sums.copy(), inside.copy()
        for k in range(1, wide):
            if len(x) > k:
                same = (owner[k:] == owner[:-k])[:, None]
                x[:-k] += np.where(same, sums[k:], 0)
                n[:-k] += np.where(same[:, 0], inside[k:], 0)
        use = np.flatnonzero(n >= least)
        most = min(20_000, max(1, CELLS // len(targets)))
        for at in range(0, len(use), most):
            own = use[at : at + most]
            along = x[own] @ towards
            cos = along / np.maximum(np.linalg.norm(x[own], axis=1, keepdims=True), 1e-9)
            for r, piece in zip(*np.nonzero((cos >= s.cosine) & (along >= s.contained * size)), strict=True):
                step, i = int(own[r]), int(item_of[piece])
                d, length = int(owner[step]), len(items.words[i])
                pair = (step - int(first_step[d])) // 2 * 2  # one region for two steps, wide enough for the widest window of both
                if (d, i, pair) in looked:
                    continue
                looked.add((d, i, pair))
                if d not in words_of:
                    words_of[d] = np.frombuffer(texts[d], "i4")
                begin = max(0, pair * STEP - length - STEP)
                region = words_of[d][begin : (pair + WINDOWS[-1] + 2) * STEP + length]
                known = np.flatnonzero(region >= 0)
                near = region[known].tolist()
                mask = items.masks[i]
                if sum(w in mask for w in near) < s.common_with_answer * length:
                    continue
                common = common_words(mask, length, near) / length
                if common < s.common_with_answer:
                    continue
                answer = len(items.answers[i].intersection(near)) / len(items.answers[i])
                if common >= s.common or answer >= s.answer:
                    near_cos = float(cos[r, piece])
                    if (d, i) not in found or (common, answer, near_cos) > (found[d, i][2], found[d, i][3], found[d, i][1]):
                        place = first_match(items.words[i].tolist(), near, round(common * length))
                        found[d, i] = (begin + int(known[place]), near_cos, common, answer)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs less those that match an item; rows with a null id stay."""
    name = free_name(docs, "_gone")
    gone = find_matches(docs, benchmark, settings).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
