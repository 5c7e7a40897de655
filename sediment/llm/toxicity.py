"""Toxicity: a linear-chain conditional random field tags toxic spans.

It learns from a bounded sample of the labelled documents (`fit_docs`, the ones whose ids have the
smallest hash), split in folds. Word counts give words a log odds of standing in a toxic document
(`most_words` words with the largest odds, of `least_docs` documents or more). A token of a toxic
document is labelled toxic if its word's odds in the other folds are `strong` or more; so no document
labels itself. The field has two states (clean, toxic). A token's features are its word, the
word's first and last bytes and the words on its left and right, all hashed; the weights and the
transitions are fitted on `fit_words` tokens, in segments of `SEGMENT` whose hash is smallest, taken from
whole texts by the tasks. Every whole text is then scored by forward-backward: the tokens' marginals give
the offending offsets, and their sum, their maximum and their share of the text give the document's score
through a logistic function fitted on the documents of the sample.

Defined results: a null or empty text scores as a text without words does, with no spans; a repeated
row gets the same score; texts of any length are read whole; a null id is scored like any other and
never learned from; other columns pass through (added names replace clashing ones); with no labels of
either kind every score is 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import materialize, plain_name, sliced, work_folder

WORD = re.compile(r"[^\W\d_]+")
#: Weights of words and of their first or last bytes; both are powers of two.
WORDS, ENDS = 1 << 16, 1 << 14
#: Bytes of a word's beginning and end, and tokens of a segment.
AFFIX, SEGMENT = 4, 256
#: Parts of the sample; each has its tokens labelled by the others.
FOLDS = 4
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass
class Field:
    """Weights of the fitted field, each the toxic state's less the clean state's; move is (2, 2)."""

    own: np.ndarray
    left: np.ndarray  # of the word on the left
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    move: np.ndarray
    score: np.ndarray  # logistic weights of a document


def empty_field() -> Field:
    return Field(*(np.zeros(WORDS) for _ in range(3)), *(np.zeros(ENDS) for _ in range(2)), np.zeros((2, 2)), np.array([-20.0, 0, 0, 0]))


def features_of(word: str) -> tuple[int, int, int]:
    """Numbers of the word, its beginning and its end."""
    b = word.encode()
    return zlib.crc32(b) & (WORDS - 1), zlib.crc32(b[:AFFIX]) & (ENDS - 1), zlib.crc32(b[-AFFIX:], 1) & (ENDS - 1)


class Lexicon(dict):
    """The features of words met by a worker, in columns; a word's value is its row."""

    def __init__(self):
        super().__init__()
        self.columns = [array("i") for _ in range(3)]

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        for column, value in zip(self.columns, features_of(word), strict=True):
            column.append(value)
        return at

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(3, tokens) features of all tokens of some texts, and the tokens of each."""
        if len(self) > 300_000:
            self.clear()
            self.columns = [array("i") for _ in range(3)]
        return self.read_words(map(words_of, texts))

    def read_words(self, found: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that are cut into words."""
        get, rows = self.__getitem__, [np.zeros(0, "i8")]
        for words in found:
            rows.append(np.fromiter(map(get, words), "i8", len(words)))
        at = np.concatenate(rows)
        return np.stack([np.frombuffer(c, "i4")[at] for c in self.columns]) if len(at) else np.zeros((3, 0), "i4"), np.array([len(r) for r in rows[1:]], "i8")


def places_of(text: str) -> list[tuple[int, int]]:
    """First and last offset of each word in the text as it stands: some capitals are two characters when lowered, and cut a word then."""
    return [h.span() for h in WORD.finditer(text)]


def words_of(text: str | None) -> list[str]:
    """The lowered words of a text, one for each of its places."""
    if not text:
        return []
    low = text.lower()
    # Equal lengths: every character was lowered to one, so that words stand where they stood.
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def neighbours(sizes: np.ndarray) -> np.ndarray:
    """The tokens that have one on their left in the same text."""
    inner = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    inner[starts[sizes > 0]] = False
    return np.flatnonzero(inner)


def _units(model: Field, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(tokens, 2) unary scores."""
    word, first, last = features
    out = np.zeros((len(word), 2))
    out[:, 1] = model.own[word] + model.first[first] + model.last[last]
    at = neighbours(sizes)
    out[at, 1] += model.left[word[at - 1]]
    out[at - 1, 1] += model.right[word[at]]
    return out


def marginals(units: np.ndarray, sizes: np.ndarray, move: np.ndarray, pairs: bool = False):
    """P(toxic) of each word by forward-backward, all texts in step; with pairs also the summed pair marginals.

    Only differences matter with two states, so one log ratio per word goes each way.
    """
    n, starts = len(units), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("i8")
    gap = units[:, 1] - units[:, 0]
    forward, back = np.zeros(n), np.zeros(n)
    order = np.argsort(-sizes, kind="stable")
    alive_sizes = -sizes[order]

    def pushed(ratio: np.ndarray, m: np.ndarray) -> np.ndarray:
        """log of (m[0,1] + m[1,1] e^r) / (m[0,0] + m[1,0] e^r)."""
        return np.logaddexp(m[0, 1], m[1, 1] + ratio) - np.logaddexp(m[0, 0], m[1, 0] + ratio)

    carry = None
    for t in range(int(sizes.max(initial=0))):
        at = starts[order[: int(np.searchsorted(alive_sizes, -t))]] + t
        into = gap[at] if carry is None else gap[at] + pushed(carry[: len(at)], move)
        forward[at] = carry = into
    carry = None
    turned = move.T
    for t in range(int(sizes.max(initial=0))):
        rows = order[: int(np.searchsorted(alive_sizes, -t))]
        at = starts[rows] + sizes[rows] - 1 - t
        if carry is None:
            into = np.zeros(len(at))
        else:
            into = pushed((carry + gap[last])[: len(at)], turned)
        back[at] = carry = into
        last = at
    p = 1 / (1 + np.exp(-np.clip(forward + back, -500, 500)))
    if not pairs:
        return p
    keep = np.ones(n, bool)
    keep[starts[sizes > 0]] = False
    here = np.flatnonzero(keep)
    a = forward[here - 1]
    b = gap[here] + back[here]
    logits = np.stack([np.full(len(here), move[0, 0]), move[0, 1] + b, move[1, 0] + a, move[1, 1] + a + b], axis=1)
    logits -= logits.max(axis=1, keepdims=True, initial=-np.inf) if len(here) else 0
    w = np.exp(logits)
    return p, (w / w.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bias, log of the expected toxic words, largest marginal and log share of each text."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(total[ends] - total[ends - sizes], 0)
    most = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        most[full] = np.maximum.reduceat(p, (ends - sizes)[full])
    return np.stack([np.ones(len(sizes)), np.log1p(expected), most, np.log(expected / np.maximum(sizes, 1) + 1e-3)], axis=1)


def word_odds(labelled: DataFrame, most_words: int, least_docs: int) -> list[dict[str, float]]:
    """For each fold, the log odds of words by the documents (text, toxic, fold) of the other folds.

    One row per word leaves each task; at most most_words words come to the driver, those with the
    largest odds over all folds.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    found = labelled.select("toxic", "fold", F.explode(words).alias("word")).where("word <> ''")
    counts = [F.count("*").alias("n"), F.sum("toxic").alias("t")]
    for k in range(FOLDS):
        counts += [F.count_if(F.col("fold") != k).alias(f"n{k}"), F.sum(F.when(F.col("fold") != k, F.col("toxic")).otherwise(0)).alias(f"t{k}")]
    total = labelled.agg(*counts).first()
    names = ["", *map(str, range(FOLDS))]
    if any(not total[f"t{k}"] or total[f"t{k}"] == total[f"n{k}"] for k in names):
        return []
    found = found.groupBy("word").agg(*counts)
    for k in names:
        t, n = F.col(f"t{k}"), F.col(f"n{k}")
        odds = F.log((t + 0.5) / (total[f"t{k}"] + 1) / ((n - t + 0.5) / (total[f"n{k}"] - total[f"t{k}"] + 1)))
        found = found.withColumn(f"o{k}", F.when(n >= least_docs, odds))
    rows = found.where("o >= 1").orderBy(F.desc("o"), "word").limit(most_words).collect()
    return [{r["word"]: r[f"o{k}"] for r in rows if r[f"o{k}"] is not None} for k in range(FOLDS)]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fit_docs: int, folder: str) -> DataFrame:
    """(doc_id, text, label, fold) of at most fit_docs labelled documents, stored; the sample of ids is small enough to broadcast."""
    ids = labels.where(f"doc_id is not null and {column} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    ids = ids.agg(F.max(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return materialize(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int")), folder, f"sample-{column}")


def tagged_segments(labelled: DataFrame, odds: list[dict[str, float]], strong: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, sizes) of the `most` segments of the sample whose hashes are smallest; texts stay with the tasks."""
    toxic_words = [frozenset(w for w, o in own.items() if o >= strong) for own in odds]
    broad = labelled.sparkSession.sparkContext.broadcast(toxic_words)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part in sliced(parts, 200):
            rows = []
            for doc, text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "toxic", "fold")), strict=True):
                strong_words, words = broad.value[fold], words_of(text)
                for at in range(0, len(words), SEGMENT):
                    own = words[at : at + SEGMENT]
                    tags = bytes(bool(toxic) and w in strong_words for w in own)
                    rows.append((doc, at, lexicon.read_words([own])[0].astype("<i4").tobytes(), tags))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "place", "features", "tags"])

    cuts = labelled.select("doc_id", "text", "toxic", "fold").mapInArrow(cut, "doc_id long, place long, features binary, tags binary")
    rows = cuts.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(most).select("features", "tags").collect()
    sizes = np.array([len(r["tags"]) for r in rows], "i8")
    features = [np.frombuffer(r["features"], "<i4").reshape(3, -1) for r in rows]
    tags = np.frombuffer(b"".join(bytes(r["tags"]) for r in rows), "u1") > 0
    return np.concatenate([np.zeros((3, 0), "i4"), *features], axis=1), tags, sizes


def fit(
    docs: DataFrame, labels: DataFrame, column: str = "toxic", most_words: int = 4000, least_docs: int = 3, strong: float = 2.0,
    fit_docs: int = 12_000, fit_words: int = 400_000, rounds: int = 60, ridge: float = 0.5,
) -> Field:
    """Fit on docs (doc_id, text) and labels (doc_id, column)."""
    labelled = labelled_sample(docs, labels, column, fit_docs, work_folder(docs.sparkSession)).withColumnRenamed("label", "toxic")
    odds = word_odds(labelled, most_words, least_docs)
    model = empty_field()
    if not odds:
        return model
    features, tag, sizes = tagged_segments(labelled, odds, strong, fit_words // SEGMENT + 1)
    fit_field(model, features, tag, sizes, rounds, ridge)
    scored = score_toxicity(labelled.select("doc_id", "text", "toxic"), model, spans=False, raw=True)
    rows = scored.orderBy("doc_id").select("toxic", "raw").collect()  # a few numbers of each document of the sample
    model.score = logistic(np.array([r["raw"] for r in rows]).reshape(-1, 4), np.array([r["toxic"] for r in rows], "f8"))
    return model


def fit_field(model: Field, features: np.ndarray, tag: np.ndarray, sizes: np.ndarray, rounds: int, ridge: float) -> None:
    """Maximise the likelihood of the tags: every weight takes its own damped Newton step at once, so steps are shared among a token's five features."""
    word, first, last = features
    at = neighbours(sizes)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[at - 1].astype(int), tag[at].astype(int)), 1.0)
    groups = [(model.own, word, slice(None)), (model.first, first, slice(None)), (model.last, last, slice(None)), (model.left, word[at - 1], at), (model.right, word[at], at - 1)]
    for _ in range(rounds):
        p, pair = marginals(_units(model, features, sizes), sizes, model.move, pairs=True)
        gap, bend = tag - p, p * (1 - p)
        for weights, number, of in groups:
            up = np.bincount(number, gap[of], len(weights)) - ridge * weights
            weights += up / (len(groups) * np.bincount(number, bend[of], len(weights)) + ridge + 1)
        model.move += (seen - pair - 1e-3 * model.move) / (len(groups) * np.maximum(pair, 1) + 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method, damped by a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) * 0.01 + 1e-6 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * len(y) * 0.01 * w)
    return w


def score_toxicity(docs: DataFrame, model: Field, text_col: str = "text", span_at: float = 0.5, spans: bool = True, raw: bool = False) -> DataFrame:
    """docs with score (0 to 1), toxic_words (expected number) and, if asked, toxic_spans (offsets in code points) and raw, what the score is made of."""
    added = ["score", "toxic_words", *(["toxic_spans"] if spans else []), *(["raw"] if raw else [])]
    base = plain_name(docs, added).withColumn(text_col, F.col(text_col).cast("string"))
    broad = docs.sparkSession.sparkContext.broadcast(model)

    def tag(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lexicon = broad.value, Lexicon()
        for part in sliced(parts, 1500):
            texts = part.column(text_col).to_pylist()
            features, sizes = lexicon.read(texts)
            starts = np.cumsum(sizes) - sizes
            p = marginals(_units(m, features, sizes), sizes, m.move)
            x = document_features(p, sizes)
            score = 1 / (1 + np.exp(-np.clip(x @ m.score, -30, 30)))
            out = part.append_column("score", pa.array(score)).append_column("toxic_words", pa.array(np.expm1(x[:, 1])))
            if spans:
                found: list[list[dict]] = [[] for _ in texts]
                hits = np.flatnonzero(p >= span_at)
                owner = np.searchsorted(np.cumsum(sizes), hits, side="right")
                for doc in np.unique(owner).tolist():
                    places = places_of(texts[doc])
                    for k in (hits[owner == doc] - starts[doc]).tolist():
                        found[doc].append({"start": places[k][0], "end": places[k][1]})
                out = out.append_column("toxic_spans", pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            if raw:
                out = out.append_column("raw", pa.array(x.tolist(), pa.list_(pa.float64())))
            yield out

    fields = [*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_words", T.DoubleType())]
    more = ([T.StructField("toxic_spans", SPAN)] if spans else []) + ([T.StructField("raw", T.ArrayType(T.DoubleType()))] if raw else [])
    return base.mapInArrow(tag, T.StructType(fields + more))
