"""Context assembly for many questions at once: search, one of equal contents, diversity, budget.

questions: (question_id, query, vector). Each scope is a table of chunks; a conversation's scope comes
first. Questions go to the scan of the chunks, a bounded number at a time; a task scores its chunks for
all of them and sends on the best of each, so that neither texts nor pairs are shuffled. All windows are
over one question's candidates, at most four times its top_k from each task or scope.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sediment.functions.text import chunk_label, token_estimate, tokens
from sediment.operators.chunking import compress
from sediment.operators.classify import with_parameters
from sediment.operators.lexical import B, K1, cut
from sediment.operators.select import mmr
from sediment.sources.work import stored

RRF_K = 60
#: Questions of one search, whose vectors and terms every task gets.
QUESTIONS = 2000
#: Chunks that a task scores at a time, and candidates that it holds before it keeps the best of each question.
CHUNKS, CANDIDATES = 200, 200_000


class _Best:
    """The best of each question among a task's chunks, by score and then by id, as Spark orders both."""

    def __init__(self, most: list[int], schema: T.StructType):
        self.most, self.floor, self.arrow = np.array(most, "i8"), np.full(len(most), -np.inf), to_arrow_schema(schema)
        self.held: list[pa.RecordBatch] = []
        self.count = 0

    def add(self, ids: pa.Array, at: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        able = ~(score < self.floor[q])  # NaN comes first
        if able.any():
            self.held.append(pa.RecordBatch.from_arrays([pa.array(q[able], pa.int32()), ids.take(pa.array(at[able])), pa.array(score[able])], schema=self.arrow))
            self.count += len(self.held[-1])
            if self.count > CANDIDATES:
                self.keep()

    def keep(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            whole = pa.concat_batches(self.held)
            q, ids, score = (c for c in whole.columns)
            q, score = q.to_numpy(), score.to_numpy()
            rank = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else pc.rank(ids, null_placement="at_start", tiebreaker="first").to_numpy()
            order = np.lexsort((rank, np.where(np.isnan(score), -np.inf, -score), q))
            q = q[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = (place == self.most[q] - 1) & ~np.isnan(score[order])
            self.floor[q[last]] = score[order][last]
            self.held = [whole.take(pa.array(order[place < self.most[q]]))]
            self.count = len(self.held[0])
        return iter(self.held)


def _dense_best(asked: list[tuple], schema: T.StructType) -> Callable:
    """(q, id, score) of the chunks whose cosine is at least the threshold; asked: (vector, most, threshold).

    Components are added one after another, so that equal vectors have equal scores wherever they stand.
    """
    by_size: dict[int, list[int]] = {}
    for n, (vector, _, _) in enumerate(asked):
        if vector is not None and None not in vector:
            by_size.setdefault(len(vector), []).append(n)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best([most for _, most, _ in asked], schema)
        sides = {size: (np.array(own), np.array([asked[n][0] for n in own], "f8"), np.array([asked[n][2] for n in own], "f8")) for size, own in by_size.items()}

        def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
            for x, y in zip(a, b, strict=True):
                out += x * y
            return out

        for whole in parts:
            for begin in range(0, whole.num_rows, CHUNKS):
                part = whole.slice(begin, CHUNKS)
                ids, vectors = part.columns
                sizes = pc.list_value_length(vectors).to_numpy()
                flat = vectors.flatten()
                missing = np.zeros(len(ids), bool)
                missing[np.repeat(np.arange(len(ids)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
                values, ends = flat.to_numpy(zero_copy_only=False).astype("f8"), np.cumsum(sizes)
                for size, (own, v, least) in sides.items():
                    rows = np.flatnonzero((sizes == size) & ~missing)
                    if not len(rows):
                        continue
                    x = values[(ends[rows] - size)[:, None] + np.arange(size)].T
                    with np.errstate(all="ignore"):
                        length = np.sqrt(dot(x, x))[:, None] * np.sqrt(dot(v.T, v.T))[None, :]
                        score = np.where(length == 0, 0.0, dot(x[:, :, None], v.T[:, None, :]) / length)
                    at, q = np.nonzero(~(score < least))
                    best.add(ids, rows[at], own[q], score[at, q])
        yield from best.keep()

    return run


def _term_counts(terms: list[str]) -> Callable:
    """(term, n, dl): chunks of a task that hold each term, by its place; -1 for all chunks and their lengths."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, total, known = np.zeros(len(terms), "i8"), 0, 0, pa.array(terms, pa.string())
        for part in parts:
            code = pc.index_in(part.column("terms").flatten(), known).drop_null().to_numpy()
            counts += np.bincount(code, minlength=len(terms))
            n, total = n + part.num_rows, total + (pc.sum(part.column("dl")).as_py() or 0)
        held = np.flatnonzero(counts)
        columns = [pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(counts[held], n)), pa.array(np.append(np.zeros(len(held), "i8"), total))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n", "dl"])

    return run


def _lexical_best(asked: list[tuple], terms: list[str], weights: list[float], avgdl: float, schema: T.StructType) -> Callable:
    """(q, id, score) by BM25; asked: (most, terms). Parts are added in the order of their terms, so that equal texts have equal scores."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, weight = _Best([most for most, _ in asked], schema), pa.array(terms, pa.string()), np.array(weights, "f8")
        place = {t: n for n, t in enumerate(terms)}
        pairs = sorted((place[t], q) for q, (_, own) in enumerate(asked) for t in own)
        by_term = np.array([q for _, q in pairs], "i8")
        many = np.bincount([t for t, _ in pairs], minlength=len(terms)) if pairs else np.zeros(len(terms), "i8")
        first = np.cumsum(many) - many
        for whole in parts:
            for begin in range(0, whole.num_rows, CHUNKS):
                part = whole.slice(begin, CHUNKS)
                code = pc.index_in(part.column("terms").flatten(), known)
                found = code.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("terms")).to_numpy())[found]
                code, tf = code.drop_null().to_numpy(), part.column("tfs").flatten().to_numpy()[found].astype("f8")
                if not len(code):
                    continue
                order = np.lexsort((code, row))
                row, code, tf = row[order], code[order], tf[order]
                share = weight[code] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column("dl").to_numpy()[row] / avgdl)))
                each = many[code]
                q = by_term[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first[code], each)]
                score = np.bincount(np.repeat(row, each) * len(asked) + q, np.repeat(share, each), part.num_rows * len(asked))
                at = np.flatnonzero(score)
                best.add(part.column(0), at // len(asked), at % len(asked), score[at])
        yield from best.keep()

    return run


def batch_hybrid(
    questions: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", vector_col: str = "embedding", toks: DataFrame | None = None
) -> DataFrame:
    """(question_id, chunk_id, score) for questions with top_k and threshold: both legs cut to 4 * top_k, fused, the best 1.0.

    A question none of whose terms occurs keeps its dense scores. Chunks without a vector are in no leg.
    The questions are counted first: more than QUESTIONS are asked in blocks, so that what is broadcast
    does not grow with them. The texts are cut once, for all blocks (toks, as lexical.cut gives them).
    """
    if toks is None:
        toks = stored(cut(chunks.where(F.size(vector_col) > 0), id_col, text_col), "cut")
    blocks = -(-questions.count() // QUESTIONS)
    if blocks > 1:
        dealt = questions.withColumn("_block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)))
        parts = [batch_hybrid(dealt.where(F.col("_block") == n).drop("_block"), chunks, id_col, text_col, vector_col, toks) for n in range(blocks)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    chunks = chunks.where(F.size(vector_col) > 0)
    asked = questions.where("not skip_retrieval").withColumn("terms", F.array_distinct(tokens(F.col("query"))))
    rows = asked.select("question_id", "vector", "top_k", "threshold", "terms").collect()  # QUESTIONS at most
    kind = T.StructType([questions.schema["question_id"], chunks.schema[id_col], T.StructField("score", T.DoubleType())])
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), id_col)

    def leg(found: DataFrame) -> DataFrame:
        """The best of the best of all tasks; found has the place of a question among the rows."""
        if not rows:
            return found.sparkSession.createDataFrame([], kind).withColumn("rank", F.lit(0))
        own = found.sparkSession.createDataFrame([(n, r["question_id"], 4 * r["top_k"]) for n, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), kind[0], T.StructField("most", T.IntegerType())]))
        ranked = found.join(F.broadcast(own), "q").withColumn("rank", F.row_number().over(best))
        return ranked.where("rank <= most").select("question_id", id_col, "score", "rank")

    # Texts stay where they are: each task scores its chunks for all questions and sends on the best of each.
    out = T.StructType([T.StructField("q", T.IntegerType()), *kind[1:]])
    dense = leg(chunks.select(id_col, vector_col).mapInArrow(_dense_best([(r["vector"], 4 * r["top_k"], r["threshold"]) for r in rows], out), out))
    terms = sorted({t for r in rows for t in r["terms"]})
    counts = toks.select("dl", "terms").mapInArrow(_term_counts(terms), "term int, n long, dl long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()
    held = {r["term"]: r for r in counts}
    n = held[-1]["n"] if held else 0
    weights = [math.log(1 + (n - held[t]["n"] + 0.5) / (held[t]["n"] + 0.5)) if t in held else 0.0 for t in range(len(terms))]
    avgdl = held[-1]["dl"] / n if n else 0.0
    asked_terms = [(4 * r["top_k"], list(r["terms"])) for r in rows]
    lex = leg(toks.select(F.col("id").alias(id_col), "dl", "terms", "tfs").mapInArrow(_lexical_best(asked_terms, terms, weights, avgdl, out), out))

    both = dense.withColumn("leg", F.lit("d")).unionByName(lex.withColumn("leg", F.lit("l")))
    fused = both.groupBy("question_id", id_col).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.max(F.when(F.col("leg") == "d", F.col("score"))).alias("dense"), F.max((F.col("leg") == "l").cast("int")).alias("lexical"))
    own = Window.partitionBy("question_id")
    score = F.when(F.max("lexical").over(own) == 1, F.col("rrf") / F.max("rrf").over(own)).otherwise(F.col("dense"))
    return fused.select("question_id", id_col, score.alias("score"))


def build_context(questions: DataFrame, scopes: list[DataFrame], budget: int = 8000) -> DataFrame:
    """(question_id, content, sources, tokens_estimate) for (question_id, query, vector) and scopes of chunks
    (chunk_id, file_name, page_number, start_line, end_line, content, embedding), the first preferred.

    A chunk that does not fit the budget is compressed to what bears on the question, and passed over
    if it still does not fit.
    """
    asked = with_parameters(questions)
    found = None
    for n, scope in enumerate(scopes):
        # Stored, so that Spark knows how few they are and scores are worked out once.
        hits = stored(batch_hybrid(asked, scope), "hits").join(scope, "chunk_id").withColumn("scope", F.lit(n))
        found = hits if found is None else found.unionByName(hits)
    first = Window.partitionBy("question_id", F.sha2("content", 256)).orderBy("scope", F.desc("score"), "chunk_id")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    found = stored(found, "found").join(F.broadcast(asked.select("question_id", "query", "top_k", "mmr_weight")), "question_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    many = F.count("*").over(Window.partitionBy("question_id"))
    found = found.withColumn("many", many).withColumn("position", F.row_number().over(order) - 1)
    few = found.where("many <= 2 * top_k").select("question_id", "chunk_id", "position")
    over = found.where("many > 2 * top_k")
    picked = mmr(over, "question_id", 24, "mmr_weight", "chunk_id").select("question_id", "chunk_id", "position").join(F.broadcast(asked.select("question_id", "top_k")), "question_id")
    picked = picked.where("position < 2 * top_k").drop("top_k")
    chosen = found.drop("position").join(few.unionByName(picked), ["question_id", "chunk_id"])
    chosen = chosen.withColumn("label", chunk_label(F.col("file_name"), F.col("page_number"), F.col("start_line"), F.col("end_line")))
    chosen = chosen.select("question_id", "query", "position", "chunk_id", "label", "content", "score", token_estimate(F.col("content")).alias("cost"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        used, kept, sources = 0, [], []
        for row in part.sort_values("position").itertuples():
            content, cost = row.content, row.cost
            if used + cost > budget:
                content = compress(content, row.query)
                cost = -(-2 * len(content) // 7)
            if used + cost > budget:
                continue
            used += int(cost)
            kept.append(f"[{row.label}]\n{content}")
            sources.append(row.chunk_id)
        return pd.DataFrame([{"question_id": part["question_id"].iloc[0], "content": "\n\n---\n\n".join(kept), "sources": sources, "tokens_estimate": used}])

    kind, source = chosen.schema["question_id"].dataType.simpleString(), chosen.schema["chunk_id"].dataType.simpleString()
    return chosen.groupBy("question_id").applyInPandas(pack, f"question_id {kind}, content string, sources array<{source}>, tokens_estimate int")


def with_fallback(context: DataFrame, chunks: DataFrame, budget: int, group: str = "question_id") -> DataFrame:
    """Chunks (group, chunk_id, chunk_index, content) of questions that context has no source for, in order while they fit."""
    missing = chunks.join(context.where(F.size("sources") > 0).select(group), group, "left_anti")
    running = F.sum(token_estimate(F.col("content"))).over(Window.partitionBy(group).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return missing.withColumn("used", running).where(F.col("used") <= budget).withColumn("score", F.lit(0.0)).withColumn("retrieval", F.lit("fallback"))


def fallback_files(files: DataFrame, budget: int, group: str, order: str) -> DataFrame:
    """Files (group, name, content) in order while they fit the budget of tokens, names and separators counted; the one that does not is cut, and ends it."""
    whole = F.concat(F.lit("--- "), "name", F.lit(" ---\n"), F.coalesce("content", F.lit("")))
    rows = files.withColumn("cost", token_estimate(whole) + 1)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begin", F.sum("cost").over(w) - F.col("cost")).where(F.col("begin") < budget)
    rows = rows.withColumn("cut", F.col("begin") + F.col("cost") > budget)
    left = F.floor((budget - F.col("begin")) * 3.5).cast("int")
    return rows.withColumn("content", F.when(F.col("cut"), F.substring(F.col("content"), F.lit(1), left)).otherwise(F.col("content"))).drop("begin")


def fit_budget(inputs: DataFrame, ceiling: str = "ceiling") -> DataFrame:
    """inputs (id, system, blocks array<string>, history array<struct<role, content>>, ceiling) cut to the ceiling: context
    blocks from the last, then the oldest messages, then the last message. The result always fits what it can keep."""
    def estimate(text: str | None) -> int:
        return -(-2 * len(text or "") // 7)

    def cut(text: str, room: int, mark: str = "\n\n[… cut]") -> str:
        if estimate(text) <= room:
            return text
        keep = max(0, room * 7 // 2 - len(mark))
        return text[:keep] + mark if keep else ""

    def fit(parts):
        for part in parts:
            rows = []
            for row in part.itertuples():
                blocks, history = list(row.blocks), [dict(m) for m in row.history]
                room = max(0, row.ceiling - estimate(row.system))
                total = sum(map(estimate, blocks)) + sum(estimate(m["content"]) + 4 for m in history)
                for n in range(len(blocks) - 1, -1, -1):
                    if total <= room:
                        break
                    before = estimate(blocks[n])
                    blocks[n] = cut(blocks[n], max(0, before - (total - room)))
                    total += estimate(blocks[n]) - before
                blocks = [b for b in blocks if b]
                while total > room and len(history) > 1:
                    total -= estimate(history.pop(0)["content"]) + 4
                if total > room and history:
                    before = estimate(history[-1]["content"])
                    history[-1]["content"] = cut(history[-1]["content"], max(0, before - (total - room)))
                    total += estimate(history[-1]["content"]) - before
                rows.append((row.id, blocks, history, total + estimate(row.system)))
            yield pd.DataFrame(rows, columns=["id", "blocks", "history", "tokens"])

    kind = inputs.schema["id"].dataType.simpleString()
    named = inputs.select("id", "system", "blocks", "history", F.col(ceiling).alias("ceiling"))
    return named.mapInPandas(fit, f"id {kind}, blocks array<string>, history array<struct<role:string,content:string>>, tokens int")
