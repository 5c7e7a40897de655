"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct word shingles. All tokens have one order: tokens that many
documents hold come last, by their estimated number of documents; the others come first, by hash.
Of a document with n tokens that must share t of them, the first n - t + l tokens hold at least l of
the shared ones. l is chosen for each document by estimated cost: the rows that a longer prefix adds
against the candidates that its tokens bring, divided by the l matches that are then required.

1. Documents with equal sets are one class; the smallest id stands for it.
2. Prefix tokens that no other class has in its prefix are dropped. A class left with none has no
   partner. (Of l shared tokens in one prefix, those beyond the end of the partner's do not count: of
   the two prefixes, only the one that ends first holds its l in both.)
3. Every token's classes are compared with one pivot, the class with the fewest lone tokens. A pair
   must share so many prefix tokens that, with all that lies beyond the prefixes, it could reach the
   similarity; it is then verified on the whole sets, and links are united. In a large group of near
   copies nearly all classes meet the pivot, so their pairs need not be listed.
   The tokens of a class that can matter are few: a pair must share so many that it shares one among
   each class's rarest, and the others are left out.
4. Classes of different components are then compared wherever sizes and shared tokens allow, over the
   tokens that several components have. Under one token these pairs grow with the square of the
   classes that hold it among their rarest, are of sizes that may match and have tokens enough left,
   but were not united by any pivot: texts that share rare words and yet are not near copies.
5. Links of both rounds are united. No pair is dropped: those not looked at are in one component already.

Defined results: a document without words has no tokens and links with nothing; a null id gets a null
component; texts of any length are read whole; a similarity equal to the threshold links; columns of
docs other than id and text are not returned; repeated rows are members of the same class and each gets its row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import connected_components, forget, free_name, materialize, sliced, work_folder

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows of the table of frequent tokens that every task gets: the most frequent ones, ordered by documents. The table
#: only orders tokens and estimates costs; whatever it leaves out, pairs are found all the same.
FREQUENT = 50_000
#: Ids that may be broadcast to pick the texts of candidates.
BROADCAST_IDS = 2_000_000
MATCHES = (1, 2, 3, 4, 6, 8)


class _Words(dict):
    """Hashes of words, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than size are one shingle."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_WORDS.__getitem__, words), "u8", len(words))
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, "u8")
    for k in range(span):
        out = (out ^ h[k : len(h) - span + 1 + k]) * _STEP
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))


def frequent_tokens(docs: DataFrame, size: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, sorted, that a block of documents holds `least` times or more, with the documents counted there.

    The counts only order the tokens and estimate costs. The FREQUENT largest come to the driver.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4000):
                sets = [shingle_set(x.as_py(), size) for x in part.column("text").slice(at, 4000)]
                got, n = np.unique(np.concatenate([np.zeros(0, "u8"), *sets]), return_counts=True)
                keep = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(got[keep].view("i8")), pa.array(n[keep].astype("i8"))], names=["token", "n"])

    counted = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token, n = rows["token"].to_numpy("i8").view("u8"), rows["n"].to_numpy("i8")
    order = np.argsort(token)
    return token[order], n[order]


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that any partner of a set of n must share with it."""
    return -(-num * n // den)


def choose_prefix(n: int, weights: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(l, prefix length): weights are the estimated documents of each token in order, zero for rare ones."""
    short = n - least_overlap(n, num, den)
    total = np.cumsum(weights[: short + MATCHES[-1]] + 0.05)
    best = min(
        ((total[short + l - 1] / l + 0.5 * (short + l), l) for l in MATCHES if short + l <= n and l <= n - short),
        default=(0, 1),
    )[1]
    return best, short + best


def prefixes(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc, n, s1, s2, need, rare, often): set size, set digest, l, and the prefix split into rare and frequent tokens."""
    broad = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, size))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = broad.value
        for part in sliced(parts):
            rows = []
            for text in part.column("text").to_pylist():
                own = shingle_set(text, size)
                n = len(own)
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "i8")
                need, rare, often = 0, own[:0], own[:0]
                if n:
                    at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
                    weight = np.where(token[at] == own, count[at], 0) if len(token) else np.zeros(n, "i8")
                    order = np.argsort(weight, kind="stable")
                    need, p = choose_prefix(n, weight[order], num, den)
                    first = order[:p]
                    rare, often = own[first[weight[first] == 0]], own[first[weight[first] > 0]]
                rows.append((n, int(digest[0]), int(digest[1]), need, rare.view("i8"), often.view("i8")))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [part.column("doc"), *(pa.array(c, pa.int64()) for c in cols[:4])]
            for col in cols[4:]:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in col])]).astype("i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *col]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "s1", "s2", "need", "rare", "often"])

    return docs.mapInArrow(cut, "doc long, n long, s1 long, s2 long, need long, rare array<long>, often array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the similarity; sets has (rep, tokens)."""
    left = pairs.join(sets.select(F.col("rep").alias("u"), F.col("tokens").alias("a")), "u")
    both = left.join(sets.select(F.col("rep").alias("v"), F.col("tokens").alias("b")), "v").select("u", "v", "a", "b")

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts, 500):
            keep = []
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                common = int((a[at] == b).sum())
                keep.append(den * common >= num * (len(a) + len(b) - common))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "u long, v long")


def class_sets(texts: DataFrame, pairs: DataFrame, size: int, folder: str, name: str) -> DataFrame:
    """(rep, tokens): the whole sets of the classes of some pairs, stored."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    wanted = materialize(wanted, folder, f"{name}-ids")
    if wanted.count() <= BROADCAST_IDS:  # 8 bytes each; more than that meet the texts in a shuffle
        wanted = F.broadcast(wanted)

    def as_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            sets = [shingle_set(x, size).tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sets, pa.binary())], names=["rep", "tokens"])

    sets = texts.join(wanted, "doc", "left_semi").mapInArrow(as_sets, "rep long, tokens binary")
    return materialize(sets.where("length(tokens) > 0"), folder, name)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs; similarity is num / den or more."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    table = materialize(prefixes(texts, size, num, den), folder, "prefixes")
    classes = table.where("n > 0 and doc is not null").groupBy("s1", "s2", "n", "need").agg(F.min("doc").alias("rep"))
    classes = materialize(classes, folder, "classes")
    held = table.select(F.col("doc").alias("rep"), "rare", "often").join(classes.select("rep"), "rep", "left_semi")

    # Prefix tokens that at least two classes have. A rare token is in few of them, so its rows can meet;
    # a frequent one is known to be shared.
    rare = held.select(F.explode("rare").alias("token"), "rep")
    rare = rare.withColumn("k", F.count("*").over(Window.partitionBy("token"))).where("k > 1").drop("k")
    matched = rare.unionByName(held.select(F.explode("often").alias("token"), "rep"))
    matched = materialize(matched, folder, "matched")
    slim = classes.select("rep", "n", (F.col("n") - F.ceil(F.col("n") * num / den) + F.col("need")).alias("p"))
    shares = matched.groupBy("rep").agg(F.count("*").alias("v")).join(slim, "rep")

    # Partners have from `low` to `most` tokens. Beyond the prefix that ends first lies at most the larger of both n - p.
    # So a class of which a partner can hold v prefix tokens has none between near(v), where its own rest counts, and
    # far(v), where the larger partner's, under m * num / den of m tokens, does.
    low, most = F.ceil(F.col("n") * num / den), F.floor(F.col("n") * den / num)

    def near(v: Column) -> Column:
        return F.least(most, F.floor((v + F.col("n") - F.col("p")) * (den / num + 1) + 1e-6) - F.col("n"))

    def far(v: Column) -> Column:
        return F.floor((F.col("n") * (num / (num + den)) - v) / (num / den - num / (num + den)) - 1e-6)

    posts = materialize(matched.join(shares, "rep"), folder, "posts")
    forget(spark, folder, "matched")

    def pruned(posts: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
        """The posts (token, rep, n, p, v) of some tokens (token, k, g, smallest), with `left`, the tokens of the class after this one.

        A pair shares at least `least` of these tokens, so it shares one among each class's v - least + 1 rarest.
        """
        own = Window.partitionBy("rep")
        out = posts.join(tokens, "token").withColumns(
            {"w": F.count("*").over(own), "g": F.max("g").over(own), "smallest": F.min("smallest").over(own), "at": F.row_number().over(own.orderBy("k", "token"))}
        )
        least = F.ceil((F.col("n") + F.greatest(low, F.col("smallest"))) * num / (num + den)) - F.greatest(F.col("n") - F.col("p"), F.col("g"))
        out = out.where(F.col("at") <= F.col("w") - F.greatest(least, F.lit(1)) + 1)
        kept = [c for c in posts.columns if c != "token"]
        return materialize(out.select("token", *kept, (F.col("w") - F.col("at")).alias("left")), folder, name)

    of_token = [F.count("*").alias("k"), F.max(F.col("n") - F.col("p")).alias("g"), F.min("n").alias("smallest")]
    usable = posts.groupBy("token").agg(*of_token).where("k > 1")
    posts = materialize(posts.join(usable.select("token"), "token", "left_semi"), folder, "usable")
    held = materialize(posts.groupBy("rep").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n"), F.first("p").alias("p")), folder, "held")

    # Round 1: each token's classes against its pivot, one that can have a partner of its own size if there is any.
    first = pruned(posts, usable, "first")
    forget(spark, folder, "posts")
    best = F.min(F.struct((near(F.col("v")) < F.col("n")).alias("weak"), (F.col("p") - F.col("v")).alias("lone"), "rep", "n", "p", "v"))
    pivots = first.groupBy("token").agg(best.alias("pivot"), F.count("*").alias("k")).where("k > 1")
    pairs = first.select("token", "rep", "n", "p", "v", low.alias("low"), most.alias("most")).join(pivots.select("token", "pivot"), "token")
    fit = F.least("v", "pivot.v") + F.greatest(F.col("n") - F.col("p"), F.col("pivot.n") - F.col("pivot.p")) >= F.ceil((F.col("n") + F.col("pivot.n")) * num / (num + den))
    pairs = pairs.where("rep <> pivot.rep and pivot.n between low and most").where(fit)
    pairs = pairs.select(F.least("rep", "pivot.rep").alias("u"), F.greatest("rep", "pivot.rep").alias("v")).distinct()

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs that share enough prefix tokens: all that they can share beyond the prefixes is the larger n - p."""
        for side in ("u", "v"):
            pairs = pairs.join(held.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("tokens", "n", "p"))), side)
        common = F.size(F.array_intersect("tokens_u", "tokens_v")) + F.greatest(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v"))
        return pairs.where(common >= F.ceil((F.col("n_u") + F.col("n_v")) * num / (num + den))).select("u", "v")

    pairs = materialize(plausible(pairs), folder, "pairs")
    forget(spark, folder, "first")
    sets = class_sets(texts, pairs, size, folder, "sets")
    links = materialize(verified(pairs, sets, num, den), folder, "links")
    united = materialize(connected_components(links, f"{folder}/one"), folder, "united")
    forget(spark, folder, "sets", "one")

    # Round 2: pairs of different components; they can share only tokens that several components have.
    label = united.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    labelled = materialize(posts.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), folder, "labelled")
    mixed = labelled.groupBy("token").agg(*of_token, F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    second = pruned(labelled, mixed.select("token", "k", "g", "smallest"), "second")

    def band(c: Column) -> Column:
        return F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) * 64)

    # The smaller class of each pair looks for larger ones of up to `most` tokens, in the bands that the tokens left allow.
    rest, ahead = F.col("n") - F.col("p"), F.col("left") + 1
    bands = F.filter(F.sequence(band(F.col("n")), band(most)), lambda b: (b <= band(near(ahead))) | (b >= band(far(ahead))))
    one = second.select("token", F.col("rep").alias("x"), F.col("n").alias("xn"), most.alias("xmost"), rest.alias("xrest"), F.col("left").alias("xleft"), F.col("comp").alias("xc"), F.explode(bands).alias("band"))
    two = second.select("token", F.col("rep").alias("y"), F.col("n").alias("yn"), rest.alias("yrest"), F.col("left").alias("yleft"), F.col("comp").alias("yc"), band(F.col("n")).alias("band"))
    # At the first token that a pair shares, enough tokens must be left on both sides.
    enough = F.least("xleft", "yleft") + 1 + F.greatest("xrest", "yrest") >= F.ceil((F.col("xn") + F.col("yn")) * num / (num + den))
    met = one.join(two, ["token", "band"]).where(enough).where("xc <> yc and yn between xn and xmost")
    met = met.where("xn < yn or x < y")  # two classes of one size meet once
    met = met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    met = materialize(met, folder, "met-all")
    forget(spark, folder, "usable", "labelled", "second")
    met = materialize(plausible(met).join(pairs, ["u", "v"], "left_anti"), folder, "met")
    sets = class_sets(texts, met, size, folder, "more-sets")
    links = links.unionByName(verified(met, sets, num, den))
    united = connected_components(links, f"{folder}/two")

    members = classes.select("s1", "s2", "n", "rep").join(united.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = members.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = table.select("doc", "n", "s1", "s2").join(members, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less all documents but the one with the smallest id of each component; rows with a null id stay."""
    found, name = jaccard_components(docs, size, num, den, id_col, text_col), free_name(docs, "_gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
