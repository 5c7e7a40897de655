"""Source divergence audit: how far the sources of a language use its terms apart.

A term's counts stand in one wide vector, an array with a place for each source of the language:

1. Texts are cut into terms once; the sorted array of a text tells a term's first place in it, so that
   one aggregate, combined before its shuffle, gives the counts and the documents of (language, source, term).
2. Each (language, term) with enough documents is pivoted into its vector of counts. The vectors are
   stored: they are many times smaller than the texts.
3. Sums over the vectors give each source's total; with it every count becomes a smoothed share in
   billionths, exactly, in whole numbers.
4. Higher-order functions give the contribution of each term to each pair of sources; the sums over
   terms are combined in each task before they are shuffled, so a task sends one number for a pair.
   Contributions of one source at a time are held, never those of all pairs.

The number of pairs grows with the square of the sources of one language, as the result does. Counts
stay exact up to 9 * 10^15, which is the bound of long arithmetic here; beyond it Spark raises an error.

Defined results: null language, source and text are empty strings, and count as such; a source without
terms has count 0 for each; a language without kept terms has pairs of value 0 and no terms; ties go by
the item's bytes; repeated rows are documents of their own; a language with one source has no pairs; other
columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import materialize, work_folder

#: All that is no letter: ASCII other than A-Z and a-z.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION_DIGITS = 3  # steps of a thousand each


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """floor(10^9 * count / total) in whole numbers, three digits at a time, so that nothing exceeds 1000 * total."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(BILLION_DIGITS):
        whole, rest = whole * 1000 + _div(rest * 1000, total), (rest * 1000) % total
    return whole


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of docs (lang, source, text): occurrences, and documents that hold the term."""
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    cut = docs.select("lang", "source", F.sort_array(F.split(text, BETWEEN)).alias("sorted"))
    # The outer form: the other one makes Spark work out the array a second time, as a filter.
    each = cut.select("lang", "source", "sorted", F.posexplode_outer("sorted").alias("at", "term")).where("term <> ''")
    first = F.coalesce(F.get("sorted", F.col("at") - 1) != F.col("term"), F.lit(True))
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("count"), F.count_if(first).alias("docs"))


def wide_vectors(docs: DataFrame, langs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, counts): counts has a place for each of the language's sources."""
    terms = term_counts(docs).groupBy("lang", "term")
    terms = terms.agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("parts"))
    kept = terms.where(F.col("docs") >= least_docs).withColumn("by_source", F.map_from_entries("parts"))
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0).cast("long")))
    return kept.join(langs, "lang").select("lang", "term", "total", counts.alias("counts"))


def totals(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, sources, sizes, size): what counts of each source, and of the whole language, are divided by."""
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    one = vectors.select("lang", F.posexplode_outer("counts").alias("at", "c")).groupBy("lang", "at").agg(F.sum("c").alias("c"))
    each = one.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("ns"))
    sizes = F.transform("ns", lambda n: n + 2 * F.col("v")).alias("sizes")
    return langs.join(kept.join(each, "lang"), "lang", "left").select("lang", "sources", sizes, (F.col("n") + 2 * F.col("v")).alias("size"))


def _pairs(shares: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    at = shares.where("size(p) > 1").select("lang", "p", F.posexplode_outer("p").alias("i", "own"))
    rest = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q: contribution(F.col("own"), q))
    each = at.select("lang", "i", F.posexplode_outer(rest).alias("k", "f")).where("f is not null")
    sums = each.groupBy("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j")).agg(F.sum("f").alias("value"))
    one = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
    two = one.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i < j")
    both = two.join(sums, ["lang", "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return both.select("lang", "value", F.explode(ways).alias("x")).select("lang", "x.source", "x.item", "value")


def _terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source holds more of than its language."""
    each = shares.select("lang", "term", "q", "counts", "p", F.posexplode_outer("sources").alias("i", "source"))
    each = each.select("lang", "source", F.col("term").alias("item"), "q", F.get("counts", "i").alias("c"), F.get("p", "i").alias("p"))
    return each.where("c > 0 and p > q").select("lang", "source", "item", contribution(F.col("p"), F.col("q")).alias("value"))


def source_divergence(
    docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by their
    distance, part `term` the `top` terms that set the source apart from its language."""
    folder = work_folder(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*named)
    langs = docs.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    langs = materialize(langs, folder, "langs")
    vectors = materialize(wide_vectors(docs, langs, least_docs), folder, "vectors")
    sums = materialize(totals(vectors, langs), folder, "totals")
    p = F.zip_with("counts", "sizes", lambda c, n: share(c + 2, n) + 1)
    shares = vectors.join(sums, "lang").select("lang", "term", "sources", "counts", p.alias("p"), (share(F.col("total") + 2, F.col("size")) + 1).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(shares.select("lang", "p"), langs).withColumn("rank", F.row_number().over(order))
    # Spark keeps the first `top` of each task before the shuffle, so that a hot source sends no more.
    terms = _terms(shares).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
