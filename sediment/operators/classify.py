"""Query classification and the retrieval parameters of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.text import strip, tr_lower

#: Openers of small talk, and the words that mark each class; own lists.
OPENERS = ["hello", "hi", "hey", "thanks", "thank you", "good morning", "ok", "okay", "merhaba", "selam", "teşekkürler", "günaydın", "peki", "tamam"]
MARKS = {
    "comparison": ["compare", "difference", "versus", "vs", "better than", "karşılaştır", "farkı", "fark"],
    "factual": ["what is", "who", "when", "where", "how many", "how much", "which", "nedir", "kim", "ne zaman", "nerede", "kaç", "hangi"],
    "code": ["code", "function", "class", "error", "bug", "implement", "kod", "fonksiyon", "hata"],
}
#: Fixed values: (topK, threshold, mmr weight, skip retrieval) of each class.
PARAMETERS = [("conversational", 0, 1.0, 0.7, True), ("factual", 6, 0.45, 0.9, False), ("comparison", 12, 0.45, 0.5, False), ("code", 8, 0.5, 0.8, False), ("exploratory", 10, 0.40, 0.7, False)]


def _any(words: list[str]) -> str:
    return r"(^|[^\p{L}\p{N}])(" + "|".join(words) + r")($|[^\p{L}\p{N}])"


def query_type(c: Column) -> Column:
    """Openers are taken off, up to five; nothing left is conversational, then the first class with a mark, else exploratory."""
    def of(low: Column) -> Column:
        for _ in range(5):
            low = F.regexp_replace(low, r"^\s*(" + "|".join(OPENERS) + r")(?![\p{L}\p{N}])[\s,.!?]*", "")
        return strip(low)

    forms = [of(tr_lower(c)), of(F.lower(c))]  # both readings of the letter I
    out = F.when((forms[0] == "") | (forms[1] == ""), "conversational")
    for name in ("comparison", "factual", "code"):
        out = out.when(forms[0].rlike(_any(MARKS[name])) | forms[1].rlike(_any(MARKS[name])), name)
    return out.otherwise("exploratory")


def with_parameters(queries: DataFrame, text: str = "query") -> DataFrame:
    """queries with query_type and its parameters, from a table of five rows."""
    spark: SparkSession = queries.sparkSession
    table = spark.createDataFrame(PARAMETERS, "query_type string, top_k int, threshold double, mmr_weight double, skip_retrieval boolean")
    return queries.withColumn("query_type", query_type(F.col(text))).join(F.broadcast(table), "query_type")
