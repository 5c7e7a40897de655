"""Content hashes and keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.text import strip


def content_hash(c: Column) -> Column:
    """SHA-256 of a chunk's text; two texts share it only if they are equal."""
    return F.sha2(c, 256)


def cache_key_hash(c: Column) -> Column:
    """The key of a text in the embedding cache: SHA-256 of the trimmed text, with a prefix."""
    return F.concat(F.lit("s:"), F.sha2(strip(c), 256))


@F.pandas_udf(T.StringType())
def djb2_base36(texts: pd.Series) -> pd.Series:
    """The signed 32-bit djb2 hash over UTF-16 units, base 36: kept for stores that already hold such keys."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        h = 5381
        for unit in memoryview(text.encode("utf-16-le")).cast("H"):
            h = (h * 33 + unit) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        digits, n = "", abs(h)
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        return ("-" if h < 0 else "") + (digits or "0")

    return texts.map(one)
