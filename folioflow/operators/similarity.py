"""Likeness of two texts as twice the characters of their matching blocks by the characters of both."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Dashes and quotes that count as one.
ALIKE = ("–—‘’“”", "--''\"\"")


def comparable(text: Column) -> Column:
    """Single spaces, one kind of dashes and quotes, lower case."""
    return F.lower(F.trim(F.translate(F.regexp_replace(text, r"\s+", " "), *ALIKE)))


def first_sentences(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+", n + 1), F.lit(1), F.lit(n)), " ")


def upper_bound(a: str, b: str) -> float:
    """No ratio is larger: a block needs its characters in both texts. 1 for two empty texts."""
    total = len(a) + len(b)
    return 2.0 * (Counter(a) & Counter(b)).total() / total if total else 1.0


def _ratio(least: float) -> Callable[[Column, Column], Column]:
    """The ratio of two texts; null where the bound is below least. Each pair's bound is found once, in one pass over its texts."""

    @F.pandas_udf(DoubleType())
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([SequenceMatcher(None, x, y).ratio() if upper_bound(x, y) >= least else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def dissimilar(rows: DataFrame, least: float = 0.8, sentences: int = 2) -> DataFrame:
    """Id, ratio (six digits; null where a bound decides), similar of rows (id, content, source).

    The first sentences of both are compared. Most unlike pairs fall to the bounds by length and by counts of characters;
    only the others are aligned, in batches. A null text is an empty one, and two empty ones are alike.
    """
    part = lambda c: comparable(first_sentences(F.coalesce(F.col(c), F.lit("")), sentences))
    found = rows.select("id", _ratio(least)(part("content"), part("source")).alias("ratio"))
    return found.select("id", F.round("ratio", 6).alias("ratio"), F.coalesce(F.col("ratio") >= least, F.lit(False)).alias("similar"))
