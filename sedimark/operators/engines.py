"""Engines without a model: a stand-in for reading and one for labels, and how far two engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from . import reading

# The stand-in's texts with their column and their place down the page; where columns begin, height of a line, width of a character, confidence.
STAND_IN = [
    ("CAFE DU COIN", 0, 0.06), ("2026-08-30", 0, 0.14), ("Cafe filtre", 0, 0.28), ("3,25", 1, 0.28), ("Croissant", 0, 0.36), ("4,50", 1, 0.36), ("Sous-total", 0, 0.52),
    ("7,75", 1, 0.52), ("TPS 5%", 0, 0.6), ("0,39", 1, 0.6), ("TVQ 9,975%", 0, 0.68), ("0,77", 1, 0.68), ("TOTAL", 0, 0.8), ("8,91", 1, 0.8),
]
COLUMNS, LINE_HEIGHT, LETTER_WIDTH, SURE = (0.08, 0.62), 28.0, 14.0, 0.9


def stand_in(docs: DataFrame, key: str = "k", width: str = "width", height: str = "height") -> DataFrame:
    """The same fragments for every document, placed by its ``width`` and ``height``: k, ix, text, x, y, w, h, conf."""
    fragment = lambda i, text, column, down: F.struct(F.lit(i).alias("ix"), F.lit(text).alias("text"), (F.col(width) * COLUMNS[column]).alias("x"), (F.col(height) * down).alias("y"), F.lit(LETTER_WIDTH * len(text)).alias("w"), F.lit(LINE_HEIGHT).alias("h"), F.lit(SURE).alias("conf"))
    rows = F.array(*[fragment(i, *x) for i, x in enumerate(STAND_IN)])
    return docs.select(F.col(key).alias("k"), F.explode(rows).alias("r")).select("k", "r.*")


def stand_in_labels(words: DataFrame) -> DataFrame:
    """words (k, ix, line, text, ...) with label, begin and score, without a model: the last word with an amount on the last line that speaks of a
    total or an amount is the TOTAL, all others are O.
    """
    lines = words.groupBy("k", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"]), " ").alias("t"), F.max(F.when(numbers.amount(F.col("text")).isNotNull(), F.col("ix"))).alias("at"),
    )
    says = lambda of: F.lower("t").rlike("|".join(of))
    marked = lines.where(F.col("at").isNotNull() & says(reading.TOTAL_WORDS + reading.AMOUNT_WORDS) & ~says(reading.NOT_A_TOTAL))
    total = marked.groupBy("k").agg(F.max_by("at", "line").alias("at"))
    hit = F.coalesce(F.col("ix") == F.col("at"), F.lit(False))
    return words.join(total, "k", "left").withColumns({"label": F.when(hit, "TOTAL").otherwise("O"), "begin": hit, "score": F.lit(0.9)}).drop("at")


def parity(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of equal labels of two engines over the same words: words, equal, share."""
    both = a.select(*keys, F.col(label).alias("a")).join(b.select(*keys, F.col(label).alias("b")), keys)
    n, e = F.count("*"), F.count_if(F.col("a").eqNullSafe(F.col("b")))
    return both.agg(n.alias("words"), e.alias("equal"), (e / n).alias("share"))
