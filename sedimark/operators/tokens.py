"""Token windows, class scores and CTC decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT, STEP = 510, 382


def windows(docs: DataFrame, content: int = CONTENT, step: int = STEP) -> DataFrame:
    """A row per window of a document's ``tokens`` (other columns kept): window, tokens, pad. No tokens, no window."""
    n = F.size("tokens")
    last = F.greatest(F.ceil((n - content) / step).cast("int"), F.lit(0))
    rows = docs.where(n > 0).withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("tokens", F.slice("tokens", F.col("window") * step + 1, content))
    return rows.withColumn("pad", content - F.size("tokens"))


def owned(window: Column, size: Column, content: int = CONTENT, step: int = STEP) -> Column:
    """Tokens of a window that no window before it has: theirs is the label that counts."""
    return F.when(window == 0, size).otherwise(F.greatest(size - (content - step), F.lit(0))).cast("bigint")


def model_input(windows: DataFrame, begin: int, end: int, pad: int, content: int = CONTENT) -> DataFrame:
    """Windows (``windows``) with ids and mask as a model takes them: begin, tokens, end, then padding to the longest window of the document."""
    longest = F.max(F.size("tokens")).over(Window.partitionBy("k"))
    rows = windows.withColumn("length", longest + 2)
    fill = F.col("length") - F.size("tokens") - 2
    ids = F.concat(F.array(F.lit(begin)), F.col("tokens").cast("array<int>"), F.array(F.lit(end)), F.array_repeat(F.lit(pad), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("tokens") + 2), F.array_repeat(F.lit(0), fill))
    return rows.withColumn("ids", ids).withColumn("mask", mask)


def first_labels(scored: DataFrame) -> DataFrame:
    """k, word, best, p: the class of each word's first token in the first window that has the word.

    scored: k, window, at (place in the window), word, logits; tokens without a word are left out before.
    """
    first = scored.groupBy("k", "word").agg(F.min_by("logits", F.struct("window", "at")).alias("logits"))
    best = best_class(F.col("logits"))
    return first.select("k", "word", best.alias("b")).select("k", "word", F.col("b.ix").alias("best"), F.col("b.p").alias("p"))


def best_class(logits: Column) -> Column:
    """struct(ix, p): the first best class from 0 and its softmax."""
    top = F.array_max(logits)
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("ix"), (1 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("p"))


def ctc(steps: Column, charset: list[str]) -> Column:
    """struct(text, conf): best class of each step, repeats merged, class 0 dropped; the mean of the kept values, 0 without any."""
    chars = F.array(*[F.lit(c) for c in charset])
    best = F.transform(steps, lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("c"), F.array_max(s).alias("p")))
    kept = F.transform(best, lambda b, i: F.when((b["c"] > 0) & ((i == 0) | (b["c"] != F.get(best, i - 1)["c"])), b))
    kept = F.array_compact(kept)
    text = F.array_join(F.transform(kept, lambda b: F.get(chars, b["c"])), "")
    conf = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["p"]) / F.size(kept)).otherwise(0.0)
    return F.struct(text.alias("text"), conf.alias("conf"))
