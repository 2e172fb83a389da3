"""Writers of results, through Spark's own sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invoices(rows: DataFrame, path: str) -> None:
    """One JSON object a line; a missing key is refused, since every field of the contract must be there."""
    needed = {"merchant", "date", "currency", "subtotal", "total", "taxes"}
    if lacking := needed - set(rows.columns):
        raise ValueError(f"fields {sorted(lacking)} are missing")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def error_reply(code: Column, message: Column) -> Column:
    """struct(status, code, message, level): what a caller gets to see; inner errors are masked."""
    status = F.when(code == "too_large", 413).when(code.isin("unreadable", "blurred"), 422).when(code == "bad_request", 400).when(code == "timeout", 504).when(code == "unavailable", 503).otherwise(500)
    return F.struct(status.alias("status"), F.when(status == 500, "internal").otherwise(code).alias("code"), F.when(status == 500, "internal error").otherwise(message).alias("message"), F.when(status >= 500, "error").otherwise("warn").alias("level"))


def per_document(rows: DataFrame, path: str, key: str, order: str) -> None:
    """One JSON object a document: its key and its rows in order. Not a file or folder each, which would be as many as there are documents."""
    fields = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("rows"))
    packed.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def texts(lines: DataFrame, path: str, key: str, order: str, text: str) -> None:
    """One JSON object a document: its key and its lines joined as ``text``."""
    joined = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x[text]), "\n").alias("text"))
    joined.write.mode("overwrite").json(path)


def summary(rows: DataFrame, path: str) -> None:
    """A small table (a row per field) as one JSON file, to compare later runs with."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def dataset(rows: DataFrame, path: str, split: str, index: str) -> None:
    """A data set by split, rows in order of their index within and between the files of a split; as many tasks as the session shuffles to."""
    rows.repartitionByRange(split, index).sortWithinPartitions(split, index).write.mode("overwrite").partitionBy(split).json(path)


def aligned_only(rows: DataFrame, path: str, share: str, least: float = 0.5) -> None:
    """Documents whose aligned share reaches the threshold."""
    rows.where(F.col(share) >= least).write.mode("overwrite").json(path)


def keep_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes a batch into a folder of its number. A batch that is run again replaces what it had written, so nothing doubles."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return keep
