"""Shared pieces of the training-data operators: intermediate tables and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ship


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that names none gets another one: a temporary folder in local
    mode (tests), a folder in the warehouse elsewhere.
    """
    if root := _setting(spark, "spark.checkpoint.dir"):
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="sedimark-")
    else:
        root = _setting(spark, "spark.sql.warehouse.dir").rstrip("/") + "/_sedimark"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Tables are read only after their write has returned, so they need no _SUCCESS, for whose two files Hadoop starts a process each in the driver.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

#: Tables that this driver has written and not deleted yet.
_WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage, so a lost executor costs no more than the running stage.
    ``purge`` removes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sedimark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **UNMARKED).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize``, once nothing is left that reads it."""
    if table.written_to in _WRITTEN:
        _WRITTEN.remove(table.written_to)
    _delete(table.sparkSession, table.written_to)


def written() -> set[str]:
    """The intermediate tables that this driver has now."""
    return set(_WRITTEN)


def purge(spark: SparkSession, keep: DataFrame | None = None, before: Collection[str] = ()) -> None:
    """Delete this driver's intermediate tables but ``keep`` and those of ``before`` (``written`` at some time); results of the others must have been written."""
    stay = {getattr(keep, "written_to", None), *before}
    for path in [p for p in _WRITTEN if p not in stay]:
        _delete(spark, path)
        _WRITTEN.remove(path)


#: Keys whose figures are broadcast together at most, and rows from which a key counts as hot.
SMALL_KEYS, HOT_ROWS = 20_000, 1_000_000


def join_figures(rows: DataFrame, figures: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """rows with the figures of their ``key`` (unique there), null where there are none.

    Up to SMALL_KEYS keys are broadcast. Beyond that the hot ones (``size`` of HOT_ROWS or more:
    at most one in HOT_ROWS rows) are, and their rows and those without a key, which need nothing from the shuffle, are dealt
    out by a salt; so no task gets more than HOT_ROWS rows of a key, and rows are read once. figures should be a written table.
    """
    from pyspark.sql import functions as F

    keys = [key] if isinstance(key, str) else key
    if figures.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        return rows.join(F.broadcast(figures), keys, "left")
    names = [c for c in figures.columns if c not in keys]
    hot, cold = figures.where(F.col(size) >= HOT_ROWS), figures.where(F.col(size) < HOT_ROWS)
    marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*names).alias("_hot"))), keys, "left")
    settled = F.col("_hot").isNotNull() | F.col(keys[0]).isNull()
    salt = F.when(settled, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(F.lit(0).cast("bigint"))
    met = marked.withColumn("_salt", salt).join(cold.select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.struct(*names).alias("_cold")), [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return met.select(*rows.columns, *[found[c].alias(c) for c in names])


#: What operators keep in a Python worker between tasks: name to module and cached function.
CACHES = {"words": ("substring_dedup", "word_hashes"), "counts": ("token_counts", "counter"), "bpe": ("byte_bpe", "codec"), "ids": ("packing", "word_ids")}


#: Rows that a map function works on at a time.
ROWS = 1024


def claim(keep: str | None) -> None:
    """In a worker: drop what other operators have cached there, so that the caches of a pipeline don't add up."""
    dropped = False
    for name, (module, function) in CACHES.items():
        cached = getattr(sys.modules.get(f"{__package__}.{module}"), function, None)
        if name != keep and cached is not None and cached.cache_info().currsize:
            cached.cache_clear()
            dropped = True
    if dropped:
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(table: pa.Table) -> pa.Table:
    """The result of a grouped map, after its working memory has gone back to the system."""
    trim()
    return table


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ROWS rows: texts make thousands of rows tens of megabytes, several times over in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, cache: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors.

    ``run`` gets batches of at most ROWS rows, whatever the session's setting. cache: the one of CACHES that it uses.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(cache)
        yield from run(b.slice(at, ROWS) for b in batches for at in range(0, max(1, b.num_rows), ROWS))
        if cache == "words":  # filled again in no time, and an idle worker is small without it
            claim(None)
        trim()

    return df.mapInArrow(tidy, schema)


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes in ``text`` over all rows; one pass that reads this column alone."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def map_rows(df: DataFrame, columns: dict[str, str], work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, cache: str | None = None) -> DataFrame:
    """``mapInArrow`` over the chosen columns under new names; batches without rows are skipped.

    columns: new name to old name. Renaming first keeps clashes with other columns out.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    named = {new: F.col(f"`{old}`") for new, old in columns.items()}
    if "doc_id" in named:
        named["doc_id"] = named["doc_id"].cast("bigint")
    return map_arrow(df.select(*[c.alias(new) for new, c in named.items()]), run, schema, cache)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings; null is the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
