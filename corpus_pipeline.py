"""A training-data pipeline over ``documents``: identify, deduplicate three ways, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Its result
is written as Parquet and read again before the next. All but the last return the columns of
``docs``, which may have more columns of any name. What every stage does with odd rows: an empty
table stays empty; texts of any length are read whole; a null text counts as empty. Rows that
repeat an id are told apart by their text, but for the third stage, to which an id is one
document; so rows with a null id are judged too, but there, where they stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import exact_dedup, jaccard, language, packing, substring_dedup
from sedimark.llm._common import materialize, purge, written
from sedimark.llm.bloom import anti_join


#: Keys of 20 bytes that are broadcast at most.
BROADCAST_KEYS = 100_000


def _row(doc_id: Column, mark: Column) -> Column:
    """A row by id (may be null) and text."""
    return F.struct(F.coalesce(doc_id.cast("bigint"), F.lit(0)).alias("id"), doc_id.isNull().alias("none"), mark.alias("mark"))


def _drop(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows of ``found`` (doc_id, mark)."""
    gone = materialize(found.select(_row(F.col("doc_id"), F.col("mark")).alias("key")).distinct())
    return anti_join(docs, _row(F.col("doc_id"), F.xxhash64("text")), gone)


def _once(docs: DataFrame) -> DataFrame:
    """One row of those that have the same id and text."""
    key = _row(F.col("doc_id"), F.xxhash64("text"))
    many = materialize(docs.groupBy(key.alias("key")).agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    if many.isEmpty():
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], key.alias("key"))
    first = keyed.join(F.broadcast(many) if many.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else many, "key", "left_semi").dropDuplicates(["key"])
    return anti_join(docs, key, many).unionByName(first.select(*names).toDF(*docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as they are: those without letters and the doubtful ones go. Ties go to the first language by name."""
    return _drop(docs, language.identify(docs).where(~F.col("kept")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest, of several the least id, null last."""
    return _once(_drop(docs, exact_dedup.exact_groups(docs).where(~F.col("kept"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of similar ones. Texts without words are alone and stay."""
    gone = materialize(jaccard.jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct())
    return anti_join(docs, F.col("doc_id").cast("bigint"), gone)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the passages that a document with a smaller id has; n_chars is counted anew. A text that loses nothing stays as it is, null included."""
    out = substring_dedup.rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 ids; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: The models, the components and the tokens of the stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage has written on the way is deleted once its result is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
            purge(spark, docs, before)
    return docs
