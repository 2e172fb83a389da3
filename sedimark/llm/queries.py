"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, embedding_dedup, exact_dedup, jaccard, language, lexical_search, oracles, packing, quality, substring_dedup, token_counts, topk_search, url_filter

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Sites whose pages make the list of URLs of op6, with any host in front.
LISTED_SITES = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$"
PACK_END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("mark")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_path(F.col("url"))[0].rlike(LISTED_SITES)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACK_END_ID)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).drop("mark")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")), gone="gone")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_matches(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from the words of its markup, the lang attribute, its host and address suffix."""
    pages = _table(spark, sf_dir, "pages")
    words = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    rows = pages.select("page_id", words.alias("words"), language.markup_language(F.col("html")).alias("markup"), url_filter.host_path(F.col("url"))[0].alias("host"))
    found = language.identify(rows.withColumn("host", F.when(F.col("host") != "", F.col("host"))), declared="markup", host="host", doc_id="page_id", text="words")
    return found.withColumnRenamed("doc_id", "page_id").drop("mark")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_embedding_dedup, op3_token_counts, op4_exact_dedup, op5_byte_bpe, op6_url_filter, op7_substring_dedup, op8_packing, op9_jaccard_join, op10_language_id, op11_conversation_repair, op12_topk_search, op13_lexical_search, language_of_pages)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": oracles.EMBEDDING,
        "op4_exact_dedup": oracles.EXACT,
        "op6_url_filter": oracles.url(URL_RULES, LISTED_SITES),
        "op7_substring_dedup": oracles.SUBSTRING,
        "op9_jaccard_join": oracles.JACCARD,
        "op11_conversation_repair": oracles.CONVERSATIONS,
        "op12_topk_search": oracles.TOPK,
        "op13_lexical_search": oracles.LEXICAL,
    }
