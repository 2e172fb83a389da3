"""URL verdicts: host and path rules, then a list of URLs behind a blocked Bloom filter.

DataFrame functions only. The listed canonical URLs make a blocked Bloom filter (``bloom``); most
URLs end there, as not listed. The possible hits go through an exact hash join with the list,
which removes false positives: all in one pass over the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SMALL_KEYS, join_figures, materialize
from .bloom import flagged


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: host and path without a last slash; empty host: null."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts
    with the rule's. Of equally long ones the first in alphabetical order is taken.
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """Judge URLs: page_id, host, path, rule, verdict (allow or block), listed.

    One row per input row. The longest rule that fits decides; where none does, a URL whose
    canonical form is listed is blocked and any other allowed. Null or malformed URLs have an
    empty host and path and are never listed. Repeated rows stay, null ids too; repeated or null
    listed URLs count once or not at all; an empty list blocks nothing; a URL of any length is
    read whole; other columns are ignored; no pages give an empty result.
    """
    lh, lp = host_path(F.col(listed_url))
    names = materialize(listed.select(canonical(lh, lp).alias("key")).where("key is not null").distinct())

    h, p = host_path(F.col("url"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    rows = rows.select("page_id", h.alias("host"), p.alias("path"))
    rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("key", F.when(F.col("hit").isNull(), canonical(F.col("host"), F.col("path"))))  # the list matters where no rule fits
    asked = flagged(rows, "key", names, "maybe").withColumn("key", F.when(F.col("maybe"), F.col("key"))).drop("maybe")
    figures = names.withColumn("pages", F.lit(1).cast("bigint"))
    if names.limit(SMALL_KEYS + 1).count() > SMALL_KEYS:  # then the pages of each possible hit are counted, since one URL may be on very many
        figures = asked.where("key is not null").groupBy("key").agg(F.count("*").alias("pages")).join(names, "key")
        figures = materialize(figures)
    judged = join_figures(asked, figures, "key", "pages")
    there = F.col("pages").isNotNull()
    verdict = F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).when(there, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), there.alias("listed"))
