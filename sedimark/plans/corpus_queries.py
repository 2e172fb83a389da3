"""Queries over documents, pages, conversations, labels, embeddings and events, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import categories, entities, logs, scoring, tokens
from ..sources.receipts import table


def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.coalesce("text", F.lit("")))).alias("digest"))


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(F.coalesce("text", F.lit("")))).alias("digest"))


def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per site name; the subdomain goes with it, as what stands before the suffix is one word."""
    return table(spark, sf_dir, "pages").select(text.site_name(F.regexp_replace("url", "^(https?://)(?:[a-z0-9-]+\\.)*([a-z0-9-]+\\.[a-z]+)([/?#].*)?$", "$1$2")).alias("site")).groupBy("site").agg(F.count("*").alias("pages"))


SITES = r"select nullif(regexp_extract(lower(regexp_replace(url, '^(https?://)(?:[a-z0-9-]+\.)*([a-z0-9-]+\.[a-z]+)([/?#].*)?$', '\1\2')), '(?:https?://|\bwww\.)(?:www\.)?([a-z0-9-]+)\.(?:com|ca|net|org|quebec)\b', 1), '') as site, count(*) as pages from pages group by 1"


def keyword_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per keyword phrase (the openings of the benchmark items, of one to three words): the longest size with a hit wins in a document."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)])).alias("phrase")).where("phrase <> ''").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    hits = categories.longest_phrases(docs, keys, "doc_id", 3)
    return hits.groupBy("phrase").agg(F.countDistinct("doc_id").alias("docs"))


NGRAMS = r"""with kw as (select distinct phrase from (select array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:n], ' ') as phrase from benchmark, range(1, 4) t(n)) where phrase <> ''),
d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') w from documents),
g as (select doc_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) phrase from d, range(1, 4) t(n)),
h as (select distinct doc_id, n, phrase from g semi join kw using (phrase)), m as (select doc_id, max(n) n from h group by doc_id)
select phrase, count(distinct doc_id) as docs from h semi join m using (doc_id, n) group by phrase"""


def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' customers by category of the shop on their receipts, through the keyword table."""
    names = F.element_at(F.create_map(*[F.lit(x) for kv in categories.SEGMENT_NAMES.items() for x in kv]), F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), names.alias("name"))
    found = categories.categorise(c, categories.keywords(spark), "k", "name")
    return found.groupBy("category", "subcategory").agg(F.count("*").alias("customers"))


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_category(spark, sf_dir).rollup("category", "subcategory").agg(F.sum("customers").cast("bigint").alias("customers"), F.grouping_id().cast("bigint").alias("level"))


def _predictions(spark: SparkSession, sf_dir: str, marks: str, least: int) -> DataFrame:
    """quality and toxic of labelled documents by simple rules, long form: doc_id, field, expected, read, verdict."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    junk = F.length(F.regexp_replace("text", f"[^{marks}]", ""))
    read = d.select("doc_id", "quality", "toxic", (junk * 50 < F.length("text")).cast("int").alias("q"), F.when(F.length("text") >= least, F.lower("text").rlike("(^|[^a-z])(idiot|clown|pathetic|worthless)([^a-z]|$)").cast("int")).alias("t"))
    rows = read.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").alias("expected"), F.col("q").alias("read")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").alias("expected"), F.col("t").alias("read")))).alias("r")).select("doc_id", "r.*")
    return rows.withColumn("verdict", scoring.verdict(F.col("expected"), F.col("read"), F.col("expected") == F.col("read")))


def _pred_sql(name: str, marks: str, least: int) -> str:
    return rf"""{name} as (select *, case when expected is null and got is null then 'vide' when got is null then 'manquant' when expected = got then 'juste' else 'faux' end as verdict from (
  select doc_id, 'quality' as field, quality as expected, cast(length(regexp_replace(text, '[^{marks}]', '', 'g')) * 50 < length(text) as int) as got from documents join labels using (doc_id)
  union all select doc_id, 'toxic', toxic, case when length(text) >= {least} then cast(regexp_matches(lower(text), '(^|[^a-z])(idiot|clown|pathetic|worthless)([^a-z]|$)') as int) end from documents join labels using (doc_id)))"""


OLD, NEW = ("!#$%&*|", 30), ("!|", 10)


def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.counts(_predictions(spark, sf_dir, *OLD))


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusions(_predictions(spark, sf_dir, *OLD))


def all_right_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.all_right(_predictions(spark, sf_dir, *OLD), ["toxic"]).groupBy("all_right", "shown_right").agg(F.count("*").alias("docs"))


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.regressions(_predictions(spark, sf_dir, *OLD), _predictions(spark, sf_dir, *NEW))


def setbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and fields that the old rules got right and the new ones don't."""
    return scoring.setbacks(_predictions(spark, sf_dir, *OLD), _predictions(spark, sf_dir, *NEW), "doc_id")


def right_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.right_share(_predictions(spark, sf_dir, *OLD))


PIVOT = rf"""with {_pred_sql('p', *OLD)}, c as (select field, count(*) filter (where verdict = 'juste') juste, count(*) filter (where verdict = 'faux') faux, count(*) filter (where verdict = 'manquant') manquant, count(*) filter (where verdict = 'vide') vide from p group by field)
select *, round(case when juste + faux + manquant = 0 then 1.0 else juste / (juste + faux + manquant) end, 6) as accuracy, round(case when juste + faux = 0 then 1.0 else juste / (juste + faux) end, 6) as precision from c"""
GATE = rf"""with {_pred_sql('a', *OLD)}, {_pred_sql('b', *NEW)},
x as (select field, count(*) filter (where verdict = 'juste') right_before, count(*) filter (where verdict = 'faux') wrong_before from a group by field), y as (select field, count(*) filter (where verdict = 'juste') right_now, count(*) filter (where verdict = 'faux') wrong_now from b group by field)
select *, right_now < right_before or wrong_now > wrong_before as regressed from x join y using (field)"""


def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that speaks most in each conversation; of several the first to speak."""
    return entities.majority(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


MAJORITY = "select conv_id, role, votes from (select *, row_number() over (partition by conv_id order by votes desc, seen) r from (select conv_id, role, count(*) as votes, min(turn) as seen from conversations group by 1, 2)) where r = 1"


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 510 words, each beginning 382 after the last, over whole documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "").alias("tokens"))
    w = tokens.windows(d)
    return w.select("doc_id", F.col("window").cast("bigint").alias("window"), F.size("tokens").cast("bigint").alias("size"), F.col("pad").cast("bigint").alias("pad"), F.md5(F.array_join("tokens", " ")).alias("digest"))


WINDOWS = r"""with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') w from documents),
s as (select doc_id, w, unnest(range(0, greatest(cast(ceil((len(w) - 510) / 382.0) as bigint), 0) + 1)) as win from d where len(w) > 0)
select doc_id, win as "window", len(w[win * 382 + 1:win * 382 + 510]) as size, 510 - len(w[win * 382 + 1:win * 382 + 510]) as pad, md5(array_to_string(w[win * 382 + 1:win * 382 + 510], ' ')) as digest from s"""


def first_hit_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that each word's label comes from: the first with the word in it. Words per document and window, by ``tokens.owned``."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "").alias("tokens"))
    w = tokens.windows(d)
    return w.select("doc_id", F.col("window").cast("bigint").alias("window"), tokens.owned(F.col("window"), F.size("tokens")).alias("words")).where("words > 0")


FIRST = r"""with d as (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) n from documents), w as (select doc_id, unnest(range(0, n)) i from d where n > 0),
c as (select doc_id, i, unnest(range(0, 1000)) as win from w), f as (select doc_id, i, case when i < 510 then 0 else cast(ceil((i - 509) / 382.0) as bigint) end as win from w) select doc_id, win as "window", count(*) as words from f group by 1, 2"""


def argmax_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    best = tokens.best_class(F.col("logits"))
    return e.select("vec_id", best.alias("b")).select("vec_id", F.col("b.ix").cast("bigint").alias("best"), F.round("b.p", 5).alias("p"))


ARGMAX = "select vec_id, cast(list_position(e, list_max(e)) - 1 as bigint) as best, round(1 / list_sum([exp(x - list_max(e)) for x in e]), 5) as p from (select vec_id, cast(embedding as double[]) e from embeddings)"


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8 steps over 8 classes, the first of them blank."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8)).alias("steps"))
    return e.select("vec_id", tokens.ctc(F.col("steps"), ["", *"abcdefg"]).alias("r")).select("vec_id", "r.text", F.round("r.conf", 6).alias("conf"))


CTC = """with s as (select vec_id, [e[i * 8 + 1:i * 8 + 8] for i in range(0, 8)] st from (select vec_id, cast(embedding as double[]) e from embeddings)),
b as (select vec_id, [list_position(x, list_max(x)) - 1 for x in st] c, [list_max(x) for x in st] p from s),
k as (select vec_id, c, p, [i for i in range(1, 9) if c[i] > 0 and (i = 1 or c[i] <> c[greatest(i - 1, 1)])] kept from b)
select vec_id, array_to_string([substr('abcdefg', cast(c[i] as int), 1) for i in kept], '') as text, round(case when len(kept) = 0 then 0.0 else list_sum([p[i] for i in kept]) / len(kept) end, 6) as conf from k"""


def ts(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def log_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("type"), F.col("value"), (F.col("value") > 50).alias("high"), F.from_json("props", "struct<k:bigint>").alias("props")).alias("record"))
    flat = logs.flatten(e, "record")
    return flat.select("event_id", "_type", F.round("_value_num", 6).alias("_value_num"), "_high_bool", "_props_k_num")


FLAT = "select event_id, event_type as _type, round(value, 6) as _value_num, case when value > 50 then 'true' else 'false' end as _high_bool, cast(json_extract(props, '$.k') as double) as _props_k_num from events"


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"))


def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the mean, the exact 95th percentile and the median of values."""
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("events"), F.round(F.avg("value"), 5).alias("mean_value"), F.round(F.expr("percentile(value, 0.95)"), 5).alias("p95"), F.round(F.expr("percentile(value, 0.5)"), 5).alias("p50"))


def stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by kind of event and day, the kinds side by side, and a kind's share of the day."""
    e = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    e = e.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy("day")), 5))
    return e.select("day", "event_type", F.round("mean", 5).alias("mean_value"), "share")


def refusal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users with most errors, ties by id."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    return e.orderBy(F.desc("errors"), "user_id").limit(10)


def alert_error_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alert_counts(table(spark, sf_dir, "events").where("event_type = 'error'"), "10 minutes", 1)


def alert_mean_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = logs.alert_means(table(spark, sf_dir, "events"), "15 minutes", "value", 70.0)
    return w.withColumn("mean_value", F.round("mean_value", 5))


def alert_absence_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alert_absence(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "15 minutes")


def _bucket(minutes: int) -> str:
    return f"time_bucket(interval '{minutes} minutes', ts, timestamp '1970-01-01')"


ABSENCE = f"""with b as (select distinct {_bucket(15)} as start_ts from events where event_type = 'purchase'), r as (select unnest(generate_series((select min(start_ts) from b), (select max(start_ts) from b), interval '15 minutes')) as start_ts)
select start_ts from r anti join b using (start_ts)"""


def failure_sliding_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with at least one other error of the same user in the 6 hours before: the count in that span."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.col("ts"))
    w = logs.sliding_counts(e, "user_id", 6 * 3600)
    return w.where("recent > 1").select("event_id", "user_id", "recent")


SLIDING = "select event_id, user_id, recent from (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as recent from events where event_type = 'error') where recent > 1"


def rate_limit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and hours with more than one event: how many were beyond the limit."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"))
    return e.where("events > 1").withColumn("refused", F.col("events") - 1)


QUERIES = {
    "fold_accents": (fold_accents, "select doc_id, md5(lower(strip_accents(coalesce(text, '')))) as digest from documents"),
    "compact_text": (compact_text, "select doc_id, md5(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]', '', 'g')) as digest from documents"),
    "site_names": (site_names, SITES),
    "keyword_ngrams": (keyword_ngrams, NGRAMS),
    "keyword_category": (keyword_category, "select category, subcategory, count(*) as customers from customer join (" + " union all ".join(f"select '{s}' as seg, {repr(c) if c else 'null'} as category, {repr(u) if u else 'null'} as subcategory" for s, (c, u) in categories.SEGMENT_TRUTH.items()) + ") on seg = c_mktsegment group by 1, 2"),
    "category_rollup": (category_rollup, "select category, subcategory, count(*) as customers, grouping_id(category, subcategory) as level from customer join (" + " union all ".join(f"select '{s}' as seg, {repr(c) if c else 'null'} as category, {repr(u) if u else 'null'} as subcategory" for s, (c, u) in categories.SEGMENT_TRUTH.items()) + ") on seg = c_mktsegment group by rollup (category, subcategory)"),
    "verdict_pivot": (verdict_pivot, PIVOT),
    "confusions": (confusions, f"with {_pred_sql('p', *OLD)} select field, expected, got as read, count(*) as n, min(doc_id) as first_doc from p where verdict = 'faux' group by 1, 2, 3"),
    "all_right_docs": (all_right_docs, f"with {_pred_sql('p', *OLD)}, a as (select doc_id, bool_and(verdict in ('juste', 'vide')) as all_right, bool_and(verdict in ('juste', 'vide') or field = 'toxic') as shown_right from p group by doc_id) select all_right, shown_right, count(*) as docs from a group by 1, 2"),
    "regression_gate": (regression_gate, GATE),
    "setbacks": (setbacks, f"with {_pred_sql('a', *OLD)}, {_pred_sql('b', *NEW)} select a.doc_id, a.field, a.verdict as old, b.verdict as new from a join b on a.doc_id = b.doc_id and a.field = b.field where a.verdict in ('juste', 'vide') and b.verdict not in ('juste', 'vide')"),
    "right_share": (right_share, f"with {_pred_sql('p', *OLD)} select count(*) filter (where verdict <> 'vide') as graded, count(*) filter (where verdict = 'juste') as right, round(count(*) filter (where verdict = 'juste') / count(*) filter (where verdict <> 'vide'), 6) as share from p".replace("as right,", 'as "right",')),
    "majority_label": (majority_label, MAJORITY),
    "token_windows": (token_windows, WINDOWS),
    "first_hit_wins": (first_hit_wins, FIRST.replace("c as (select doc_id, i, unnest(range(0, 1000)) as win from w), ", "")),
    "argmax_softmax": (argmax_softmax, ARGMAX),
    "ctc_decode": (ctc_decode, CTC),
    "log_flatten": (log_flatten, FLAT),
    "hourly_counts": (hourly_counts, "select date_trunc('hour', ts) as hour, event_type, count(*) as events from events group by 1, 2"),
    "latency_p95": (latency_p95, "select cast(ts as date) as day, count(*) as events, round(avg(value), 5) as mean_value, round(quantile_cont(value, 0.95), 5) as p95, round(quantile_cont(value, 0.5), 5) as p50 from events group by 1"),
    "stage_means": (stage_means, "select day, event_type, round(mean, 5) as mean_value, round(total / sum(total) over (partition by day), 5) as share from (select cast(ts as date) as day, event_type, sum(value) as total, avg(value) as mean from events group by 1, 2)"),
    "refusal_terms": (refusal_terms, "select user_id, count(*) as errors from events where event_type = 'error' group by 1 order by 2 desc, 1 limit 10"),
    "alert_error_10m": (alert_error_10m, f"select {_bucket(10)} as start_ts, count(*) as events from events where event_type = 'error' group by 1 having count(*) > 1"),
    "alert_mean_15m": (alert_mean_15m, f"select {_bucket(15)} as start_ts, round(avg(value), 5) as mean_value from events group by 1 having avg(value) > 70.0"),
    "alert_absence_15m": (alert_absence_15m, ABSENCE),
    "failure_sliding_60s": (failure_sliding_60s, SLIDING),
    "rate_limit_buckets": (rate_limit_buckets, "select user_id, date_trunc('hour', ts) as hour, count(*) as events, count(*) - 1 as refused from events group by 1, 2 having count(*) > 1"),
}
