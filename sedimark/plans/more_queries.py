"""Queries over word boxes, stages, batches and small dimensions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import numbers, words
from ..operators import alignment, images, logs, stages
from ..sources import receipts
from ..sources.receipts import table
from .receipt_queries import LINES_SQL, REC

#: Payment cards by how an order was paid, none for cash: our own.
CARD_OF_MODE = {"1-URGENT": "visa", "2-HIGH": "mastercard", "3-MEDIUM": "interac", "4-NOT SPECIFIED": None, "5-LOW": "interac"}
#: House labels and the public ones they go by: our own.
PUBLIC_LABELS = {"SHOP": "STORE.NAME", "NAME": "MENU.NM", "PRICE": "MENU.PRICE"}
STEPS = ["view", "click", "signup", "purchase"]


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all printed lines with their boxes on a line 800 wide."""
    t = receipts.lines(spark, sf_dir)
    w = t.select("k", "line", F.posexplode(words.word_boxes(F.col("text"), F.lit(3.0), F.lit(800.0))).alias("ix", "w"))
    return w.groupBy("k").agg(F.count("*").alias("words"), F.sum("w.x").cast("bigint").alias("sum_x"), F.sum("w.w").cast("bigint").alias("sum_w"))


WORD_BOXES = rf"""with {LINES_SQL},
p as (select k, line, txt, unnest(regexp_extract_all(txt, '\S+')) as w, generate_subscripts(regexp_extract_all(txt, '\S+'), 1) as ix from ln),
s as (select k, txt, w, ix, line, sum(length(w)) over (partition by k, line order by ix) - length(w) as before, regexp_extract_all(txt, '\s+') as gaps from p),
o as (select k, length(w) as n, length(txt) as total, before + coalesce(list_sum([length(g) for g in gaps[1:ix - 1]]), 0) as off from s)
select k, count(*) as words, cast(sum(floor(3.0 + 800.0 * off / total + 0.5)) as bigint) as sum_x, cast(sum(greatest(1, floor(800.0 * n / total + 0.5))) as bigint) as sum_w from o group by k"""


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as runs and kinds of event as stages: whole milliseconds, share, worst status."""
    status = F.when(F.col("value") >= 95, "failed").when(F.col("value") >= 80, "degraded").when(F.col("value") < 5, "skipped").otherwise("ok")
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("run"), F.col("event_type").alias("stage"), F.floor("value").cast("bigint").alias("ms"), status.alias("status"))
    d = stages.durations(e)
    return d.select("run", "stage", "ms", F.round("share", 6).alias("share"), "status", "steps")


DURATIONS = """with e as (select cast(ts as date) as run, event_type as stage, cast(floor(value) as bigint) as ms, case when value >= 95 then 4 when value >= 80 then 3 when value < 5 then 2 else 1 end as worst from events),
g as (select run, stage, cast(sum(ms) as bigint) as ms, max(worst) as worst, count(*) as steps from e group by 1, 2)
select run, stage, ms, round(greatest(0.02, ms / sum(ms) over (partition by run)), 6) as share, (['ok', 'skipped', 'degraded', 'failed'])[worst] as status, steps from g"""


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the first step of the plan that they have not taken."""
    plan = spark.createDataFrame(list(enumerate(STEPS)), "ord int, step string")
    n = stages.next_step(plan, table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step")))
    return n.groupBy("next_step").agg(F.count("*").alias("users"))


NEXT = "with u as (select distinct user_id from events), s as (select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(STEPS)) + ") t(ord, step)), m as (select user_id, min(ord) as ord from u, s where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = s.step) group by user_id) select step as next_step, count(*) as users from m join s using (ord) group by 1"


def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each receipt in batches of six, the shortest first: characters per batch."""
    t = receipts.lines(spark, sf_dir).withColumn("o", F.length("text") * 1000 + F.col("line"))
    b = stages.batches(t, "k", "o")
    return b.groupBy("k", F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).cast("bigint").alias("chars"))


BATCHES = f"with {LINES_SQL}, b as (select k, txt, (row_number() over (partition by k order by length(txt) * 1000 + line) - 1) // 6 as batch from ln) select k, batch, count(*) as lines, cast(sum(length(txt)) as bigint) as chars from b group by 1, 2"


def category_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a header would be printed: an item whose kind of part differs from the one before."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind"))
    i = receipts.items(spark, sf_dir).join(part, "part")
    before = F.lag("kind").over(Window.partitionBy("k").orderBy("n"))
    return i.withColumn("before", before).where(~F.col("kind").eqNullSafe(F.col("before"))).groupBy("kind").agg(F.count("*").alias("headers"))


HEADERS = f"with {REC}, i as (select k, n, p_type as kind, lag(p_type) over (partition by k order by n) as before from it join part on p_partkey = part) select kind, count(*) as headers from i where kind is distinct from before group by 1"


def card_of_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by payment card through a dimension; cash and unknown modes have none."""
    dim = spark.createDataFrame(list(CARD_OF_MODE.items()), "o_orderpriority string, card string")
    return table(spark, sf_dir, "orders").join(F.broadcast(dim), "o_orderpriority", "left").groupBy("card").agg(F.count("*").alias("orders"))


def public_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by public label: the prefix stays, unknown labels become O."""
    from .receipt_queries import words as labelled

    w = labelled(spark, sf_dir).withColumn("raw", F.when(F.col("label") == "O", "O").otherwise(F.concat(F.when(F.col("begin"), "B-").otherwise("i-"), F.lower("label"))))
    house = F.upper(F.regexp_replace("raw", "^(?i)[bi]-", ""))
    names = F.create_map(*[F.lit(x) for kv in PUBLIC_LABELS.items() for x in kv])
    return w.groupBy(F.coalesce(F.try_element_at(names, house), F.lit("O")).alias("public_label")).agg(F.count("*").alias("words"))


LABELS = f"with {LINES_SQL}, w as (select case when line = 0 then 'STORE.NAME' when line < 3 then 'O' when side = 0 then case when (k + line) % 7 = 0 then 'O' else 'MENU.NM' end else 'MENU.PRICE' end as public_label from bk) select public_label, count(*) as words from w group by 1"


def vocabulary_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the benchmark made of ASCII letters only, by length."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\\s+")).alias("w")).where("w <> ''").distinct()
    ok = F.forall(F.split("w", ""), lambda c: c.rlike("^[A-Za-z]?$"))
    return w.where(ok).groupBy(F.length("w").cast("bigint").alias("n_letters")).agg(F.count("*").alias("words"))


VOCABULARY = r"select length(w) as n_letters, count(*) as words from (select distinct unnest(regexp_split_to_array(text, '\s+')) as w from benchmark) where w <> '' and regexp_full_match(w, '[A-Za-z]+') group by 1"


def detector_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of a detector's input for images as wide and high as parts are large: multiples of 32, halves to even."""
    p = table(spark, sf_dir, "part").select("p_partkey", images.detector_sides(F.col("p_size") * 40, F.col("p_size") * 40 + F.col("p_partkey") % 3000).alias("s"))
    return p.select("p_partkey", "s.width", "s.height")


DETECTOR = "select p_partkey, greatest(32, cast(round_even(floor(w * s) / 32, 0) as bigint) * 32) as width, greatest(32, cast(round_even(floor(h * s) / 32, 0) as bigint) * 32) as height from (select *, least(1.0, 2016.0 / greatest(w, h)) as s from (select p_partkey, cast(p_size * 40 as double) as w, cast(p_size * 40 + p_partkey % 3000 as double) as h from part))"

SENT = "level int, time bigint, msg string, hostname string, pid int, value double, high boolean, err struct<type:string,k:bigint,deep:struct<x:int>>, `a.b` string"


def log_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events printed as log lines, some cut off and some without message, time or host, and these as messages to ship."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    level = F.when(F.col("event_type") == "error", 50).when(F.col("event_type") == "view", 35).when(F.col("event_type") != "signup", F.col("event_id") % 7 * 10)
    err = F.when(F.col("event_type") == "error", F.struct(F.lit("E").alias("type"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct(F.lit(1).alias("x")).alias("deep")))
    fields = [level.cast("int").alias("level"), F.when(F.col("event_id") % 11 != 0, ms).alias("time"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("msg"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("hostname"), F.lit(1).alias("pid"), F.col("value"), (F.col("value") > 50).alias("high"), err.alias("err"), F.lit("p").alias("a.b")]
    line = F.to_json(F.struct(*fields))
    lines = e.select("event_id", ms.alias("at"), F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    out = logs.envelope(lines, "line", StructType.fromDDL(SENT), {"host": "service"}, F.col("at"))
    return out.drop("at").withColumn("_value_num", F.round("_value_num", 6)).withColumn("timestamp", F.round("timestamp", 3))


SENT_SQL = """with e as (select *, epoch_ms(date_trunc('millisecond', ts)) as ms, case when event_type = 'error' then 50 when event_type = 'view' then 35 when event_type <> 'signup' then event_id % 7 * 10 end as l from events where event_id % 17 <> 0)
select event_id, 'service' as host, '1.1' as version, case when event_id % 5 <> 0 then event_type else '(sans message)' end as short_message, round(ms / 1000, 3) as timestamp,
  case l when 10 then 7 when 20 then 7 when 40 then 4 when 50 then 3 when 60 then 2 else 6 end as level, case l when 10 then 'trace' when 20 then 'debug' when 40 then 'warn' when 50 then 'error' when 60 then 'fatal' else 'info' end as _niveau,
  case when event_id % 3 = 0 then 'h' || user_id end as _conteneur, round(value, 6) as _value_num, case when value > 50 then 'true' else 'false' end as _high_bool,
  case when event_type = 'error' then 'E' end as _err_type, case when event_type = 'error' then cast(json_extract(props, '$.k') as double) end as _err_k_num, 'p' as _a_b from e"""


def relabelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of printed words (amounts and names) carried to a reading in lower case with the lines in reverse order: per receipt the words, those
    labelled as printed, and the characters printed."""
    label = lambda w: F.when(w.rlike("^[0-9]"), "PRICE").otherwise("NAME")
    printed = receipts.lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    split = lambda t: F.filter(F.split(t, " +"), lambda w: w.rlike("[A-Za-z0-9]"))
    g = alignment.dealt(printed).select("k", F.transform("l", lambda x: F.struct(x["line"].alias("line"), split(x["text"]).alias("w"))).alias("l"))
    words = lambda l: F.flatten(F.transform(l, lambda x: x["w"]))  # noqa: E731, E741
    docs = g.select("k", F.transform(words(F.col("l")), lambda w: F.struct(w.alias("word"), label(w).alias("label"))).alias("source"), F.transform(words(F.reverse("l")), F.lower).alias("read"), F.flatten(F.transform(F.reverse("l"), lambda x: F.array_repeat(x["line"].cast("int"), F.size(x["w"])))).alias("lines"))
    done = alignment.relabel_documents(docs.withColumn("want", F.transform("read", label)), "want", deal=False)
    return done.select("k", F.size("labels").cast("bigint").alias("words"), F.size(F.filter(F.arrays_zip("labels", "want"), lambda x: x["labels"] == x["want"])).cast("bigint").alias("right_words"), "characters")


RELABELLED = rf"""with {LINES_SQL}, w as (select k, unnest(list_filter(regexp_split_to_array(txt, ' +'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) as w from ln)
select k, count(*) as words, count(*) as right_words, cast(sum(length(w)) as bigint) as characters from w group by k"""


def amount_parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every whole document how many lines have an amount, the last of them, and the sum, in cents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", numbers.line_amounts(F.col("text")).alias("a"))
    cents = F.transform("a", lambda a: F.round(a * 100).try_cast("bigint"))
    total = F.aggregate(cents, F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + F.coalesce(c, F.lit(0))).cast("decimal(38,0)"))
    return docs.select("doc_id", F.size("a").cast("bigint").alias("lines"), F.try_element_at(cents, F.lit(-1)).alias("last_cents"), total.cast("string").alias("cents"))


# This engine's patterns can't look around. Letters are set apart first, and a minus behind a digit or another minus becomes a letter glued to what follows, so
# that word boundaries say where an amount may begin and end.
_SPACES = r"\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LAST_AMOUNT = rf"""regexp_extract_all(regexp_replace(regexp_replace(line, '([A-Za-z_])', ' \1 ', 'g'), '([\d-])-+', '\1 x', 'g'), '-?\b\d{{1,3}}(?:[{_SPACES},.]?\d{{3}})*[.,][{_SPACES}]?\d{{1,2}}\b')[-1]"""
LINE_CENTS = rf"""try_cast(round(100 * try_cast(concat(case when m like '-%' then '-' else '' end, regexp_replace(regexp_extract(m, '^(.*)[.,]', 1), '[^\d]', '', 'g'), '.', regexp_extract(m, '(\d{{1,2}})$', 1)) as double)) as bigint)"""
DOCUMENT_AMOUNTS = f"""with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
m as (select doc_id, i, {LAST_AMOUNT} as m from d), c as (select doc_id, i, m, {LINE_CENTS} as c from m where m is not null),
g as (select doc_id, count(*) as lines, arg_max_null(c, i) as last_cents, sum(c) as cents from c group by doc_id)
select doc_id, coalesce(lines, 0) as lines, last_cents, cast(coalesce(cents, 0) as varchar) as cents from documents left join g using (doc_id)"""


QUERIES = {
    "amount_parse_documents": (amount_parse_documents, DOCUMENT_AMOUNTS),
    "log_envelope": (log_envelope, SENT_SQL),
    "relabelled_words": (relabelled_words, RELABELLED),
    "word_boxes": (word_boxes, WORD_BOXES),
    "stage_durations": (stage_durations, DURATIONS),
    "next_steps": (next_steps, NEXT),
    "line_batches": (line_batches, BATCHES),
    "category_headers": (category_headers, HEADERS),
    "card_of_mode": (card_of_mode, "select card, count(*) as orders from orders left join (" + " union all ".join(f"select '{m}' as mode, {repr(c) if c else 'null'} as card" for m, c in CARD_OF_MODE.items()) + ") on mode = o_orderpriority group by 1"),
    "public_labels": (public_labels, LABELS),
    "vocabulary_subset": (vocabulary_subset, VOCABULARY),
    "detector_sizes": (detector_sizes, DETECTOR),
}
