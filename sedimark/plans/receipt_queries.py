"""Queries over virtual receipts, and DuckDB SQL that reaches the same rows from the tables.

The Spark side reads printed lines; the SQL side knows the cents that went into them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import brands, categories, collect, entities, reading, scoring, solver
from ..session import staged
from ..sources import receipts

AS_OF = "date '2029-12-31'"

#: The receipts as SQL: it (items), tot (totals), hd (headers).
REC = """
it as (select k, n, part, supp, qty, gross, disc, (gross * (100 - disc) + 50) // 100 as net, taxable from (
  select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) n, l_partkey part, l_suppkey supp, l_quantity qty,
    cast(round(l_extendedprice * 100) as bigint) gross, cast(round(l_discount * 100) as bigint) disc, l_tax > 0 as taxable from lineitem)),
tot as (select *, sub + tps + tvq as total from (select *, (base * 5 + 50) // 100 as tps, (base * 9975 + 50000) // 100000 as tvq from (
  select k, count(*) as lines, cast(sum(net) as bigint) sub, cast(coalesce(sum(net) filter (where taxable), 0) as bigint) base from it group by k))),
hd as (select tot.*, cast(cast(o_orderdate as date) + interval 28 year as date) as dt, cast(round(o_totalprice * 100) as bigint) misread, c_mktsegment segment, c_nationkey nation from tot join orders on o_orderkey = k join customer on c_custkey = o_custkey)
"""


def receipt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.totals(spark, sf_dir).select("k", "lines", "sub", "base", "tps", "tvq", "total")


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reading.candidates(receipts.lines(spark, sf_dir))
    return c.select("k", solver.solve(F.col("totals"), F.col("subtotals"), F.col("taxes")).alias("s")).select("k", "s.*")


def coherence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir).groupBy((F.col("k") % 5).alias("variant"), "coherence").agg(F.count("*").alias("receipts"))


SOLVED = f"""
{REC},
tc as (select k, 0 as i, (case when k % 5 = 1 then misread else total end) / 100.0 as v, cast(lines as int) + 7 as line from hd union all select k, 1, total / 100.0, cast(lines as int) + 8 from hd),
t as (select k, i, v, line from tc a where i = 0 or not exists (select 1 from tc b where b.k = a.k and b.i = 0 and abs(a.v - b.v) <= 0.020001)),
tn as (select * from t union all select k, cast(count(*) as int), null, null from t group by k),
sn as (select k, 0 as j, sub / 100.0 as s, cast(lines as int) + 3 as sline from hd where k % 5 <> 2 union all select k, case when k % 5 = 2 then 0 else 1 end, null, null from hd),
x as (select k, 'tps' as kind, tps / 100.0 as a, cast(lines as int) + 4 as xline from hd union all select k, 'tvq', tvq / 100.0, cast(lines as int) + 5 from hd where k % 5 <> 4 union all select k, 'other', (sub // 5) / 100.0, cast(lines as int) + 6 from hd where k % 5 = 3),
p as (select tn.k, i, v, line, j, s, sline from tn join sn on tn.k = sn.k),
px as (select p.*, x.kind, x.a from p left join x on x.k = p.k and not coalesce(x.xline > p.line, false)
  and (x.a = 0 or (not coalesce(v > 0 and x.a >= v, false) and not coalesce(s > 0 and x.a > 0.15 * s + 0.02, false)))),
g as (select k, i, j, v, s, coalesce(sum(a), 0) as taxes, cast(count(a) as bigint) n_taxes,
  count(*) filter (where kind = 'tps' and a > 0) n1, count(*) filter (where kind = 'tvq' and a > 0) n2, max(a) filter (where kind = 'tps') a1, max(a) filter (where kind = 'tvq') a2
  from px group by k, i, j, v, s),
e as (select *, coalesce(abs(s + taxes - v) <= 0.020001, false) as closes,
  (case when n1 = 1 and n2 = 1 and abs(a2 - a1 * 0.09975 / 0.05) <= 0.020001 then 1 else 0 end) + (case when n1 = 1 and abs(a1 - 0.05 * s) <= 0.020001 then 1 else 0 end) + (case when n2 = 1 and abs(a2 - 0.09975 * s) <= 0.020001 then 1 else 0 end) as pts from g),
b as (select *, case when closes then 'coherente' when v is not null and s is not null then 'incoherente' else 'indeterminee' end as coherence,
  row_number() over (partition by k order by pts + case when closes then 2 else 0 end desc, i + j, i) as r from e)
"""


def solved_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir).select("k", F.col("total.value").alias("total"), F.col("subtotal.value").alias("subtotal"), F.size("taxes").cast("bigint").alias("n_taxes"), "coherence", F.round("total.conf", 6).alias("total_conf"))


def amount_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = receipts.lines(spark, sf_dir)
    t = numbers.once(t.select("k", F.col("line").cast("bigint").alias("line"), "text"), cents=F.round(numbers.amount(F.col("text")) * 100).cast("bigint"))
    return t.select("k", "line", "cents").where("cents is not null")


AMOUNTS = f"""with {REC}
select k, n + 2 as line, net as cents from it semi join hd using (k) union all select k, lines + 3, sub from hd where k % 5 <> 2 union all select k, lines + 4, tps from hd
union all select k, lines + 5, tvq from hd where k % 5 <> 4 union all select k, lines + 6, sub // 5 from hd where k % 5 = 3
union all select k, lines + 7, case when k % 5 = 1 then misread else total end from hd union all select k, lines + 8, total from hd
"""


def date_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = receipts.lines(spark, sf_dir).where("line = 2")
    return reading.date(t, F.expr(AS_OF)).select("k", "date", "date_conf")


DATES = f"with {REC} select k, dt as date, case when k % 4 = 3 and day(dt) <= 12 then cast(0.6 as double) else cast(0.9 as double) end as date_conf from hd"


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.articles(receipts.lines(spark, sf_dir)).select("k", F.col("line").cast("bigint").alias("line"), "label", F.round(F.col("amount") * 100).cast("bigint").alias("cents"))


ARTICLES = f"with {REC} select k, n + 2 as line, upper(coalesce(p_name, 'article')) as label, net as cents from it semi join hd using (k) left join part on p_partkey = part"


def currency_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.currency(receipts.lines(spark, sf_dir))


def card_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.card(receipts.lines(spark, sf_dir))


def merchant_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.merchant(receipts.lines(spark, sf_dir), brands.catalogue(categories.keywords(spark)), F.expr(AS_OF))


def _shop(column: str = "segment") -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in receipts.SHOPS.items()) + " end"


def total_candidates_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reading.candidates(receipts.lines(spark, sf_dir))
    kept = F.filter(solver.options(F.col("totals")), lambda x: x.isNotNull())
    return c.select("k", F.posexplode(kept).alias("rank", "c")).select("k", F.col("rank").cast("bigint").alias("rank"), F.round(F.col("c.value") * 100).cast("bigint").alias("cents"), F.round("c.conf", 6).alias("conf"))


TOP4 = f"""with {REC} select k, cast(0 as bigint) as rank, case when k % 5 = 1 then misread else total end as cents, cast(0.7 as double) as conf from hd
union all select k, 1, total, cast(0.56 as double) from hd where k % 5 = 1 and abs(misread - total) > 2"""


def tax_recompute_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed taxes that their rate on the taxable items doesn't give, by kind: none for the receipts as made."""
    printed = receipts.lines(spark, sf_dir).where(F.col("text").rlike("^(T\\.P\\.S|TVQ)")).select("k", F.when(F.col("text").startswith("TVQ"), "tvq").otherwise("tps").alias("kind"), F.round(numbers.amount(F.col("text")) * 100).cast("bigint").alias("cents"))
    base = receipts.items(spark, sf_dir).groupBy("k").agg(F.coalesce(F.sum(F.when(F.col("taxable"), F.col("net"))), F.lit(0)).alias("base"))
    t = printed.join(base, "k").withColumn("due", F.when(F.col("kind") == "tps", F.expr("(base * 5 + 50) div 100")).otherwise(F.expr("(base * 9975 + 50000) div 100000")))
    return t.groupBy("kind").agg(F.count("*").alias("taxes"), F.count_if(F.col("cents") != F.col("due")).alias("violations"))


def total_closure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose read sub-total and taxes don't add up to what was paid, by variant."""
    c = reading.candidates(receipts.lines(spark, sf_dir))
    cents = lambda x: F.round(x * 100).cast("bigint")
    parts = c.select("k", cents(F.col("totals")[F.size("totals") - 1]["value"]).alias("paid"), cents(F.try_element_at("subtotals", F.lit(1))["value"]).alias("sub"), F.aggregate("taxes", F.lit(0).cast("bigint"), lambda a, t: a + cents(t["amount"])).alias("taxes"))
    return parts.groupBy((F.col("k") % 5).alias("variant")).agg(F.count("*").alias("receipts"), F.count_if(F.coalesce(F.col("sub") + F.col("taxes") != F.col("paid"), F.lit(True))).alias("violations"))


CLOSURE = f"""with {REC} select k % 5 as variant, count(*) as receipts, count(*) filter (where case k % 5 when 2 then true when 3 then sub // 5 <> 0 when 4 then tvq <> 0 else false end) as violations from hd group by 1"""


def line_count_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with fewer or more article lines than items sold."""
    read = reading.articles(receipts.lines(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("read"))
    t = receipts.totals(spark, sf_dir).select("k", "lines").join(read, "k", "left")
    return t.groupBy("lines").agg(F.count("*").alias("receipts"), F.count_if(F.coalesce(F.col("read") != F.col("lines"), F.lit(True))).alias("violations"))


def cash_rounding_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash due, what is handed over and the change, in cents."""
    t = numbers.once(receipts.totals(spark, sf_dir).select("k", numbers.cash_cents(F.col("total")).alias("cash")), tendered=numbers.tendered(F.col("cash")))
    return t.withColumn("change", F.col("tendered") - F.col("cash"))


CASH = f"""with {REC} select k, cash, tendered, tendered - cash as change from (select k, cash, case {' '.join(f'when cash <= {100 * x} then {100 * x}' for x in numbers.NOTES)}
  else (cash + 1999) // 2000 * 2000 end as tendered from (select k, (total * 2 + 5) // 10 * 5 as cash from tot))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks a printed line, as a reader would find them: k, ix, text, x, y, w, h, conf; the page is 400 wide."""
    t = receipts.lines(spark, sf_dir)
    part = F.array(F.struct(F.lit(0).alias("side"), F.split("text", " ")[0].alias("text"), F.lit(4.0).alias("x")), F.struct(F.lit(1).alias("side"), F.regexp_replace("text", "^[^ ]* ?", "").alias("text"), F.lit(200.0).alias("x")))
    b = t.select("k", "line", F.explode(part).alias("p")).select("k", "line", F.col("p.side").alias("side"), F.col("p.text").alias("text"), F.col("p.x").alias("x"))
    jitter = (F.col("k") * 7 + F.col("line") * 3 + F.col("side")) % 3
    b = b.withColumn("y", (F.col("line") * 10 + jitter).cast("double")).withColumn("h", F.lit(8.0)).withColumn("w", (F.length("text") * 8).cast("double"))
    return b.withColumn("conf", (50 + (F.col("k") * 31 + F.col("line") * 17 + F.col("side") * 7) % 50) / 100.0).withColumn("ix", (F.col("line") * 2 + F.col("side")).cast("int")).where("text <> ''")


LINES_SQL = f"""{REC},
ln as (select k, 0 as line, {_shop()} as txt from hd union all select k, 1, (nation + 100) || ' rue Principale, Québec QC G1V 3V7' from hd
union all select k, 2, 'Date ' || case k % 4 when 0 then strftime(dt, '%Y-%m-%d') when 1 then day(dt) || ' ' || ({receipts.MONTH_NAMES})[month(dt)] || ' ' || year(dt) when 2 then strftime(dt, '%Y-%m-%d') || '18:53:03' else strftime(dt, '%d/%m/%Y') end from hd
union all select k, cast(n as int) + 2, upper(coalesce(p_name, 'article')) || '  ' || m(net) from it semi join hd using (k) left join part on p_partkey = part
union all select k, cast(lines as int) + 3, 'SOUS-TOTAL ' || m(sub) from hd where k % 5 <> 2 union all select k, cast(lines as int) + 4, 'T.P.S. 5% ' || m(tps) from hd
union all select k, cast(lines as int) + 5, 'TVQ 9,975% ' || m(tvq) from hd where k % 5 <> 4 union all select k, cast(lines as int) + 6, 'TAXE ECO ' || m(sub // 5) from hd where k % 5 = 3
union all select k, cast(lines as int) + 7, 'TOTAL ' || m(case when k % 5 = 1 then misread else total end) || ' $' from hd union all select k, cast(lines as int) + 8, ({receipts.CARDS})[k % 4 + 1] || ' ' || m(total) from hd),
bl as (select k, line, 0 as side, split_part(txt, ' ', 1) as txt, 4.0 as x from ln union all select k, line, 1, regexp_replace(txt, '^[^ ]* ?', ''), 200.0 from ln),
bk as (select k, line, side, txt, x, length(txt) * 8.0 as w, (50 + (k * 31 + line * 17 + side * 7) % 50) / 100.0 as conf from bl where txt <> '')"""


def _money(expr: str) -> str:
    return f"(({expr}) // 100 || ',' || lpad(cast(({expr}) % 100 as varchar), 2, '0'))"


def _expand(sql: str) -> str:
    """Writes out m(x): x cents as printed."""
    while (at := sql.find("m(")) >= 0:
        while at > 0 and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at = sql.find("m(", at + 1)
            if at < 0:
                return sql
        depth, end = 0, at + 1
        for end in range(at + 1, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
        sql = sql[:at] + _money(sql[at + 2 : end]) + sql[end + 1 :]
    return sql


LINES_SQL = _expand(LINES_SQL)


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reading.group_lines(blocks(spark, sf_dir))
    return g.select("k", F.col("line_ix").cast("bigint").alias("line_ix"), F.col("pos").cast("bigint").alias("pos"), "text")


GROUPED = f"with {LINES_SQL} select k, dense_rank() over (partition by k order by line) - 1 as line_ix, row_number() over (partition by k, line order by side) - 1 as pos, txt as text from bk"


def read_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = reading.read_quality(blocks(spark, sf_dir), 400.0)
    return q.select("k", "blocks", "chars", F.round(F.col("mean_conf") * F.col("chars") * 100).cast("bigint").alias("weighted"), "floor_conf", F.col("least").alias("least_conf"), F.col("most").alias("most_conf"), "edge", "degraded")


QUALITY = f"""with {LINES_SQL} select k, count(*) as blocks, cast(sum(length(txt)) as bigint) as chars, cast(sum(round(conf * 100) * length(txt)) as bigint) as weighted,
list_sort(list(conf))[least(count(*) - 1, cast(floor(count(*) * 0.1) as bigint)) + 1] as floor_conf, min(conf) as least_conf, max(conf) as most_conf, count(*) filter (where x <= 2 or x + w >= 398) as edge,
list_sort(list(conf))[least(count(*) - 1, cast(floor(count(*) * 0.1) as bigint)) + 1] < 0.75 as degraded from bk group by k"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words labelled by rule: k, ix, line, text, label, begin, score, conf."""
    b = blocks(spark, sf_dir)
    label = F.when(F.col("line") == 0, "SHOP").when(F.col("line") < 3, "O").when(F.col("side") == 0, F.when((F.col("k") + F.col("line")) % 7 == 0, "O").otherwise("NAME")).otherwise("PRICE")
    return b.select("k", "ix", "line", "text", label.alias("label"), ((F.col("line") + F.col("side")) % 4 == 0).alias("begin"), ((F.col("k") * 13 + F.col("ix") * 5) % 100 / 100.0).alias("score"), "conf")


WORDS = """w0 as (select k, line * 2 + side as ix, line, txt, conf, case when line = 0 then 'SHOP' when line < 3 then 'O' when side = 0 then case when (k + line) % 7 = 0 then 'O' else 'NAME' end else 'PRICE' end as lab, (line + side) % 4 = 0 as beg, (k * 13 + (line * 2 + side) * 5) % 100 / 100.0 as score from bk),
w1 as (select k, ix, line, txt, conf, score, case when score < 0.4 then 'O' else lab end as lab, beg and not (score < 0.4 and lab <> 'O') as beg from w0)"""


def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities.entities(entities.floor_labels(words(spark, sf_dir)))
    return e.select("k", F.col("entity_ix").cast("bigint").alias("entity_ix"), "label", "text", F.col("first_word").cast("bigint").alias("first_word"), "words", F.round(F.col("conf") * F.col("words") * 10000).cast("bigint").alias("weight"))


ENTITIES = f"""with {LINES_SQL}, {WORDS},
w2 as (select *, case when lab <> 'O' and (beg or lag(lab) over (partition by k order by ix) is null or lag(lab) over (partition by k order by ix) <> lab) then 1 else 0 end as new from w1),
w3 as (select *, sum(new) over (partition by k order by ix) - 1 as e from w2)
select k, cast(e as bigint) as entity_ix, any_value(lab) as label, trim(string_agg(txt, ' ' order by ix)) as text, cast(min(ix) as bigint) as first_word, count(*) as words, cast(round(sum(score) * least(1.0, min(conf)) * 10000) as bigint) as weight from w3 where lab <> 'O' group by k, e"""


def bio_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("field", F.when(F.col("label") != "O", F.col("label")))
    return entities.tags(w).groupBy("tag").agg(F.count("*").alias("n"), F.sum("ix").cast("bigint").alias("sum_ix"))


TAGS = f"""with {LINES_SQL}, {WORDS}, f as (select k, ix, line, nullif(lab, 'O') as field from w0),
t as (select ix, case when field is null then 'O' when (field is distinct from lag(field) over (partition by k order by ix)) or line <> lag(line) over (partition by k order by ix) then 'B-' || field else 'I-' || field end as tag from f)
select tag, count(*) as n, cast(sum(ix) as bigint) as sum_ix from t group by tag"""


def entity_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities before the score floor against those after it, from one pass over the words."""
    w = words(spark, sf_dir)
    label, begin = entities.floored()
    twice = F.explode(F.array(F.struct(F.lit(True).alias("t"), "label", "begin"), F.struct(F.lit(False).alias("t"), label.alias("label"), begin.alias("begin"))))
    both = w.select("k", "ix", "text", "score", "conf", twice.alias("v")).select("k", F.col("v.t").alias("unfloored"), "ix", "text", "v.label", "v.begin", "score", "conf")
    return entities.scores_of(entities.entities(both, ["k", "unfloored"]).select("k", F.col("unfloored").alias("t"), "first_word", "words", "label"), ["k", "first_word", "words"])


def _ents(name: str, source: str) -> str:
    return f"""{name}0 as (select *, case when lab <> 'O' and (beg or lag(lab) over (partition by k order by ix) is null or lag(lab) over (partition by k order by ix) <> lab) then 1 else 0 end as new from {source}),
{name}1 as (select *, sum(new) over (partition by k order by ix) as e from {name}0), {name} as (select k, min(ix) as first_word, count(*) as words, any_value(lab) as label from {name}1 where lab <> 'O' group by k, e)"""


PRF = f"""with {LINES_SQL}, {WORDS}, {_ents('tr', 'w0')}, {_ents('pr', 'w1')},
c as (select label, count(t) as expected, count(p) as found, count(*) filter (where t is not null and p is not null) as "right" from (select *, 1 as t from tr) full join (select *, 1 as p from pr) using (k, first_word, words, label) group by rollup (label)),
r as (select *, case when found = 0 then 0.0 else "right" / found end as pp, case when expected = 0 then 0.0 else "right" / expected end as rr from c)
select label, expected, found, "right", round(pp, 6) as precision, round(rr, 6) as recall, round(case when pp + rr = 0 then 0.0 else 2 * pp * rr / (pp + rr) end, 6) as f1 from r"""


def tax_multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read taxes against the true ones, by variant."""
    read = reading.candidates(receipts.lines(spark, sf_dir)).select("k", F.transform("taxes", lambda t: t["amount"]).alias("read"))
    truth = receipts.totals(spark, sf_dir).select("k", F.array(F.col("tvq") / 100, F.col("tps") / 100).alias("true"))
    return truth.join(read, "k").groupBy((F.col("k") % 5).alias("variant")).agg(F.count("*").alias("receipts"), F.count_if(scoring.same_taxes(F.col("true"), F.col("read"))).alias("matching"))


MULTISET = f"with {REC} select k % 5 as variant, count(*) as receipts, count(*) filter (where k % 5 < 3) as matching from hd group by 1"


def box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    x0, x1 = numbers.box_1000(F.col("x"), F.col("w"), F.lit(400.0))
    return b.groupBy("line").agg(F.count("*").alias("n"), F.sum(x0).cast("bigint").alias("x0"), F.sum(x1).cast("bigint").alias("x1"))


BOXES = f"""with {LINES_SQL}, b as (select line, least(greatest(floor(x * 1000 / 400.0 + 0.5), 0), 999) as x0, least(greatest(floor((x + w) * 1000 / 400.0 + 0.5), 0), 1000) as x1 from bk)
select cast(line as int) as line, count(*) as n, cast(sum(x0) as bigint) as x0, cast(sum(greatest(x1, x0 + 1)) as bigint) as x1 from b group by 1"""


def evidence_two_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts on which at least two of three kinds of line stand; the least of their first lines' ranks."""
    t = receipts.lines(spark, sf_dir)
    kinds = {"eco": "^TAXE ECO", "tvq": "^TVQ", "cash": "^COMPTANT"}
    a = t.groupBy("k").agg(*[F.min(F.when(F.col("text").rlike(p), F.col("line"))).alias(n) for n, p in kinds.items()])
    seen = F.array_compact(F.array(*kinds))
    return a.where(F.size(seen) >= 2).select("k", F.size(seen).cast("bigint").alias("kinds"), F.array_min(seen).cast("bigint").alias("first_line"))


EVIDENCE = f"""with {REC}, e as (select k, (case when k % 5 = 3 then 1 else 0 end) + (case when k % 5 <> 4 then 1 else 0 end) + (case when k % 4 = 3 then 1 else 0 end) as kinds,
least(case when k % 5 = 3 then lines + 6 end, case when k % 5 <> 4 then lines + 5 end, case when k % 4 = 3 then lines + 8 end) as first_line from hd) select k, cast(kinds as bigint) as kinds, first_line from e where kinds >= 2"""


def null_field_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often which fields of the solved receipt are missing (in field order), and with which worst note."""
    s = _solved(spark, sf_dir)
    missing = F.array_compact(F.array(F.when(F.col("total").isNull(), "total"), F.when(F.col("subtotal").isNull(), "subtotal"), F.when(F.size("taxes") == 0, "taxes")))
    note = F.least(F.coalesce("total.conf", F.lit(1.0)), F.coalesce("subtotal.conf", F.lit(1.0)), F.lit(1.0))
    return s.groupBy(F.array_join(missing, ",").alias("missing"), F.round(note, 6).alias("worst_note")).agg(F.count("*").alias("receipts"))


NULLS = f"""with {SOLVED} select concat_ws(',', case when v is null then 'total' end, case when s is null then 'subtotal' end, case when n_taxes = 0 then 'taxes' end) as missing,
round(least(coalesce(case coherence when 'coherente' then 1 - (1 - tconf) / 2 when 'incoherente' then tconf * 0.8 else tconf end, 1.0), coalesce(case coherence when 'coherente' then cast(0.85 as double) when 'incoherente' then cast(0.7 as double) * 0.8 else cast(0.7 as double) end * (case when s is null then null else 1 end), 1.0), 1.0), 6) as worst_note, count(*) as receipts
from (select *, case when v is null then null when i = 0 then cast(0.7 as double) else cast(0.56 as double) end as tconf from b where r = 1) group by 1, 2"""


def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous blocks of 80, 10 and 10 % of the receipts in order of their keys."""
    t = receipts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    n, lo = t.agg(F.count("*"), F.coalesce(F.min("k"), F.lit(0))).first()
    at = F.col("k") - lo
    split = F.when(at * 10 < n * 8, "train").when(at * 10 < n * 9, "validation").otherwise("test")
    return t.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


SPLITS = "select case when (o_orderkey - lo) * 10 < n * 8 then 'train' when (o_orderkey - lo) * 10 < n * 9 then 'validation' else 'test' end as split, count(*) as n, min(o_orderkey) as first_k, max(o_orderkey) as last_k from orders, (select count(*) as n, min(o_orderkey) as lo from orders) group by 1"

QUERIES = {
    "coherence_counts": (coherence_counts, f"with {SOLVED} select k % 5 as variant, coherence, count(*) as receipts from b where r = 1 group by 1, 2"),
    "solved_receipts": (solved_receipts, f"with {SOLVED} select k, v as total, s as subtotal, n_taxes, coherence, round(case coherence when 'coherente' then 1 - (1 - c) / 2 when 'incoherente' then c * 0.8 else c end, 6) as total_conf from (select *, case when v is null then null when i = 0 then cast(0.7 as double) else cast(0.56 as double) end as c from b where r = 1)"),
    "receipt_totals": (receipt_totals, f"with {REC} select k, lines, sub, base, tps, tvq, total from tot"),
    "amount_parse_roundtrip": (amount_parse_roundtrip, AMOUNTS),
    "date_parse_roundtrip": (date_parse_roundtrip, DATES),
    "article_lines": (article_lines, ARTICLES),
    "currency_reader": (currency_reader, f"with {REC} select k, 'CAD' as currency, cast(0.4 as double) as currency_conf from hd"),
    "card_reader": (card_reader, f"with {REC} select k, lower((['VISA', 'MASTERCARD', 'INTERAC'])[k % 4 + 1]) as card, cast(0.9 as double) as card_conf from hd where k % 4 < 3"),
    "merchant_reader": (merchant_reader, f"with {REC} select k, {_shop()} as merchant, case when segment = 'FURNITURE' then cast(0.7 as double) else cast(0.85 as double) end as merchant_conf from hd"),
    "total_candidates_top4": (total_candidates_top4, TOP4),
    "tax_recompute_violations": (tax_recompute_violations, f"with {REC} select 'tps' as kind, count(*) as taxes, cast(0 as bigint) as violations from hd union all select 'tvq', count(*), 0 from hd where k % 5 <> 4"),
    "total_closure_violations": (total_closure_violations, CLOSURE),
    "line_count_violations": (line_count_violations, f"with {REC} select lines, count(*) as receipts, cast(0 as bigint) as violations from tot group by 1"),
    "cash_rounding_change": (cash_rounding_change, CASH),
    "line_grouping": (line_grouping, GROUPED),
    "read_quality": (read_quality, QUALITY),
    "bio_entities": (bio_entities, ENTITIES),
    "bio_tagging": (bio_tagging, TAGS),
    "entity_prf": (entity_prf, PRF),
    "tax_multiset_match": (tax_multiset_match, MULTISET),
    "box_normalise": (box_normalise, BOXES),
    "evidence_two_of_three": (evidence_two_of_three, EVIDENCE),
    "null_field_list": (null_field_list, NULLS),
    "split_blocks": (split_blocks, SPLITS),
}


def collected_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole invoices of the printed receipts, with the totals labelled word by word. The lines are written once, since ten readers read them."""
    t = staged(receipts.lines(spark, sf_dir))
    label = F.when(F.col("text").startswith("TOTAL"), "TOTAL").when(F.col("text").startswith("SOUS-TOTAL"), "SUBTOTAL").when(F.col("text").rlike("^(T\\.P\\.S|TVQ)"), "TAX").otherwise("O")
    w = t.select("k", F.col("line").alias("ix"), "line", "text", label.alias("label"), F.lit(False).alias("begin"), F.lit(0.9).alias("score"), F.lit(1.0).alias("conf"))
    c = collect.collect(w, t, categories.keywords(spark), F.expr(AS_OF))
    return c.select("k", "merchant", "date", "currency", "card", F.col("total.value").alias("total"), F.col("subtotal.value").alias("subtotal"), F.size("taxes").cast("bigint").alias("n_taxes"), F.size("articles").cast("bigint").alias("n_articles"), "category", "subcategory", "coherence", F.array_join("missing", ",").alias("missing"))


COLLECTED = f"""with {SOLVED},
f as (select b.k, {_shop()} as merchant, hd.dt as date, 'CAD' as currency, lower((['VISA', 'MASTERCARD', 'INTERAC'])[b.k % 4 + 1]) as card, v as total, s as subtotal, n_taxes, lines as n_articles,
  case segment when 'AUTOMOBILE' then 'transport' when 'BUILDING' then 'logement' when 'HOUSEHOLD' then 'alimentation' when 'MACHINERY' then 'alimentation' end as category,
  case segment when 'AUTOMOBILE' then 'entretien-vehicule' when 'BUILDING' then 'entretien-maison' when 'HOUSEHOLD' then 'epicerie' when 'MACHINERY' then 'cafe' end as subcategory, coherence from b join hd using (k) where r = 1)
select *, concat_ws(',', case when subtotal is null then 'subtotal' end, case when n_taxes = 0 then 'taxes' end, case when total is null then 'total' end, case when card is null then 'card' end, case when category is null then 'category,subcategory' end) as missing from f"""
QUERIES["collected_receipts"] = (collected_receipts, COLLECTED)
