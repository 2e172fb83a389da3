"""Virtual receipts over the star schema: what a till would have printed for each order.

All amounts are whole cents, so any engine gets the same ones. Lines are text again, for the
readers; each has a box on a page of 40 columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name of the shop by market segment: the printed header.
SHOPS = {"AUTOMOBILE": "Garage Boréal", "BUILDING": "Quincaillerie du Coin", "FURNITURE": "Meubles Lavoie", "HOUSEHOLD": "Épicerie Saint-Roch", "MACHINERY": "Café de la Gare"}
#: Years by which receipts are younger than their orders: a till of this century, and leap days stay.
YEARS_ON = 28
CARDS = ["VISA", "MASTERCARD", "INTERAC", "COMPTANT"]
MONTH_NAMES = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, part, supp, qty, gross, disc, net (cents), taxable, and ``at``: what the items of an order are sorted by."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), at.alias("at"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("gross"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"), (F.col("l_tax") > 0).alias("taxable"),
    )
    return rows.withColumn("net", F.expr("(gross * (100 - disc) + 50) div 100"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k (order), n (place), part, supp, qty, gross, disc, net (cents), taxable."""
    rows = _priced(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    return rows.select("k", "n", "part", "supp", "qty", "gross", "disc", "taxable", "net")


def _with_taxes(t: DataFrame) -> DataFrame:
    t = t.withColumn("tps", F.expr("(base * 5 + 50) div 100")).withColumn("tvq", F.expr("(base * 9975 + 50000) div 100000"))
    return t.withColumn("total", F.col("sub") + F.col("tps") + F.col("tvq"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, lines, sub, base, tps, tvq, total (cents) of orders with lines."""
    return _with_taxes(_priced(spark, sf_dir).groupBy("k").agg(F.count("*").alias("lines"), F.sum("net").alias("sub"), F.coalesce(F.sum(F.when(F.col("taxable"), F.col("net"))), F.lit(0)).cast("bigint").alias("base")))


def money(cents: Column, point: str = ",") -> Column:
    """Cents as printed: two decimals."""
    a = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit(point), F.lpad((a % 100).cast("string"), 2, "0"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines and what is printed about them: k, shop, day, totals, misread total."""
    return _headed(spark, sf_dir, totals(spark, sf_dir))


def _headed(spark: SparkSession, sf_dir: str, sums: DataFrame) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey"), F.add_months(F.col("o_orderdate").cast("date"), 12 * YEARS_ON).alias("day"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("misread"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return sums.join(orders.join(customer, "o_custkey").drop("o_custkey"), "k")


def printed_day() -> Column:
    """The day in one of four forms, by order."""
    d = F.col("day")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(d))
    return (
        F.when(F.col("k") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("k") % 4 == 1, F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), month, F.lit(" "), F.year(d).cast("string")))
        .when(F.col("k") % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("18:53:03"))).otherwise(F.date_format(d, "dd/MM/yyyy"))
    )


def _line(line: Column, text: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), text.alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines: k, line (from 0), text.

    Order k mod 5 says what is wrong: 1 total misread, 2 no sub-total, 3 a fee of 20 % that
    looks like a tax, 4 no TVQ line.
    """
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    # Only what an item is sorted by goes over the network; its price and tax are worked out from it where the items of an order are together.
    sold = _priced(spark, sf_dir).select("k", "at", F.col("at.l_partkey").alias("part")).join(names, "part", "left")
    bags = sold.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("sold"))
    gross, disc = (lambda x, c=c: F.round(x["at"][c] * 100).cast("bigint") for c in ("l_extendedprice", "l_discount"))
    net = lambda x: F.call_function("div", gross(x) * (100 - disc(x)) + 50, F.lit(100))
    bags = bags.select("k", F.size("sold").alias("lines"), F.transform("sold", lambda x: F.struct(x["name"].alias("name"), net(x).alias("net"), (x["at"]["l_tax"] > 0).alias("taxable"))).alias("sold"))
    known = F.transform(F.filter("sold", lambda x: x["net"].isNotNull()), lambda x: F.struct(x["net"].alias("net"), F.when(x["taxable"], x["net"]).otherwise(0).alias("due")))
    sum_of = lambda c: F.aggregate("known", F.lit(0).cast("bigint"), lambda s, x: s + x[c])
    bags = bags.withColumn("known", known).withColumn("sub", F.when(F.size("known") > 0, sum_of("net"))).withColumn("base", sum_of("due")).drop("known")
    head = _headed(spark, sf_dir, _with_taxes(bags))
    shop = F.element_at(F.create_map(*[F.lit(x) for pair in SHOPS.items() for x in pair]), F.col("segment"))
    card = F.element_at(F.array(*[F.lit(c) for c in CARDS]), (F.col("k") % 4 + 1).cast("int"))
    v, n = F.col("k") % 5, F.col("lines").cast("int")
    shown = F.when(v == 1, F.col("misread")).otherwise(F.col("total"))
    body = F.transform("sold", lambda x, i: _line(i + 3, F.concat(F.upper(F.coalesce(x["name"], F.lit("article"))), F.lit("  "), money(x["net"]))))
    rows = F.array(
        _line(F.lit(0), shop),
        _line(F.lit(1), F.concat((F.col("nation") + 100).cast("string"), F.lit(" rue Principale, Québec QC G1V 3V7"))),
        _line(F.lit(2), F.concat(F.lit("Date "), printed_day())),
        _line(n + 3, F.when(v != 2, F.concat(F.lit("SOUS-TOTAL "), money(F.col("sub"))))),
        _line(n + 4, F.concat(F.lit("T.P.S. 5% "), money(F.col("tps")))),
        _line(n + 5, F.when(v != 4, F.concat(F.lit("TVQ 9,975% "), money(F.col("tvq"))))),
        _line(n + 6, F.when(v == 3, F.concat(F.lit("TAXE ECO "), money(F.expr("sub div 5"))))),
        _line(n + 7, F.concat(F.lit("TOTAL "), money(shown), F.lit(" $"))),
        _line(n + 8, F.concat(card, F.lit(" "), money(F.col("total")))),
    )
    return head.select("k", F.explode(F.concat(rows, body)).alias("r")).select("k", "r.line", "r.text").where("text is not null")
