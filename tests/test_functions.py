import pytest
from pyspark.sql import functions as F

from sedimark.functions import numbers, text

AMOUNTS = [
    ("8,91", 8.91), ("$12.00", 12.0), ("$10.2", 10.2), ("RABAIS -2,50", -2.5), ("TOTAL 38, 23", 38.23), ("TPS 5% 0,39", 0.39), ("1.5 KG @ 4,39/KG 6,59", 6.59),
    ("TOTAL 1 234,56", 1234.56), ("TOTAL 1 234.56", 1234.56), ("TOTAL 1,234.56", 1234.56), ("TOTAL 1.234,56", 1234.56), ("TOTAL 12,345.67", 12345.67),
    ("TEL 418-527-9444", None), ("18:53:03", None), ("TVQ 9,975%", None), ("CARTE 4834-8741", None), ("TEL 418.527.9444", None), ("TOTAL 1,234", None), ("TOTAL 1\u00a0234,56", 1234.56), ("4834-8741,00", None), ("RABAIS 10,5%", 10.5), ("", None), (None, None),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("t"))).collect())] if values else []


def test_amounts(spark):
    assert column(spark, [a for a, _ in AMOUNTS], numbers.amount) == [b for _, b in AMOUNTS]


def test_text(spark):
    assert column(spark, ["Éçà ŒÑ", None], text.fold) == ["eca œn", None]
    assert column(spark, ["L'Été  42!"], text.compact) == ["lete42"]
    assert column(spark, ["Tim's Café-Bar"], text.brand_words) == [["tims", "cafe", "bar"]]
    assert column(spark, ["www.chez-nous.com", "https://www.facebook.com/x", "info@shop.ca"], text.site_name) == ["chez-nous", None, None]
    assert column(spark, ["SaTTEMKEsYaAMGR", "aBcD", "McDonald", "Ste-Foy McDonald"], text.erratic_case) == [True, True, False, False]
    assert column(spark, ["aa bb cccc d"], lambda c: text.wrap(c, 5)) == [["aa bb", "cccc", "d"]]
    assert column(spark, ["100 rue Principale", "G1V 3V7", "Bonjour", "CAFE 12 rue"], text.address) == [True, True, False, False]
    assert column(spark, ["a b c d"], lambda c: text.ngrams(F.split(c, " "), 3)) == [["a b c", "b c d"]]
    assert column(spark, ["a b"], lambda c: text.ngrams(F.split(c, " "), 3)) == [[]]
    df = spark.createDataFrame([("T.P.S.", 0.09975), ("TPS/TVQ", 0.09975), ("FRAIS GST-X", None), ("x", 0.05)], "n string, r double")
    assert [r[0] for r in df.select(numbers.tax_kind(F.col("n"), F.col("r"))).collect()] == ["tps", "tvq", None, "tps"]


def test_cash(spark):
    df = spark.createDataFrame([(1002,), (1003,), (9998,)], "c bigint").select(numbers.cash_cents(F.col("c")))
    assert [r[0] for r in df.collect()] == [1000, 1005, 10000]


def test_boxes(spark):
    lo, hi = numbers.box_1000(F.lit(399.9), F.lit(0.0), F.lit(400.0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (999, 1000)


def test_words(spark):
    from sedimark.functions import words

    keys = ["tims", "depanneur", "cafe"]
    assert column(spark, ["cheztims cafe"], lambda c: words.unglue(F.split(c, " "), keys)) == [["chez", "tims", "cafe"]]
    assert column(spark, ["depan neur cafe", "de panneur"], lambda c: words.glue(F.split(c, " "), keys)) == [["depanneur", "cafe"], ["de", "panneur"]]
    got = column(spark, ["ab  cd ab"], lambda c: words.word_boxes(c, F.lit(0.0), F.lit(90.0)))[0]
    assert [(r.text, r.x, r.w) for r in got] == [("ab", 0.0, 20.0), ("cd", 40.0, 20.0), ("ab", 70.0, 20.0)]


def test_filled_fields(spark):
    from sedimark.operators import stages

    df = spark.createDataFrame([("a", "", [1], None)], "a string, b string, c array<int>, d int")
    assert stages.filled_fields(df, ["a", "b", "c", "d"]).select("filled", "fields").first()[:] == (2, 4)


def test_amounts_of_lines_by_two_patterns(spark):
    """The amounts of random lines, by the engine's pattern and by that of its SQL."""
    import random

    import duckdb
    import pandas as pd

    from sedimark.plans.more_queries import LAST_AMOUNT, LINE_CENTS

    rng = random.Random(7)
    lines = ["".join(rng.choice("0123456789012345 .,.,--ax_ é\t$%") for _ in range(rng.randint(0, 24))) for _ in range(20_000)]
    lines += ["3-4-5.00", "---5.00", "12.50-13.00", "5-1 234,00", "a5.00b", "TVQ 9,975%", "", "-1.234,5", "1.2.3.4"]
    rows = pd.DataFrame({"i": range(len(lines)), "line": lines})
    got = {r.i: r.c for r in spark.createDataFrame(rows).select("i", F.round(numbers.amount(F.col("line")) * 100).cast("bigint").alias("c")).collect()}
    want = dict(duckdb.connect().execute(f"select i, case when m is not null then {LINE_CENTS} end from (select i, {LAST_AMOUNT} as m from rows)").fetchall())
    assert [(lines[i], got[i], want[i]) for i in got if got[i] != want[i]] == [] and sum(v is not None for v in got.values()) > 2000


def test_amounts_of_texts(spark):
    rows = [("a", "x 1,50\n2,00 3,00\nnone\n-4.5"), ("b", ""), ("c", None), ("d", "7,25 " * 20_000)]
    got = {r.d: list(r.a) for r in spark.createDataFrame(rows, "d string, t string").select("d", numbers.line_amounts(F.col("t")).alias("a")).collect()}
    assert got == {"a": [1.5, 3.0, -4.5], "b": [], "c": [], "d": [7.25]}
