"""Amounts, rates, quantities, boxes and confidences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE

# An amount has one or two decimals; thousands may be set off by a space, point or comma; the
# minus counts unless a digit or another minus stands before it.
AMOUNT = f"(?<![\\d-])-?\\d{{1,3}}(?:[{SPACE},.]?\\d{{3}})*[.,][{SPACE}]?\\d{{1,2}}(?!\\d)"
CLOSE = 0.02 + 1e-6
TPS_RATE, TVQ_RATE = 0.05, 0.09975


def amount(text: Column) -> Column:
    """The last amount in a text, else null. Its last separator is that of the cents."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), F.lit(-1))
    plain = F.regexp_replace(F.regexp_replace(last, f"[{SPACE}]", ""), "[.,](?=.*[.,])", "")
    return F.when(text.rlike("\\d[.,]"), F.translate(plain, ",", ".").try_cast("double"))


def line_amounts(text: Column) -> Column:
    """The amounts of a text's lines, in order, of each the last one; lines without one give none, a null text no line."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), amount), lambda a: a.isNotNull())


def rate(text: Column) -> Column:
    """The first percentage as a fraction; null without one or outside 0 to 1."""
    found = F.regexp_extract(text, "(\\d+(?:[.,]\\d+)?)\\s*%", 1)
    value = F.regexp_replace(found, ",", ".").try_cast("double") / 100
    return F.when((value >= 0) & (value <= 1), value)


def quantity(text: Column) -> Column:
    """The first number, null unless above zero."""
    value = F.regexp_replace(F.regexp_extract(text, "(\\d+(?:[.,]\\d+)?)", 1), ",", ".").try_cast("double")
    return F.when(value > 0, value)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once each, however often what follows asks for them.

    Projections would be merged with later filters and projections, which repeats costly expressions.
    """
    for name, column in columns.items():
        rows = rows.select("*", F.explode(F.array(column)).alias(name))
    return rows


def near(a: Column, b: Column) -> Column:
    """Equal for the purposes of a balance."""
    return F.abs(a - b) <= CLOSE


def same_cents(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.005


def tax_kind(name: Column, tax_rate: Column) -> Column:
    """tps or tvq by the printed name, else by the rate; null for others."""
    plain = F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "\\.", ""))
    return (
        F.when(plain.isin("TPS", "GST"), "tps").when(plain.isin("TVQ", "QST"), "tvq")
        .when(F.abs(tax_rate - TPS_RATE) < 1e-4, "tps").when(F.abs(tax_rate - TVQ_RATE) < 1e-4, "tvq")
    )


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up (also below zero)."""
    return F.floor(x + 0.5)


def box_1000(lo: Column, extent: Column, full: Column) -> tuple[Column, Column]:
    """Both ends of an extent on a scale of 0 to 1000, the second above the first."""
    clamp = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    first = clamp(half_up(lo * 1000 / full), 0, 999)
    return first, F.greatest(clamp(half_up((lo + extent) * 1000 / full), 0, 1000), first + 1)


def adjusted(confidence: Column, coherence: Column) -> Column:
    """Confidence after the balance is known."""
    return F.when(coherence == "coherente", 1 - (1 - confidence) / 2).when(coherence == "incoherente", confidence * 0.8).otherwise(confidence)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 1 where b is 0."""
    return F.when(b == 0, 1.0).otherwise(a / F.when(b != 0, b))


def cash_cents(cents: Column) -> Column:
    """Whole cents rounded to five, halves up."""
    return F.floor((cents + 2.5) / 5).cast("bigint") * 5


def cents_of(whole: Column, of: int) -> Column:
    """whole / of to the nearest whole number, halves up, in whole numbers alone (not negative)."""
    return F.floor((whole * 2 + of) / (2 * of)).cast("bigint")


# What is handed over for an amount in cash, in dollars; beyond, the next multiple of twenty.
NOTES = [5, 10, 20, 40, 50, 60, 80, 100, 120, 140, 160, 200, 300, 500]


def tendered(cents: Column) -> Column:
    """What a customer hands over for a sum in cash."""
    notes = F.array(*[F.lit(100 * x).cast("bigint") for x in NOTES])
    return F.coalesce(F.array_min(F.filter(notes, lambda x: x >= cents)), F.ceil(cents / 2000).cast("bigint") * 2000)
