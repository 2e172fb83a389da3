"""Reading receipts: readable blocks, lines, read quality, candidates, articles and fields.

Frames are keyed by a document column ``k``; a document is small, so its lines, words and
blocks may be arrays. Every grouping is by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from . import brands
from .solver import READ, TAX

# What receipt lines say, in lower case.
NOT_A_TOTAL = ["sous", "sub", "valeur", "economie", "epargne"]
TOTAL_WORDS, AMOUNT_WORDS = ["total"], ["montant", "amount"]
SUBTOTAL_WORDS = ["sous-total", "sous total", "soustotal", "subtotal", "sub-total", "sub total"]
TAX_WORDS = "(?i)(?<![A-Za-z0-9_])(T\\.?P\\.?S|T\\.?V\\.?Q|TVH|GST|PST|QST|HST|TVA|TAXES?|TAX)(?![A-Za-z0-9_])"
PAYMENT_WORDS = ["total", "montant", "solde", "balance", "paiement", "payment", "monnaie", "change", "approuv", "credit", "debit", "visa", "master", "amex", "interac", "rabais", "remise", "discount", "economie", "epargne", "vente", "carte de"]
CARDS = ["visa", "mastercard", "amex", "interac"]
PAID_WORDS = ["comptant", "cash"]
# Payment cards as printed, and words around a payment.
CARD_BRANDS = [("(?i)\\bVISA\\b", "visa"), (f"(?i)\\bMASTER[{text.SPACE}]?CARD\\b", "mastercard"), (f"(?i)\\bAMEX\\b|\\bAMERICAN[{text.SPACE}]+EXPRESS\\b", "amex"), ("(?i)\\bINTERAC\\b", "interac")]
PAYMENT_CONTEXT = "(?i)carte|card|credit|debit|paiement|payment"
# Currencies and what speaks of Canada.
CURRENCY_CODE = "\\b(CAD|USD|EUR|GBP)\\b"
SYMBOLS = [("US\\$", "USD"), ("€", "EUR"), ("£", "GBP")]
CANADIAN = f"(?i)\\b(T\\.?P\\.?S|T\\.?V\\.?Q|GST|QST|HST|TVH)\\b|\\b[A-Z]\\d[A-Z][{text.SPACE}]?\\d[A-Z]\\d\\b|\\b(RT|TQ)[{text.SPACE}]?0001\\b"
#: Lines in which the shop's name is looked for.
HEAD_LINES = 12


def line_conf(lines: DataFrame) -> Column:
    """How sure the reading of a line is: its ``conf``, 1 without such a column, at most 1."""
    return F.least(F.lit(1.0), F.col("conf").cast("double")) if "conf" in lines.columns else F.lit(1.0)


def _has(line: Column, words: list[str]) -> Column:
    return F.lower(line).rlike("|".join(w.replace("/", "\\/") for w in words))


def readable(blocks: DataFrame, text_column: str = "text") -> DataFrame:
    """Blocks with something in them."""
    return blocks.where(F.trim(F.col(text_column)) != "")


def condense(blocks: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents as they were seen into (blocks with their lines, one row of figures a document).

    The figures are those of ``read_quality`` over readable blocks, mute (blocks without a text) and error: ``no_text`` where no
    block is readable, ``weak`` where a tenth of the blocks was read too badly, else null. A document without
    readable blocks has no lines.
    """
    seen = blocks.groupBy("k").agg(F.count_if(F.trim(F.col("text")) == "").alias("mute"))
    full = readable(blocks)
    figures = seen.join(read_quality(full, width), "k", "left")
    error = F.when(F.col("blocks").isNull(), "no_text").when(F.col("degraded"), "weak")
    return group_lines(full), figures.withColumn("error", error)


def group_lines(blocks: DataFrame) -> DataFrame:
    """Blocks (k, ix, text, x, y, w, h, conf) with their line: in order of y, a block opens a line unless it overlaps
    the line's first block by half the smaller height; line_ix from 0, pos by x.

    The anchor is a line's first block, so this is a fold over the document's blocks.
    """
    packed = blocks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("y", "ix", "x", "w", "h", "conf", "text"))).alias("b"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("height"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, b: Column) -> Column:
        overlap = F.least(acc["top"] + acc["height"], b["y"] + b["h"]) - F.greatest(acc["top"], b["y"])
        same = (acc["line"] >= 0) & (overlap >= 0.5 * F.least(acc["height"], b["h"]))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, acc["top"]).otherwise(b["y"]).alias("top"), F.when(same, acc["height"]).otherwise(b["h"]).alias("height"), F.concat(acc["of"], F.array(line)).alias("of"))

    packed = packed.withColumn("of", F.aggregate("b", start, step, lambda acc: acc["of"]))
    rows = packed.select("k", F.explode(F.arrays_zip("b", "of")).alias("z")).select("k", F.col("z.of").alias("line_ix"), "z.b.*")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("k", "line_ix").orderBy("x", "ix")) - 1)


def line_texts(grouped: DataFrame) -> DataFrame:
    """k, line_ix, text (joined by x), conf (least, at most 1)."""
    rows = grouped.groupBy("k", "line_ix").agg(F.array_sort(F.collect_list(F.struct("x", "ix", "text"))).alias("b"), F.least(F.lit(1.0), F.min("conf")).alias("conf"))
    return rows.select("k", "line_ix", F.trim(F.array_join(F.transform("b", lambda b: b["text"]), " ")).alias("text"), "conf")


def read_quality(blocks: DataFrame, width: float) -> DataFrame:
    """Per document: blocks, chars, weighted mean, floor (the tenth from below), least and greatest confidence, blocks at the edge, degraded."""
    at_edge = (F.col("x") <= 2) | (F.col("x") + F.col("w") >= width - 2)
    q = blocks.groupBy("k").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(F.col("conf") * F.length("text")).alias("weighted"),
        F.array_sort(F.collect_list("conf")).alias("confs"), F.min("conf").alias("least"), F.max("conf").alias("most"), F.count_if(at_edge).alias("edge"),
    )
    floor = F.element_at("confs", (F.least(F.size("confs") - 1, F.floor(F.size("confs") * 0.1)) + 1).cast("int"))
    return q.select("k", "blocks", "chars", F.coalesce(F.col("weighted") / F.nullif("chars", F.lit(0)), F.lit(0.0)).alias("mean_conf"), floor.alias("floor_conf"), "least", "most", "edge", (floor < 0.75).alias("degraded"))


def _read(order: list[Column], conf: Column) -> Column:
    return F.struct(*order, F.struct(F.col("amount").alias("value"), conf.cast("double").alias("conf"), F.col("line").cast("int").alias("line")).alias("r"))


def candidates(lines: DataFrame) -> DataFrame:
    """k, totals, subtotals, taxes: what the lines (k, line, text) offer the solver, the surest first.

    Totals: lines that say total, then amount, from the foot; then what was paid. An excluded
    word anywhere in a line keeps it out. Taxes: lines with a tax word, from the top.
    """
    t = numbers.once(lines.select("k", "line", "text", line_conf(lines).alias("sure")), amount=numbers.amount(F.col("text"))).where("amount is not null")
    t = t.withColumn("out", _has(F.col("text"), NOT_A_TOTAL)).withColumn("tier", F.when(~F.col("out") & _has(F.col("text"), TOTAL_WORDS), 0).when(~F.col("out") & _has(F.col("text"), AMOUNT_WORDS), 1).when(_has(F.col("text"), CARDS), 2).when(_has(F.col("text"), PAID_WORDS), 3))
    t = t.withColumn("sub", _has(F.col("text"), SUBTOTAL_WORDS)).withColumn("tax", F.col("text").rlike(TAX_WORDS) & ~_has(F.col("text"), TOTAL_WORDS))
    tax = F.struct("line", F.struct(F.regexp_extract("text", TAX_WORDS, 1).alias("name"), numbers.rate(F.col("text")).alias("rate"), F.col("amount").alias("amount"), (F.col("sure") * 0.7).alias("conf"), F.col("line").cast("int").alias("line")).alias("r"))
    conf = F.col("sure") * F.when(F.col("tier") < 2, 0.7).otherwise(0.7 * 0.8)
    out = t.groupBy("k").agg(
        F.array_sort(F.collect_list(F.when(F.col("tier").isNotNull(), _read([F.col("tier"), (-F.col("line")).alias("down")], conf)))).alias("totals"),
        F.array_sort(F.collect_list(F.when(F.col("sub"), _read([(-F.col("line")).alias("down")], F.col("sure") * 0.7)))).alias("subtotals"),
        F.array_sort(F.collect_list(F.when(F.col("tax"), tax))).alias("taxes"),
    )
    inner = lambda c: F.transform(c, lambda x: x["r"])
    return out.select("k", inner("totals").cast(f"array<{READ}>").alias("totals"), inner("subtotals").cast(f"array<{READ}>").alias("subtotals"), inner("taxes").cast(f"array<{TAX}>").alias("taxes"))


def not_an_article(line: Column) -> Column:
    """Speaks of payment, a discount, a total or a tax."""
    return F.lower(line).rlike("|".join(PAYMENT_WORDS)) | line.rlike(TAX_WORDS)


def articles(lines: DataFrame) -> DataFrame:
    """k, line, label, amount of lines that look like articles without labels: an amount, a name, not a payment, tax or total."""
    t = F.col("text")
    other = not_an_article(t) | _has(t, AMOUNT_WORDS) | F.lower(t).rlike(f"\\b({'|'.join(PAID_WORDS)})\\b")
    named = F.trim(F.regexp_replace(t, numbers.AMOUNT + ".*$", ""))
    rows = numbers.once(lines.where(~other).select("k", "line", "text"), amount=numbers.amount(t))
    return rows.select("k", "line", named.alias("label"), "amount").where("amount is not null and label <> ''")


def labelled_articles(words: DataFrame) -> DataFrame:
    """k, line, label, quantity, unit_price, amount, conf of lines with words labelled PRICE.

    words: k, ix, line, text, label, score, conf. The name is the NAME words, or those without a label; COUNT and
    UNIT give quantity and unit price; conf is the least product of score and confidence of all these words.
    """
    of = lambda *labels: F.array_sort(F.collect_list(F.when(F.col("label").isin(*labels), F.struct("ix", "text"))))
    told = F.col("label").isin("NAME", "COUNT", "UNIT", "PRICE")
    rows = words.groupBy("k", "line").agg(
        F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("all"), of("PRICE").alias("price"), of("NAME").alias("name"), of("O").alias("rest"), of("COUNT").alias("count"), of("UNIT").alias("unit"),
        F.least(F.lit(1.0), F.min(F.when(told, F.col("score") * F.col("conf")))).alias("conf"),
    )
    line = lambda c: F.trim(F.array_join(F.transform(c, lambda x: x["text"]), " "))
    rows = numbers.once(rows.where(F.size("price") > 0), amount=numbers.amount(line("price")))
    label = F.when(F.size("name") > 0, line("name")).otherwise(line("rest"))
    rows = rows.where(F.col("amount").isNotNull() & ~not_an_article(line("all")))
    return rows.select("k", "line", label.alias("label"), numbers.quantity(line("count")).alias("quantity"), numbers.amount(line("unit")).alias("unit_price"), "amount", "conf").where("label <> ''")


def first_by(lines: DataFrame, tier: Column, value: Column, conf: Column, name: str) -> DataFrame:
    """k, ``name``, ``name``_conf: of the lines with a tier, the least tier and then the first line."""
    rows = lines.select("k", F.struct(tier.alias("tier"), F.col("line")).alias("at"), F.struct(value.alias("v"), conf.cast("double").alias("c")).alias("r")).where("at.tier is not null")
    return rows.groupBy("k").agg(F.min_by("r", "at").alias("r")).select("k", F.col("r.v").alias(name), F.col("r.c").alias(f"{name}_conf"))


def _touches(line: Column, symbol: str) -> Column:
    """A symbol before or after an amount with decimals, spaces being free."""
    s = text.SPACE
    return line.rlike(f"{symbol}[{s}]*\\d{{1,3}}(?:[{s}.,]\\d{{3}})*[.,]\\d{{1,2}}(?!\\d)|\\d[.,]\\d{{1,2}}[{s}]*{symbol}")


def currency(lines: DataFrame) -> DataFrame:
    """ISO code by explicit mention, then a symbol that touches an amount, then dollars, then a Canadian context."""
    t = F.col("text")
    rows = lines.select("k", "line", "text", line_conf(lines).alias("sure"))
    code = F.regexp_extract(t, CURRENCY_CODE, 1)
    symbol = F.lit(None).cast("string")
    for pattern, name in reversed(SYMBOLS):
        symbol = F.when(_touches(t, pattern), name).otherwise(symbol)
    rows = numbers.once(rows, _code=code, _symbol=F.when(t.rlike("[€£]|US\\$"), symbol))
    tier = F.when(F.col("_code") != "", 0).when(F.col("_symbol").isNotNull(), 1).when(F.contains(t, F.lit("$")) & _touches(t, "\\$"), 2).when(t.rlike(CANADIAN), 3)
    rows = numbers.once(rows, _tier=tier)
    tier = F.col("_tier")
    value = F.when(tier == 0, F.col("_code")).when(tier == 1, F.col("_symbol")).otherwise("CAD")
    conf = F.when(tier == 0, 0.9).when(tier == 1, 0.7).when(tier == 2, 0.4).otherwise(0.6)
    return first_by(rows, tier, value, conf * F.col("sure"), "currency")


def card(lines: DataFrame) -> DataFrame:
    """Payment card by brand (MC counts beside a word of payment), then debit without a brand, then a word of payment."""
    t = F.col("text")
    brand = F.when(t.rlike("\\bMC\\b") & t.rlike(PAYMENT_CONTEXT), "mastercard")
    for pattern, name in reversed(CARD_BRANDS):
        brand = F.when(t.rlike(pattern), name).otherwise(brand)
    rows = numbers.once(lines.select("k", "line", line_conf(lines).alias("sure"), "text"), _brand=brand)
    tier = F.when(F.col("_brand").isNotNull(), 0).when(t.rlike("(?i)\\bDEBIT\\b"), 1).when(t.rlike(PAYMENT_CONTEXT), 2)
    value = F.when(tier == 0, F.col("_brand")).when(tier == 1, "interac").otherwise("autre")
    return first_by(rows, tier, value, F.when(tier == 0, 0.9).when(tier == 1, 0.6).otherwise(0.5) * F.col("sure"), "card")


def date(lines: DataFrame, as_of: Column) -> DataFrame:
    """The first line with a date: k, date, date_conf."""
    found = dates.add_dates(lines.where(dates.possible(F.col("text"))).select("k", "line", "text", line_conf(lines).alias("sure")), "d", F.col("text"), as_of)
    return first_by(found, F.when(F.col("d").isNotNull(), 0), F.col("d.value"), F.col("d.sure") * F.col("sure"), "date")


def merchant(lines: DataFrame, phrases: brands.Catalogue | None = None, as_of: Column | None = None) -> DataFrame:
    """k, merchant, merchant_conf, from the first HEAD_LINES lines: a known brand above the first amount, else the first nameable line.

    Lines that are a field label, date or address name no shop, whatever word they have. A line is
    nameable if it is made of letters. A brand is named by its whole line if that is nameable, else
    by its phrase in capitals.
    """
    head = numbers.once(lines.where(F.col("line") < HEAD_LINES).select("k", "line", "text", line_conf(lines).alias("sure")), _amount=numbers.amount(F.col("text")).isNotNull())
    heads = head.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "text", "sure", F.col("_amount").alias("amount")))).alias("h"))
    stop = F.coalesce(F.array_position(F.transform("h", lambda x: x["amount"]), True), F.lit(0)).cast("int")
    heads = numbers.once(heads, _stop=F.when(stop > 0, stop).otherwise(F.size("h") + 1))
    rest = F.slice("h", F.col("_stop"), F.size("h"))
    above = _nameable(_exploded(heads, ["k", rest.alias("rest")], F.slice("h", 1, F.col("_stop") - 1)), as_of)
    if phrases is None:
        above = above.withColumn("_brand", F.lit(None).cast("string"))
    else:
        above = brands.add_brands(above, "_hits", F.when(F.col("_may"), F.col("text")), phrases)
        above = above.withColumn("_brand", F.when(F.size("_hits") > 0, F.upper(phrases.name_of(F.get("_hits", F.lit(0))))))
    first = lambda of, *fields: F.min_by(F.when(of, F.struct("text", "sure", *fields)), F.when(of, F.col("i")))
    rows = above.groupBy("k").agg(F.first("rest").alias("rest"), first(F.col("_brand").isNotNull(), F.col("_name").alias("name"), F.col("_brand").alias("brand")).alias("brand"), first(F.col("_name")).alias("plain"))
    # Few receipts name nobody above the first amount: only their other lines are looked at.
    rows = _nameable(_exploded(rows, ["k", "brand", "plain"], F.when(F.col("brand").isNull() & F.col("plain").isNull(), F.col("rest"))), as_of)
    rows = rows.groupBy("k").agg(F.first("brand").alias("_brand"), F.coalesce(F.first("plain"), first(F.col("_name"))).alias("_plain"))
    known = F.col("_brand").isNotNull()
    value = F.when(known, F.when(F.col("_brand.name"), F.col("_brand.text")).otherwise(F.col("_brand.brand"))).otherwise(F.col("_plain.text"))
    conf = F.when(known, F.col("_brand.sure") * 0.85).otherwise(F.col("_plain.sure") * 0.7)
    return rows.select("k", value.alias("merchant"), conf.alias("merchant_conf")).where("merchant is not null")


def _exploded(rows: DataFrame, kept: list[str | Column], of: Column) -> DataFrame:
    """A row for each line in ``of`` (i, text, sure), a row of nulls without any."""
    return rows.select(*kept, F.posexplode_outer(of).alias("i", "x")).select("*", F.col("x.text").alias("text"), F.col("x.sure").alias("sure")).drop("x")


def _nameable(rows: DataFrame, as_of: Column | None) -> DataFrame:
    """rows (text, or null) with _may (whether the line may speak of a shop) and _name (whether it may be its name)."""
    t = F.col("text")
    rows = numbers.once(rows, _may=F.coalesce(~text.field_label(t) & ~text.address(t), F.lit(False)))
    rows = dates.add_dates(rows, "_date", F.when(F.col("_may"), t), F.lit("2000-01-01").cast("date") if as_of is None else as_of)
    rows = rows.withColumn("_may", F.col("_may") & F.col("_date").isNull()).drop("_date")
    return numbers.once(rows, _name=F.col("_may") & F.coalesce(text.nameable(t), F.lit(False)))
