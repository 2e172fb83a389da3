"""Queries over receipts and images printed for every order or part, whose answers are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import brands, categories, detection, reading
from ..sources.receipts import table

# Receipts (lines set apart by bars) that mislead a reader of categories, with the category and sub-category they must get.
TRAPS = [
    ("(418) 658-3897 | Servi par: Libre Service 22 | Caissier : Tristan | TOTAL $7.49", None, None),
    ("Servi par: Amir | TOTAL $12.00", None, None),
    ("Mode de paiement | VISA | MONTANT $12.00", None, None),
    ("Merci et bonne soirée! | TOTAL $12.00", None, None),
    ("Sam., 15 Avril 2026 | TOTAL $12.00", None, None),
    ("1234 boul. St-Hubert | Montréal, QC H2J 2Y7 | TOTAL $12.00", None, None),
    ("123 Route de l'Église | Saint-Augustin, QC G3A 1A1 | TOTAL $12.00", None, None),
    ("ESSO MARCHE EXPRESS | 1500 boul. Laurier | ESSENCE ORDINAIRE 45.20 L | TOTAL $72.30", "transport", "essence"),
    ("COUCHE-TARD #1234 | CHIPS BBQ $3.49 | TOTAL $3.66", "transport", "essence"),
    ("TIM HORTONS #1234 | CAFE MOYEN $2.15 | TOTAL $2.47", "alimentation", None),
    ("MAXI STE-FOY QUATRE-BOURGEOIS (#7222) | TOTAL $6.78", "alimentation", "epicerie"),
    ("COSTCO WHOLESALE #503 | TELEVISEUR 55PO $599.99 | TOTAL $689.84", "alimentation", "epicerie"),
    ("CHEZ ROSALIE | ADDITION #12345-1 | TABLE #7 | CLIENT # 1 | 1 PLAT DU JOUR $18.00 FP | TOTAL $20.70 | FACTURE ORIGINALE", "alimentation", "restaurant"),
    ("LE COMPTOIR | ADDITION #20458-1 | TABLE #12 | 1 BURGER $16.00 FP", "alimentation", "restaurant"),
    ("CANTINE DU COIN | Table 30 Serveur Simon | 1 POUTINE $12.00 | TOTAL $13.80 | FACTURE ORIGINALE", "alimentation", "restaurant"),
    ("HOTEL CHATEAU LAURIER | ADDITION #365945-1 | TABLE #11 | 1 PINTE $9.00 FPS | TOTAL $10.35 | FACTURE REVISEE", "alimentation", "restaurant"),
    ("MICROBRASSERIE DU LAC | ADDITION #20331-1 | TABLE #4 | 2 IPA $16.00 FPS | TOTAL $18.40 | FACTURE ORIGINALE", "alimentation", "restaurant"),
    ("QUILLES DE LA CAPITALE | ADDITION #4521-1 | TABLE #3 | 2 PARTIES $12.00 | TOTAL $13.80 | FACTURE ORIGINALE", None, None),
    ("TAXI COOP QUEBEC | Voiture 214 | Prise en charge $3.50 | TOTAL $23.50 | FACTURE ORIGINALE", "transport", "taxi"),
    ("SIMONS | CHANDAIL $45.00 | TOTAL $51.74 | Retour en 30 jours sur présentation de la | facture originale", "personnel", "vetements"),
    ("BOUTIQUE DU BOIS FRANC | TABLE 6 PLACES | 1 @ 499,00 | TOTAL $573.60 | FACTURE ORIGINALE", None, None),
    ("HARVEY'S #1234 | COMBO BURGER $12.49 | TOTAL $14.36", "alimentation", "restaurant"),
    ("MARY BROWN'S CHICKEN | TOTAL $15.00", "alimentation", "restaurant"),
    ("H & M HENNES & MAURITZ | CHANDAIL $29.99 | TOTAL $34.48", "personnel", "vetements"),
    ("A&W #1234 STE-FOY | TEEN BURGER $8.99 | TOTAL $10.34", "alimentation", "restaurant"),
    ("A.W. PLOMBERIE | RACCORD 1/2 PO $4.99 | TOTAL $5.74", "logement", "entretien-maison"),
    ("IGA SAINT-HENRI | BANANES $1.34 | TOTAL $1.34", "alimentation", "epicerie"),
    ("COIFFURE SANS RENDEZ-VOUS | COUPE $25.00 | TOTAL $28.74", "personnel", "soins-personnels"),
    ("BIENVENUE CHEZMETRO | LAIT 2% $6.49 | TOTAL $6.49", "alimentation", "epicerie"),
    ("3 UNI QLO | T-shirt $9.90 | TOTAL $11.38", "personnel", "vetements"),
    ("LA FLEUR DE LYS | TOTAL $12.00", None, None),
    ("MERCI DE VOTRE VISITE | WWW.UNIQLO.COM | T-shirt $9.90 | TOTAL $11.38", "personnel", "vetements"),
    ("LE PETIT KIOSQUE | En ligne: https://clover.com/p/OX30 | TOTAL $9.00", None, None),
    ("MERCI DE VOTRE VISITE | VIANDE | BOEUF HACHE $8.99 | FRUITS/LEGUMES | BANANE $1.34 | 0.625 kg @ $2.14 / kg | TOTAL $10.33", "alimentation", "epicerie"),
    ("MERCI DE VOTRE VISITE | 21-EPICERIE | PATES ORZO $1.99 | 27-FRUITS ET LEGUMES | BANANE $1.34 | TOTAL $3.33", "alimentation", "epicerie"),
    ("JEAN COUTU | EPICERIE | CHIPS $3.49 | PRODUITS LAITIERS | LAIT 2% $6.49 | TOTAL $9.98", "sante", "medicaments"),
    ("MERCI DE VOTRE VISITE | BRIE DE MEAUX | 0.285 kg @ $54.90 / kg 15.65 | TOTAL $15.65", None, None),
    ("MERCI DE VOTRE VISITE | BOULANGERIE | TOTAL $5.00", None, None),
    ("MERCI DE VOTRE VISITE | ADDITION #123-1 | TABLE #5 | BOUCHERIE | VIANDE | 1 POULET $19.00 | TOTAL $21.85 | FACTURE ORIGINALE", "alimentation", "restaurant"),
    ("BEN & FLORENTINE STE-FOY | DEJEUNER $16.00 | TOTAL $18.40", "alimentation", "restaurant"),
    ("CASSE-CROÛTE DE L'ARÉNA | HOT-DOG $3.50 | TOTAL $4.02", "alimentation", "restaurant"),
    ("CAFÉ DU MUSÉE | ALLONGE $3.25 | TOTAL $3.74", None, None),
]
# Lines, the last amount in cents, the date and how sure it is.
ODD_LINES = [
    ("8,91", 891, None, None), ("$12.00", 1200, None, None), ("$10.2", 1020, None, None), ("RABAIS -2,50", -250, None, None), ("TOTAL 38, 23", 3823, None, None), ("TPS 5% 0,39", 39, None, None), ("1.5 KG @ 4,39/KG 6,59", 659, None, None),
    ("TOTAL 1 234,56", 123456, None, None), ("TOTAL 1 234.56", 123456, None, None), ("TOTAL 1,234.56", 123456, None, None), ("TOTAL 12,345.67", 1234567, None, None), ("TOTAL 1.234,56", 123456, None, None),
    ("TOTAL 1\u00a0234,56", 123456, None, None), ("TOTAL 1\u202f234,56", 123456, None, None), ("TOTAL 1\t234,56", 123456, None, None),
    ("TEL 418-527-9444", None, None, None), ("18:53:03", None, None, None), ("TVQ 9,975%", None, None, None), ("CARTE 4834-8741", None, None, None), ("TEL 418.527.9444", None, None, None), ("TOTAL 1,234", None, None, None),
    ("4834-8741,00", None, None, None), ("12-34,56", None, None, None), ("RABAIS 10,5%", 1050, None, None),
    ("2026-08-27 22:04:07", None, "2026-08-27", 0.9), ("2026-08-2722:04:07", None, "2026-08-27", 0.9), ("2026-08-2724", None, None, None), ("2026-8-3", None, "2026-08-03", 0.9), ("2026/08/3", None, "2026-08-03", 0.9),
    ("27/08/2026", None, "2026-08-27", 0.9), ("08/27/2026", None, "2026-08-27", 0.9), ("03/04/2026", None, "2026-04-03", 0.6), ("05/05/2026", None, "2026-05-05", 0.6), ("26-08-19", None, "2026-08-19", 0.6), ("26/08/26", None, "2026-08-26", 0.6),
    ("31/02/2026", None, None, None), ("13/13/2026", None, None, None), ("3-ao\u00fbt-2026", None, "2026-08-03", 0.9), ("1er jan. 2026", None, "2026-01-01", 0.9), ("Sam., 15 Avril 2026", None, "2026-04-15", 0.9), ("Aug 3, 2026", None, "2026-08-03", 0.9),
    ("15 mardi 2026", None, None, None), ("3 marche 2026", None, None, None), ("2026-02-30 ou 3 mars 2026", None, "2026-03-03", 0.9),
]
AS_OF = "2026-09-01"
# Lines at the head of a receipt, whether they can name a shop, and whether they are an address.
HEADS = [
    ("MAXI STE-FOY", True, False), ("Chez Rita", True, False), ("CAFE 12 rue", True, False), ("1522, 2E RANG", False, True), ("3440 CH QUATRE BOURGEOIS", False, True), ("1234 boul. St-Hubert", False, True), ("Qu\u00e9bec QC G1V 3V7", False, True),
    ("Montr\u00e9al, QC", False, True), ("Servi par: Amir", False, False), ("(418) 658-3897", False, False), ("SaTTEMKEsYaAMGR", False, False), ("McDonald", True, False), ("<TICKET>", False, False), ("Sam., 15 Avril 2026", False, False), ("AB", False, False),
]


def _printed(spark: SparkSession, sf_dir: str, cases: list[list[str]]) -> DataFrame:
    """k, trap, line, text: every order prints one of the cases, by its key."""
    rows = [(c, n, x) for c, lines in enumerate(cases) for n, x in enumerate(lines)]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), (F.col("o_orderkey") % len(cases)).cast("bigint").alias("trap"))
    return orders.join(F.broadcast(spark.createDataFrame(rows, "trap bigint, line int, text string")), "trap")


def category_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and sub-category of every order's trap, through merchant, site, bill and aisles."""
    lines, phrases = _printed(spark, sf_dir, [t[0].split(" | ") for t in TRAPS]), brands.catalogue(categories.keywords(spark))
    read = lines.drop("trap")
    found = categories.of_receipts(read, reading.merchant(read, phrases, F.lit(AS_OF).cast("date")), phrases)
    return found.groupBy((F.col("k") % len(TRAPS)).alias("trap"), "category", "subcategory").agg(F.count("*").alias("orders"))


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount and date of the odd line that every order prints."""
    rows = dates.add_dates(_printed(spark, sf_dir, [[r[0]] for r in ODD_LINES]), "d", F.col("text"), F.lit(AS_OF).cast("date"))
    read = rows.select("trap", F.round(numbers.amount(F.col("text")) * 100).cast("bigint").alias("cents"), F.col("d.value").alias("day"), F.col("d.sure").alias("sure"))
    return read.groupBy("trap", "cents", "day", "sure").agg(F.count("*").alias("orders"))


def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the line at the head of every order's receipt can name a shop, and whether it is an address."""
    lines = _printed(spark, sf_dir, [[h[0]] for h in HEADS])
    named = reading.merchant(lines.drop("trap"), None, F.lit(AS_OF).cast("date")).select("k", F.lit(True).alias("named"))
    read = lines.join(named, "k", "left").select("trap", F.coalesce("named", F.lit(False)).alias("named"), text.address(F.col("text")).alias("address"))
    return read.groupBy("trap", "named", "address").agg(F.count("*").alias("orders"))


def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a map of 40 x 20 for every part: a bright zone whose place comes from the key, in an image of the same size or twice that; every fifth is too
    weak and every seventh too thin."""
    k = F.col("p_partkey").cast("bigint")
    dx, dy = k % 4, F.floor(k / 4) % 2
    bottom = F.when(k % 7 == 0, 8 + dy).otherwise(12 + dy)
    chance = F.when(k % 5 == 0, 0.5).otherwise(1.0)
    x, y = lambda i: i % 40, lambda i: F.floor(i / 40)
    lit = lambda i: F.when(x(i).between(5 + dx, 30 + dx) & y(i).between(8 + dy, bottom), chance).otherwise(0.0).cast("float")
    twice = F.when(k % 3 == 0, 2).otherwise(1)
    maps = table(spark, sf_dir, "part").select(k.alias("k"), F.lit(40).alias("width"), F.lit(20).alias("height"), (twice * 40).alias("source_width"), (twice * 20).alias("source_height"), F.transform(F.sequence(F.lit(0), F.lit(799)), lit).alias("chances"))
    return detection.detect(maps).select("k", "x0", "y0", "x1", "y1")


# The zone of 26 x 5 at (5, 8) gives the box (2, 5) to (33, 15), twice as large (5, 11) to (65, 29).
BOXES = """with p as (select cast(p_partkey as bigint) as k, k % 4 as dx, k // 4 % 2 as dy from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0)
select k, case when k % 3 = 0 then 5 + 2 * dx else 2 + dx end as x0, case when k % 3 = 0 then 11 + 2 * dy else 5 + dy end as y0, case when k % 3 = 0 then 65 + 2 * dx else 33 + dx end as x1, case when k % 3 = 0 then 29 + 2 * dy else 15 + dy end as y1 from p"""


def line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths for the recogniser of a line for every part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 6000 + 10).alias("w"), (F.col("p_size") + 20).alias("h"))
    return rows.select("k", detection.recogniser_widths(F.col("w"), F.col("h")).alias("s")).select("k", F.col("s.resized").cast("bigint").alias("resized"), F.col("s.total").cast("bigint").alias("total"))


WIDTHS = """with p as (select p_partkey as k, p_partkey * 37 % 6000 + 10 as w, p_size + 20 as h from part), t as (select *, cast(floor(48 * greatest(320 / 48, w / h)) as bigint) as total from p)
select k, case when total > 3200 then 3200 else least(total, cast(ceil(48 * w / h) as bigint)) end as resized, least(total, 3200) as total from t"""


def _sql(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows: list[tuple], columns: list[str]) -> str:
    """Per case the answer that is known and the orders that print it."""
    cases = f"(values {', '.join('(' + ', '.join(map(_sql, (k, *r))) + ')' for k, r in enumerate(rows))}) t({', '.join(['k', *(f'c{i}' for i in range(len(rows[0])))])})"
    return f"select cast(k as bigint) as trap, {', '.join(columns)}, count(*) as orders from orders join {cases} on o_orderkey % {len(rows)} = k group by all"


QUERIES = {
    "category_traps": (category_traps, _values([(c, s) for _, c, s in TRAPS], ["cast(c0 as varchar) as category", "cast(c1 as varchar) as subcategory"])),
    "odd_lines": (odd_lines, _values([r[1:] for r in ODD_LINES], ["cast(c0 as bigint) as cents", "cast(c1 as date) as day", "cast(c2 as double) as sure"])),
    "detected_boxes": (detected_boxes, BOXES),
    "line_widths": (line_widths, WIDTHS),
    "head_lines": (head_lines, _values([r[1:] for r in HEADS], ["c0 as named", "c1 as address"])),
}
