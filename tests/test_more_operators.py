import numpy as np
from pyspark.sql import functions as F

from sedimark.operators import brands, categories, collect, engines, entities, generator, images, layout, logs, reading, stages
from sedimark.sources import readers

BLOCK = "k int, ix int, text string, x double, y double, w double, h double, conf double"


def test_condense(spark):
    rows = [(1, 0, "a", 5.0, 0.0, 5.0, 10.0, 0.9), (1, 1, " ", 5.0, 0.0, 5.0, 10.0, 0.9), (2, 0, "", 0.0, 0.0, 1.0, 1.0, 0.1), (3, 0, "b", 5.0, 0.0, 5.0, 10.0, 0.5)]
    lines, figures = reading.condense(spark.createDataFrame(rows, BLOCK), 100.0)
    assert {r.k: (r.mute, r.blocks, r.error) for r in figures.collect()} == {1: (1, 1, None), 2: (1, None, "no_text"), 3: (0, 1, "weak")}
    assert sorted((r.k, r.line_ix) for r in lines.collect()) == [(1, 0), (3, 0)]


def test_labels_of_models(spark):
    raw = [("B-MENU.NM",), ("I-tvq",), ("menu.price",), ("B-total_price",), ("B-adresse",), ("O",), (None,)]
    got = [r[0] for r in spark.createDataFrame(raw, "r string").select(entities.interpret(F.col("r"))).collect()]
    assert [tuple(r) for r in got] == [("NAME", True), ("TAX", False), ("PRICE", False), ("TOTAL", True), ("O", False), ("O", False), ("O", False)]


def test_stand_in_labels(spark):
    words = [(1, 0, 0, "TOTAL"), (1, 1, 0, "3,00"), (1, 2, 1, "SOUS-TOTAL"), (1, 3, 1, "9,00"), (1, 4, 2, "Total"), (1, 5, 2, "4,00"), (1, 6, 2, "5,00"), (1, 7, 2, "$"), (2, 0, 0, "rien")]
    got = engines.stand_in_labels(spark.createDataFrame(words, "k int, ix int, line int, text string")).collect()
    assert [(r.k, r.ix) for r in got if r.label == "TOTAL"] == [(1, 6)] and len(got) == 9 and all(r.score == 0.9 for r in got)


def test_rows_of_segments(spark):
    parts = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("label")) for t, x in (("abc", "a"), ("", "b"), ("de", "c"))])
    one, two = spark.range(1).select(layout.centred_segments(parts, 10), layout.centred_segments(parts, 5)).first()
    assert [[(s.col, s.text) for s in row] for row in one] == [[(2, "abc"), (6, "de")]] and [[(s.col, s.text) for s in row] for row in two] == [[(1, "abc")], [(1, "de")]]
    groups = F.array(parts, F.slice(parts, 2, 1), parts)
    one, two = spark.range(1).select(layout.groups_on_rows(groups, 15), layout.groups_on_rows(groups, 14)).first()
    assert [[(s.col, s.text) for s in row] for row in one] == [[(0, "abc"), (4, "de"), (9, "abc"), (13, "de")]] and [[(s.col, s.text) for s in row] for row in two] == [[(0, "abc"), (4, "de")]] * 2


def test_documents_in_photos(spark):
    rows = [(None, 1.0, [0.0], True), (0.05, 1.0, [0.0], True), (0.5, 0.8, [0.0], True), (0.5, 0.9, [0.0, 0.1], True), (0.5, 0.9, [0.0], False), (0.5, 0.9, [0.0], True)]
    got = spark.createDataFrame(rows, "a double, c double, b array<double>, q boolean").select(images.document_decision(F.col("a"), F.col("c"), F.col("b"), F.col("q")).alias("d")).collect()
    assert [(r.d.frame, r.d.note) for r in got] == [("none", 0.6), ("none", 0.6), ("box", 0.5), ("box", 0.8), ("box", 0.8), ("perspective", None)]
    square = np.array([[0, 0], [50, 1], [100, 0], [100, 60], [99, 100], [50, 100], [0, 100], [1, 50]], float)
    assert np.allclose(images.four_corners(square, 141.0), [[0, 0], [100, 0], [99, 100], [0, 100]], atol=1.5)
    assert images.four_corners(np.array([[0, 0], [10, 0], [5, 9]], float), 10.0) is None
    page = np.zeros((200, 200), bool)
    page[20:180:20, 20:180] = True
    assert images.skew(page) == 0.0 and images.skew(np.ones((20, 20), bool)) == 0.0


def test_made_identities_and_truth(spark):
    r = generator.identities(generator.receipts(spark, 400, 3), 3)
    rows = r.collect()
    assert all((x.tps_number is None) == x.small_supplier == (x.tvq_number is None) for x in rows)
    assert r.where(~F.col("postal_code").rlike("^[A-Z]\\d[A-Z] \\d[A-Z]\\d$")).isEmpty()
    assert all(len(x.tps_number) == 16 and len(x.tvq_number) == 17 for x in rows if x.tps_number) and all((x.transaction is not None) == (x.kind in generator.SERVED_AT) for x in rows)
    assert all(len(x.transaction) == 16 for x in rows if x.transaction) and all(len(x.qr_url) <= 100 for x in rows if x.qr_url)
    t = generator.truth(r).where("i = 0").first().ground_truth
    assert "null" not in t and '"total"' in t


def test_small_ones(spark):
    df = spark.createDataFrame([({"Authorization": "x", "Accept": "y"},)], "h map<string,string>")
    assert df.select(logs.redacted(F.col("h"))).first()[0] == {"Authorization": "[Redacted]", "Accept": "y"}
    runs = spark.createDataFrame([(10.0, None), (20.0, None), (99.0, "x")], "ms double, error string")
    assert tuple(stages.mean_of_successes(runs).first()) == (3, 2, 15.0) and tuple(stages.mean_of_successes(runs.where("false")).first()) == (0, 0, 0.0)
    truths = spark.createDataFrame([("a", 1.0, 2.0, 0.1, 0.2), ("b", 1.0, 2.0, 0.1, None)], "doc string, subtotal double, total double, tps double, tvq double")
    words = spark.createDataFrame([("a", "TPS", "tps"), ("a", "--", "tvq"), ("b", "TVQ", "tvq")], "doc string, text string, field string")
    assert {r.doc: [t.name for t in r.taxes] for r in readers.bench_truth(truths, words).collect()} == {"a": ["TPS"], "b": []}


def test_entities_of_documents_read_twice_stay_where_their_words_are(spark):
    words = spark.createDataFrame([(1, v, ix, f"w{ix}", label, False, 0.9, 1.0) for v in (True, False) for ix, label in enumerate(["A", "A", "O", "A", "B"])], "k bigint, v boolean, ix int, text string, label string, begin boolean, score double, conf double")
    found = entities.entities(words.repartition(4, "k"), ["k", "v"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in found.select("v", "entity_ix", "label", "text", "first_word").collect()) == [(v, i, label, text, at) for v in (False, True) for i, (label, text, at) in enumerate([("A", "w0 w1", 0), ("A", "w3", 3), ("B", "w4", 4)])]


def test_draws_of_a_receipt_are_not_repeated(spark):
    """An expression inside a lambda is computed as often as it is written: each draw of a line stands there once or in two branches."""
    made = generator.receipts(spark, 10).select("lines")._jdf.queryExecution().optimizedPlan().toString()
    assert made.count(str(generator._A)) < 200


def test_labelled_candidates_send_no_text_of_lines_and_no_words_twice(spark):
    lines = spark.createDataFrame([(1, 0, "Épicerie"), (1, 1, "TPS 5% 0,50"), (1, 2, "TOTAL 10,50"), (1, 3, "SOUS-TOTAL 10,00")], "k bigint, line int, text string")
    label = F.when(F.col("line") == 1, "TAX").when(F.col("line") == 2, "TOTAL").when(F.col("line") == 3, "TOTAL").otherwise("O")
    words = lines.select("k", F.col("line").alias("ix"), "line", "text", label.alias("label"), F.lit(True).alias("begin"), F.lit(0.9).alias("score"), F.lit(1.0).alias("conf"))
    found = collect.labelled_candidates(words, lines)
    r = found.first()
    assert [(x.value, x.line) for x in r.l_totals] == [(10.5, 2)] and [(x.name, x.rate, x.amount, x.line) for x in r.l_taxes] == [("TPS 5% 0,50", 0.05, 0.5, 1)] and r.l_subtotals == []
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_shop_below_the_first_amount(spark):
    as_of = F.lit("2029-12-31").cast("date")
    rows = [(1, 0, "12,50 $"), (1, 1, "Garage Bleu"), (2, 0, "Tel: 418"), (2, 1, "3,00"), (2, 2, "2024-01-01"), (2, 3, "Pharmacie Roy"), (3, 0, "1,00"), (4, 0, "Boutique Ida"), (4, 1, "2,00"), (4, 2, "Garage Bleu"), (5, 13, "Garage Bleu")]
    got = reading.merchant(spark.createDataFrame(rows, "k bigint, line int, text string"), brands.catalogue(categories.keywords(spark)), as_of)
    assert {r.k: (r.merchant, r.merchant_conf) for r in got.collect()} == {1: ("Garage Bleu", 0.7), 2: ("Pharmacie Roy", 0.7), 4: ("Boutique Ida", 0.7)}


def test_date_after_accents_and_marks(spark):
    rows = [(1, 0, "Payé le 3 févr. 2024"), (1, 1, "3 février 2024"), (2, 0, "20́24-05-06"), (3, 0, "12/11/24"), (4, 0, "prix 12,34"), (5, 0, None)]
    got = reading.date(spark.createDataFrame(rows, "k bigint, line int, text string"), F.lit("2026-12-31").cast("date"))
    assert {r.k: str(r.date) for r in got.collect()} == {1: "2024-02-03", 2: "2024-05-06", 3: "2024-11-12"}
