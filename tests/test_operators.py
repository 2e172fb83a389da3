import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.operators import alignment, brands, categories, detection, engines, generator, images, layout, logs, reading, scoring, solver, tokens
from sedimark.sources import readers, writers


def test_stand_in_receipt_reads_coherent(spark):
    blocks = engines.stand_in(spark.range(2).selectExpr("id as k", "1000 as width", "2000 as height"))
    assert [tuple(r)[2:] for r in blocks.where("k = 1 and ix in (3, 13)").orderBy("ix").collect()] == [("3,25", 620.0, 560.0, 56.0, 28.0, 0.9), ("8,91", 620.0, 1600.0, 56.0, 28.0, 0.9)]
    lines = reading.line_texts(reading.group_lines(blocks)).withColumnRenamed("line_ix", "line")
    assert [r.text for r in lines.where("k = 0").orderBy("line").collect()][-1] == "TOTAL 8,91"
    c = reading.candidates(lines).select("k", solver.solve(F.col("totals"), F.col("subtotals"), F.col("taxes")).alias("s"))
    assert [(r.s.total.value, r.s.subtotal.value, len(r.s.taxes), r.s.coherence) for r in c.collect()] == [(8.91, 7.75, 2, "coherente")] * 2
    assert reading.articles(lines).where("k = 1").count() == 2
    assert reading.date(lines, F.lit("2026-09-01").cast("date")).first().date.isoformat() == "2026-08-30"


def test_line_grouping_follows_the_first_block(spark):
    rows = [(1, 0, "a", 0.0, 0.0, 5.0, 10.0, 1.0), (1, 1, "b", 9.0, 4.0, 5.0, 10.0, 1.0), (1, 2, "c", 20.0, 8.0, 5.0, 10.0, 1.0)]  # a staircase
    got = reading.group_lines(spark.createDataFrame(rows, "k int, ix int, text string, x double, y double, w double, h double, conf double"))
    assert {r.text: r.line_ix for r in got.collect()} == {"a": 0, "b": 0, "c": 1}


def test_readers_of_a_receipt(spark):
    lines = spark.createDataFrame([(1, 0, "TOTAL 12,50 USD", 0.5), (2, 0, "TPS 0,50", 1.0), (2, 1, "12,50 €", 1.0), (3, 0, "G1V 3V7", 1.0), (4, 0, "rien", 1.0), (1, 1, "CARTE **** 1234", 0.8), (2, 2, "Visa 3,00", 1.0), (5, 0, "MC CREDIT", 1.0), (6, 0, "MC", 1.0), (7, 0, "DEBIT 3,00", 1.0), (8, 0, "American  Express", 1.0), (9, 0, "RT 0001", 1.0)], "k int, line int, text string, conf double")
    assert {r.k: (r.currency, round(r.currency_conf, 3)) for r in reading.currency(lines).collect()} == {1: ("USD", 0.45), 2: ("EUR", 0.7), 3: ("CAD", 0.6), 9: ("CAD", 0.6)}
    assert {r.k: (r.card, round(r.card_conf, 3)) for r in reading.card(lines).collect()} == {1: ("autre", 0.4), 2: ("visa", 0.9), 5: ("mastercard", 0.9), 7: ("interac", 0.6), 8: ("amex", 0.9)}


@pytest.mark.parametrize(("lines", "name"), [  # fixed values
    (["ESN", "MYRAND", "MAXI", "TOTAL 12,50"], "MAXI"), (["MAXI STE-FOY 3440, CH QUATRE BOURGEOIS, QUEBEC, 418-653-6241", "6,78"], "MAXI"),
    (["Bienvenue", "BURGER 12,50", "POUTINE", "8,00"], "Bienvenue"), (["Chez Rita", "TOTAL 12,50"], "Chez Rita"), (["2,00 $", "Chez Rita"], "Chez Rita"), (["BlEnVeNuE", "12 rue Iga", "AB&A&W 3"], "AB&A&W 3"),
])
def test_merchant(spark, lines, name):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "k int, line int, text string")
    assert reading.merchant(rows, brands.catalogue(categories.keywords(spark))).first().merchant == name


def test_labelled_articles(spark):
    words = [(1, 0, 0, "2", "COUNT", 0.9, 1.0), (1, 1, 0, "CAFE", "NAME", 0.8, 0.9), (1, 2, 0, "3,25", "UNIT", 0.9, 1.0), (1, 3, 0, "6,50", "PRICE", 0.9, 1.0), (1, 4, 1, "TPS", "O", 0.9, 1.0), (1, 5, 1, "0,33", "PRICE", 0.9, 1.0), (1, 6, 2, "MUFFIN", "O", 0.9, 1.0), (1, 7, 2, "4,00", "PRICE", 0.7, 1.0), (1, 8, 3, "VISA", "NAME", 0.9, 1.0), (1, 9, 3, "9,00", "PRICE", 0.9, 1.0)]
    got = reading.labelled_articles(spark.createDataFrame(words, "k int, ix int, line int, text string, label string, score double, conf double")).orderBy("line").collect()
    assert [(r.label, r.quantity, r.unit_price, r.amount, round(r.conf, 3)) for r in got] == [("CAFE", 2.0, 3.25, 6.5, 0.72), ("MUFFIN", None, None, 4.0, 0.7)]


def test_ctc(spark):
    steps = [[0.1, 0.9, 0.0], [0.1, 0.7, 0.2], [0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]
    got = spark.createDataFrame([(steps,)], "s array<array<double>>").select(tokens.ctc(F.col("s"), ["", "a", "b"]).alias("r")).first().r
    assert got.text == "aab" and got.conf == pytest.approx((0.9 + 0.8 + 0.6) / 3)


def test_windows_of_600_tokens(spark):
    got = tokens.windows(spark.createDataFrame([(1, list(range(600))), (2, [1, 2, 3]), (3, [])], "k int, tokens array<int>")).collect()
    assert sorted((r.k, r.window, len(r.tokens), r.tokens[0], r.pad) for r in got) == [(1, 0, 510, 0, 0), (1, 1, 218, 382, 292), (2, 0, 3, 1, 507)]


def test_relabel(spark):
    source = [("CAFE", "NAME"), ("FILTRE", "NAME"), ("3,25", "PRICE")]
    assert alignment.relabel(source, ["CAFE", "F1LTRE", "3,25"])[0] == ["NAME", "NAME", "PRICE"]
    assert alignment.relabel(source, ["xyz"])[0] == [None]
    df = spark.createDataFrame([(1, source, ["cafe", "3,25"])], "k bigint, source array<struct<word:string,label:string>>, read array<string>")
    done = alignment.relabel_documents(df)
    assert done.first().labels == ["NAME", "PRICE"] and (done.first().met, done.first().characters) == (8, 14)
    assert tuple(alignment.corpus_share(done).first()) == (1, 1, 2, 2, 8 / 14)


def test_lines_in_another_order_are_found_alone():
    lines = [[("RUE", "PLACE"), ("PRINCIPALE", "PLACE")], [("=====", "RULE"), ("x", "logo")], [("BEURRE", "NAME"), ("SALE", "NAME"), ("7,49", "PRICE")], [("TOTAL", "WORD"), ("18,20", "TOTAL")]]
    source = [w for line in lines for w in line]
    read = ["TOTAL", "18,20", "BEURRE", "SALE", "7,49", "RUE", "PRINC1PALE"]
    labels, met, letters = alignment.relabel(source, read, [0, 0, 1, 1, 1, 2, 2])
    assert labels == ["WORD", "TOTAL", "NAME", "NAME", "PRICE", "PLACE", "PLACE"] and (met, letters) == (36, 37)  # rules and drawings aside
    assert alignment.relabel(source, read)[1] < 20  # as one line only a part is found


def test_long_texts_are_aligned_in_halves(monkeypatch):
    r = random.Random(3)
    a = "".join(r.choice("abcd ") for _ in range(300))
    b = "".join(c if r.random() > 0.2 else r.choice(["", "x", c + "y"]) for c in a)
    cost = lambda pairs: len(a) + len(b) - 2 * len(pairs) + sum(a[i] != b[j] for i, j in pairs)
    whole = alignment.align(a, b)
    monkeypatch.setattr(alignment, "CELLS", 500)
    halves = alignment.align(a, b)
    assert cost(halves) == cost(whole) and halves == sorted(halves) and len({j for _, j in halves}) == len(halves)


def _least_costs(a, b):
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a, 1):
        rows.append([i])
        for j, d in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (c != d), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return rows


def test_paths_by_bits_are_those_of_the_table():
    """The bits say which of several cheapest paths the table would give; a bound by common characters never hides one that meets enough."""
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randrange(90))) for _ in range(2))
        cost, i, j, path = _least_costs(a, b), len(a), len(b), []
        while i and j:
            if cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                path.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        assert alignment.align(a, b) == path[::-1]
        assert alignment.longest_common(a, b) >= sum(a[i] == b[j] for i, j in path)
        part = a[3:9]
        assert alignment.local(a, part) == [(a.find(part) + k, k) for k in range(len(part))]


def test_receipts_are_relabelled_in_a_fraction_of_a_tables_time():
    """A receipt whose lines come in reverse order took some 8 ms through tables of costs."""
    r = random.Random(11)
    lines = [["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(6)) for _ in range(3)] + [f"{r.randrange(1000)},{i + 10}"] for i in range(12)]
    source = [(w, "PRICE" if w[0].isdigit() else "NAME") for x in lines for w in x]
    read, number = [w.lower() for x in lines[::-1] for w in x], [i for i, x in enumerate(lines) for _ in x]
    began = time.process_time()
    for _ in range(100):
        labels, met, letters = alignment.relabel(source, read, number)
    assert time.process_time() - began < 0.3
    assert labels == [label for x in lines[::-1] for label in ("NAME", "NAME", "NAME", "PRICE")] and met == letters


def test_polygons_keep_their_corners():
    ring = np.array([[50, 0], [100, 0], [100, 2], [100, 100], [0, 100], [0, 1]], float)
    assert images.simplified(ring, 3).tolist() == [[0, 100], [0, 1], [100, 0], [100, 100]]  # from the corner farthest from the centre
    spike = np.array([[0, 0], [10, 0], [30, 0.2], [10, 0.4], [0, 10]], float)  # beyond the end of its chord
    assert [30, 0.2] in images.simplified(spike, 5).tolist()
    assert images.simplified(ring, 1000).tolist() == [[0, 100]]


def test_taxes_after_an_accented_letter(spark):
    got = spark.createDataFrame([("éTPS 5% 0,39",), ("aTPS 5%",), ("TVQé",), ("TVQ_x",)], "t string").select(F.col("t").rlike(reading.TAX_WORDS)).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_left_and_right_texts_that_are_empty(spark):
    rows = [("", "4,50"), ("MUFFIN", ""), ("", ""), ("", "x" * 20)]
    got = spark.createDataFrame(rows, "a string, b string").select(layout.justified(F.col("a"), F.col("b"), 20, "l", "r").alias("r")).collect()
    assert [[[(s["col"], s.text) for s in row] for row in r.r] for r in got] == [[[(16, "4,50")]], [[(0, "MUFFIN")]], [], [[(0, "x" * 20)]]]


def test_log_envelopes(spark):
    schema = StructType.fromDDL("level int, time bigint, msg string, hostname string, pid int, n double, ok boolean, err struct<type:string,deep:struct<x:int>>, tags array<string>")
    lines = [('{"level":50,"time":1500,"msg":"m","hostname":"c1","pid":1,"n":2,"ok":true,"err":{"type":"E","deep":{"x":1}},"tags":["a"]}',), ('{"level":35}',), ("not json",), ('{"level":50',), (None,)]
    got = logs.envelope(spark.createDataFrame(lines, "line string"), "line", schema, {"host": "s"}, F.lit(9000))
    assert got.columns == ["host", "version", "short_message", "timestamp", "level", "_niveau", "_conteneur", "_n_num", "_ok_bool", "_err_type"]
    assert sorted(tuple(r) for r in got.collect()) == [("s", "1.1", "(sans message)", 9.0, 6, "info", None, None, None, None), ("s", "1.1", "m", 1.5, 3, "error", "c1", 2.0, "true", "E")]


def test_a_batch_that_is_replayed_is_there_once(spark, tmp_path):
    keep = writers.keep_batch(str(tmp_path / "out"))
    for number, n in ((0, 5), (1, 3), (1, 3), (0, 5)):
        keep(spark.range(n), number)
    assert spark.read.json(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 3)]


def test_generator_holds_its_invariants_whatever_the_partitions(spark):
    r = generator.receipts(spark, 300)
    assert set(generator.violations(r).first()) == {0}
    one = generator.receipts(spark, 300).coalesce(1).select(F.to_json(F.struct("*")).alias("j"))
    assert sorted(x.j for x in one.collect()) == sorted(x.j for x in r.repartition(7).select(F.to_json(F.struct(*r.columns)).alias("j")).collect())
    assert {x.split: x["count"] for x in r.groupBy("split").count().collect()} == {"train": 240, "validation": 30, "test": 30}
    with pytest.raises(ValueError):
        generator.split_of(F.col("i"), 10, (0.5, 0.1, 0.1))


def test_layout(spark):
    grid = F.concat(layout.centred(F.lit("un cafe de la gare"), 10, "shop"), layout.justified(F.lit("MUFFIN"), F.lit("4,50"), 20, "name", "price"))
    got = layout.boxes(spark.range(1).select(F.col("id").alias("k"), grid.alias("g")), "k", "g").orderBy("line", "x").collect()
    assert [(r.line, r.text, r.label) for r in got] == [(0, "un", "shop"), (0, "cafe", "shop"), (0, "de", "shop"), (1, "la", "shop"), (1, "gare", "shop"), (2, "MUFFIN", "name"), (2, "4,50", "price")]
    assert got[-1].x == 10 + 16 * 8 and got[-1].w == 32
    flow = spark.range(1).select(layout.flowing(F.array(*[F.lit(x) for x in ("aaaa", "bbbb", "cc")]), 9, None).alias("r")).first().r
    assert [[s.text for s in row] for row in flow] == [["aaaa", "bbbb"], ["cc"]]
    amounts = spark.range(1).select(layout.printed_amount(F.lit(-250), F.lit(True), F.lit("none")), layout.printed_amount(F.lit(-250), F.lit(False), F.lit("after"))).first()
    assert tuple(amounts) == ("2.50-", "-2.50 $")


def test_category_with_a_bill(spark):
    df = spark.createDataFrame([((["voyages", "cafe"], 0.8), 0.5), ((["voyages"], 0.8), 0.5), ((["cafe"], 0.8), None)], "s struct<subcategories:array<string>,conf:double>, bill double")
    got = [r[0] for r in df.select(categories.with_bill(F.col("s"), F.col("bill"))).collect()]
    assert [(sorted(r.subcategories), r.conf) for r in got] == [(["cafe", "restaurant"], 0.8), (["restaurant"], 0.45), (["cafe"], 0.8)]


def test_tax_multisets(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 1.0]), ([1.0], [1.004]), ([1.0], [1.006])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scoring.same_taxes(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_images(spark):
    grey = np.full((40, 40), 220, np.uint8)
    grey[10:30, 5:35] = 30
    assert 30 <= images.otsu(grey) < 220
    assert images.local_mean(grey, 1)[20, 20] == 30
    text = np.kron(np.random.default_rng(2).integers(0, 2, (30, 30)), np.ones((3, 3))) * 255  # unlike one edge, it has fine structure to lose
    assert images.sharpness(text) > images.sharpness(images.local_mean(text, 4)) + 0.05 and images.sharpness(np.full((9, 9), 7)) == 0
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5]])
    assert images.area(images.hull(square)) == 100
    h = images.homography(square[:4], square[:4] * 2 + 1)
    assert np.allclose(images.move(square, h), square * 2 + 1)
    assert images.largest_component(np.pad(np.ones((3, 3), bool), 2) | (np.arange(49).reshape(7, 7) == 0)).sum() == 9
    assert images.detector_size(2000, 6000) == (672, 2016) and images.detector_size(859, 1926) == (864, 1920) and images.detector_size(48, 80) == (64, 64)
    ring = np.pad(np.pad(np.zeros((3, 3), bool), 1, constant_values=True), 2)
    assert images.largest_component(ring).sum() == 16 and images.largest_component(ring, filled=True).sum() == 25
    assert images.bounding_box(ring) == (2, 2, 5, 5) and images.border_share(ring) == 0 and images.border_share(np.ones((2, 2), bool)) == 1
    rng = np.random.default_rng(1)
    for diagonal in (False, True):  # against a flood fill
        mask = rng.random((30, 40)) < 0.45
        row, first, last, region = images.regions(mask, diagonal)
        got = np.full(mask.shape, -1)
        for y, a, b, k in zip(row, first, last, region, strict=True):
            got[y, a:b] = k
        assert ((got >= 0) == mask).all()
        seen, n = np.full(mask.shape, -1), 0
        for y, x in np.argwhere(mask):
            if seen[y, x] < 0:
                todo = [(y, x)]
                seen[y, x] = n
                while todo:
                    cy, cx = todo.pop()
                    for dy, dx in [(0, 1), (0, -1), (1, 0), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal:
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < 30 and 0 <= nx < 40 and mask[ny, nx] and seen[ny, nx] < 0:
                            seen[ny, nx] = n
                            todo.append((ny, nx))
                n += 1
        assert (seen == got).all()
    verdicts = spark.createDataFrame([(0.05,), (0.125,), (0.5,)], "s double").select(images.sharpness_verdict(F.col("s")).alias("v"))
    assert [(r.v.note, r.v.error) for r in verdicts.collect()] == [(0.2, "blurred"), (0.5, None), (1.0, None)]
    df = spark.createDataFrame([("a", 40, 40, bytearray(grey.tobytes()))], "path string, width int, height int, pixels binary")
    assert images.on_images(df, images.otsu).first().value == images.otsu(grey)


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name, data in {"a.JPG": b"x" * 10, "b.png": b"", "c.svg": b"<svg/>", "d.jpeg": b"y" * 100}.items():
        (tmp_path / "p" / name).write_bytes(data)
    got = {r.stem: (r.media_type, r.error) for r in readers.photos(spark, str(tmp_path / "p"), 50).collect()}
    assert got == {"a": ("image/jpeg", None), "d": ("image/jpeg", "too_large")}
    (tmp_path / "t.json").write_text(json.dumps({"_note": {"x": 1}, "a.jpg": {"total": 3.5, "date": None}}))
    t = readers.truth(spark, str(tmp_path / "t.json")).collect()
    assert [r.photo for r in t] == ["a.jpg"] and t[0].fields["total"] == "3.5" and "date" in t[0].fields
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "doc1--text.txt").write_text("un\ndeux")
    assert [(r.stem, r.line, r.text) for r in readers.saved_lines(spark, str(tmp_path / "s")).collect()] == [("doc1", 0, "un"), ("doc1", 1, "deux")]
    (tmp_path / "m.jsonl").write_text(json.dumps({"file_name": "1.jpg", "ground_truth": json.dumps({"a": 1})}) + "\n")
    assert readers.metadata(spark, str(tmp_path / "m.jsonl"), "a int").first().truth.a == 1
    (tmp_path / "dict.txt").write_text("a\nb\n")
    assert readers.charset(spark, str(tmp_path / "dict.txt")) == ["", "a", "b", " "]
    rows = spark.createDataFrame([(2, "train", "b"), (1, "train", "a"), (3, "test", "c")], "ix int, split string, text string")
    writers.dataset(rows, str(tmp_path / "out"), "split", "ix")
    writers.per_document(rows, str(tmp_path / "doc"), "split", "ix")
    writers.texts(rows, str(tmp_path / "txt"), "split", "ix", "text")
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "txt")).collect()) == ["a\nb", "c"] and [len(r.rows) for r in spark.read.json(str(tmp_path / "doc")).orderBy("split").collect()] == [1, 2]
    writers.summary(rows.limit(1), str(tmp_path / "sum"))
    assert readers.frozen_summary(spark, str(tmp_path / "sum")).count() == 1
    errors = spark.createDataFrame([("image/avif", 5), ("image/svg+xml", 5), ("image/png", 0), ("image/png", 30_000_000), (None, 5)], "t string, n bigint").select(readers.upload_error(F.col("t"), F.col("n")))
    assert [r[0] for r in errors.collect()] == [None, "bad_request", "bad_request", "too_large", "bad_request"]
    (tmp_path / "traps.json").write_text(json.dumps({"pieges": [{"nom": "x", "lignes": ["A"], "attendu": {"categorie": None, "sousCategorie": None}}, {"nom": "y", "lignes": ["B"], "attendu": {"categorie": "sante", "sousCategorie": "sport"}}]}))
    known, unknown = readers.traps(spark, str(tmp_path / "traps.json"), spark.createDataFrame([("cafe",)], "subcategory string"))
    assert known.count() == 2 and [r.name for r in unknown.collect()] == ["y"]
    assert spark.read.json(str(tmp_path / "out")).where("split = 'train'").count() == 2
    with pytest.raises(ValueError):
        writers.invoices(rows, str(tmp_path / "inv"))
    reply = spark.range(1).select(writers.error_reply(F.lit("secret"), F.lit("inner")).alias("r")).first().r
    assert (reply.status, reply.message) == (500, "internal error")


def test_category_evidence(spark):
    phrases = brands.catalogue(categories.keywords(spark))
    names = brands.add_brands(spark.createDataFrame([(1, "Chez A & W Ltée"), (2, "BA&W"), (3, "A.W. PLOMBERIE"), (4, "BEN & FLORENTINE"), (5, "IGA CAFE ESSO MARCHE EXPRESS"), (6, None)], "k int, name string"), "hits", F.col("name"), phrases)
    assert {r.k: r.hits for r in names.collect()} == {1: ["a & w"], 2: [], 3: ["plomberie"], 4: ["ben & florentine"], 5: ["esso marche express"], 6: []}
    lines = spark.createDataFrame([(1, 0, "27-FRUITS ET LÉGUMES", 0.9), (1, 1, "1,500 kg @ 4,39/kg", 0.8), (2, 0, "Boulangerie", 1.0), (3, 0, "VIANDE", 0.7), (3, 1, "Surgelés", 1.0), (4, 0, "TABLE # 13", 0.6), (4, 1, "FACTURE ORIGINALE", 1.0), (5, 0, "TABLE 6 PLACES 499,00", 1.0), (5, 1, "FACTURE ORIGINALE", 1.0)], "k int, line int, text string, conf double")
    got = {r.k: (r.aisles, r.bill) for r in categories.evidence(lines, phrases).collect()}
    assert got == {1: (0.8, None), 2: (None, None), 3: (0.7, None), 4: (None, 0.6), 5: (None, None)}


def test_large_keyword_tables_meet_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "a"]), (3, [])], "k int, words array<string>")
    keys = spark.createDataFrame([("a b", ), ("c", ), ("b c", ), ("c", )], "phrase string")
    one = sorted(tuple(r) for r in categories.longest_phrases(docs, keys, "k", 3).collect())
    monkeypatch.setattr(categories, "SMALL_PHRASES", 0)
    assert one == sorted(tuple(r) for r in categories.longest_phrases(docs, keys, "k", 3).collect()) == [(1, 2, "a b"), (1, 2, "b c"), (2, 1, "c")]


def test_detection_and_recognition_geometry():
    tilted = detection.smallest_rectangle(np.array([[0, 0], [14, 14], [-1.4, 1.4], [12.6, 15.4]]))
    assert abs((tilted.u1 - tilted.u0) * (tilted.v1 - tilted.v0) - 19.8 * 1.98) < 0.5
    assert np.allclose(detection.smallest_rectangle(np.array([[0, 0], [10, 0], [10, 4], [0, 4]])).corners(), [[0, 0], [10, 0], [10, 4], [0, 4]])
    assert detection.resize(np.array([[0, 255]], np.uint8), 4, 1).tolist() == [[0, 64, 191, 255]]
    same = np.array([[3, 4]], np.uint8)
    assert detection.resize(same, 2, 1) is same and detection.quarter_turn(np.array([[1, 2]], np.uint8)).tolist() == [[2], [1]]
    grey = np.arange(200, dtype=np.uint8).reshape(10, 20)
    assert (detection.crop(grey, np.array([[2, 3], [8, 3], [8, 7], [2, 7]])) == grey[3:7, 2:8]).all()
    tensor = detection.recogniser_tensor([np.full((48, 100), 255, np.uint8), np.zeros((48, 400), np.uint8)])
    assert tensor.shape == (2, 3, 48, 400) and tensor[0, 0, 0, 99] == 1 and tensor[0, 0, 0, 100] == 0 and tensor[1].max() == -1
    assert detection.detector_tensor(np.full((2, 2), 255, np.uint8)).shape == (3, 2, 2)


def test_second_reading(spark):
    lines = spark.createDataFrame([(1, "A", 0.95, 10.0, 10.0, 100.0, 20.0), (2, "B", 0.5, 0.6, 10.0, 120.0, 25.0), (3, "C", 0.1, 5.0, 5.0, 3.9, 20.0), (4, "D", 0.89, 1.5, 195.0, 50.2, 20.0)], "k int, text string, conf double, x double, y double, w double, h double")
    again = detection.second_boxes(lines, 105, 200).collect()
    assert [(r.k, r.x, r.y, r.w, r.h) for r in again] == [(2, 0.0, 7.0, 105.0, 30.0), (4, 1.0, 193.0, 50.0, 7.0)]  # taller alone, whole pixels, none under four
    both = spark.createDataFrame([(2, 0, "B", 0.5), (2, 1, "BB", 0.7), (3, 0, "C", 0.5), (3, 1, "D", 0.5)], "k int, turn int, text string, conf double")
    assert sorted((r.k, r.text, r.conf) for r in detection.best_reading(both, ["k"]).collect()) == [(2, "BB", 0.7), (3, "C", 0.5)]


def test_grading_against_the_truth(spark):
    read = spark.createDataFrame([("a", 3.5, "cafe du coin"), ("b", None, "x"), ("c", 1.0, None)], "photo string, total double, merchant string")
    truth = spark.createDataFrame([("a", 3.5, "Cafe", ["total", "merchant"]), ("b", 2.0, None, ["total"]), ("d", 1.0, None, ["total"])], "photo string, total double, merchant string, given array<string>")
    v = scoring.graded(read, truth, "photo", {"total": scoring.same_cents, "merchant": scoring.same_name})
    assert sorted((r.photo, r.field, r.verdict) for r in v.collect()) == [("a", "merchant", "juste"), ("a", "total", "juste"), ("b", "total", "manquant")]
    assert tuple(scoring.right_share(v).first()) == (3, 2, 0.666667)
    c = spark.createDataFrame([("a", "coherente"), ("b", "coherente"), ("z", "coherente")], "photo string, coherence string")
    assert [(r.documents, r.right) for r in scoring.coherence_balance(v, c, "photo", ["total"]).collect()] == [(2, 1)]
    later = v.withColumn("verdict", F.when(F.col("field") == "merchant", "faux").otherwise("juste"))
    assert [tuple(r) for r in scoring.setbacks(v, later, "photo").collect()] == [("a", "merchant", "juste", "faux")]


def test_model_windows(spark):
    w = tokens.windows(spark.createDataFrame([(1, list(range(600)))], "k int, tokens array<int>"))
    rows = tokens.model_input(w, 101, 102, 0).orderBy("window").collect()
    assert [len(r.ids) for r in rows] == [512, 512] and rows[0].ids[:2] == [101, 0] and rows[0].ids[-1] == 102 and sum(rows[1].mask) == 220 and rows[1].ids[219:222] == [102, 0, 0]
    scored = spark.createDataFrame([(1, 0, 5, 7, [0.0, 2.0]), (1, 1, 1, 7, [9.0, 0.0]), (1, 0, 6, 7, [5.0, 0.0]), (1, 1, 2, 8, [1.0, 1.0])], "k int, window int, at int, word int, logits array<double>")
    assert sorted((r.word, r.best) for r in tokens.first_labels(scored).collect()) == [(7, 1), (8, 0)]


def test_refusals_keep_every_hour(spark, tmp_path):
    from sedimark.streaming import monitors

    hours = [(1, f"2020-{1 + d // 28:02d}-{1 + d % 28:02d} {h:02d}:{m}:00") for d in range(60) for h in range(24) for m in ("00", "30")] + [(1, "2020-01-01 00:45:00")]
    spark.createDataFrame(hours, "user_id bigint, ts string").select("user_id", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    got = monitors.drain(monitors.refusals(stream), ["user_id", "hour"], str(tmp_path)).collect()
    assert len(got) == 1440 and sorted(r.events for r in got)[-2:] == [2, 3]


def test_draws_do_not_come_again(spark):
    d = spark.range(3_000_000).select(generator.draw(1, F.col("id"), 1).alias("a"), generator.draw(1, F.col("id"), 2).alias("b"))
    n, a, b, corr, mean = d.agg(F.count("*"), F.countDistinct("a"), F.countDistinct("b"), F.corr("a", "b"), F.avg("a")).first()
    assert a == b == n and abs(corr) < 0.005 and abs(mean / generator.SPAN - 0.5) < 0.002
    far = spark.range(1).select(*[generator.draw(1, F.lit(5 + k * generator.SPAN), 1) for k in range(50)]).first()
    assert len(set(far)) == 50
