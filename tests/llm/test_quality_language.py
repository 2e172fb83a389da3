import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.llm import _common, language, quality, queries

SF = "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.score(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    right, n, clean_kept, clean = got.agg(F.count_if(F.col("kept").cast("int") == F.col("quality")), F.count("*"), F.count_if(F.col("kept") & (F.col("quality") == 1)), F.count_if(F.col("quality") == 1)).first()
    print("held-out accuracy", right / n, "clean kept", clean_kept / clean)
    assert right / n > 0.9 and clean_kept / clean > 0.95


def test_sparse_sites_shrink(spark):
    rows = [(i, "good words in a fine sentence about things", "big", "en") for i in range(60)] + [(100 + i, "### $$$ %%% !!! ***", "bad", "en") for i in range(60)] + [(200, "good words in a fine sentence about stuff", "tiny", "en")]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[1].p_host > 0.9 > got[200].p_host > 0.4 and got[101].p_host < 0.1
    assert got[1].kept and got[200].kept and not got[101].kept


def test_quality_edges(spark):
    schema = "doc_id bigint, text string, source string, lang string, score double, kept int, x int, p int"
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    rows = [(1, None, None, None), (1, "", "a", "b"), (None, "text", None, "en"), (2, "x" * 200_000, "a", None), (2, "x" * 200_000, "a", None)]
    got = quality.score(spark.createDataFrame([(*r, 0.0, 0, 0, 0) for r in rows], schema), labels).collect()
    assert len(got) == 5 and [r.kept for r in got if r.p_text == 0] == [False, False] and all(0 <= r.score <= 1 for r in got)
    assert quality.score(spark.createDataFrame([], schema), labels).collect() == []


def test_language_of_texts_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    known = docs.withColumn("label", F.when(~held, F.col("lang"))).withColumn("none", F.lit(None).cast("string"))
    got = language.identify(known, declared=None, host=None, label="label").join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    print("held-out accuracy of the text models", right / n)
    assert right / n > 0.97
    fused = language.identify(docs)
    kept, n = fused.agg(F.count_if("kept"), F.count("*")).first()
    assert kept / n > 0.99


def test_rare_languages_have_models(spark):
    parts = {"en": "the of and to in that it is was for on are with as this", "fr": "le la les des et un une dans pour que qui sur avec est", "es": "el los las y del por con para una como pero sus muy donde", "pt": "o os uma não com em são mais também pelo"}
    words = {k: v.split() for k, v in parts.items()}
    text = lambda k, i: " ".join(words[k][(i * 7 + j * (1 + i % 5)) % len(words[k])] for j in range(12))
    lang = lambda i: "es" if i % 2000 == 7 else "pt" if i in (50, 5000) else "en" if i % 2 else "fr"
    docs = spark.createDataFrame([(i, text(lang(i), i), lang(i), "s") for i in range(12_000)], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rare = [got[i] for i in range(7, 12_000, 2000)]
    assert len(got) == 12_000 and [(r.language, r.text_language, r.kept) for r in rare] == [("es", "es", True)] * 6
    assert {r.language for r in got.values()} == {"en", "es", "fr", None}
    assert all((got[i].language, got[i].confidence, got[i].kept) == (None, 0.0, False) for i in (50, 5000))  # two documents are too few for a model
    assert all(got[i].language == lang(i) for i in got if lang(i) != "pt")
    few = language.identify(docs.where("lang = 'pt'")).collect()
    assert [(r.language, r.kept) for r in few] == [(None, False)] * 2  # whatever else there is


def test_no_label_and_too_many_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the cat and the dog", f"l{i % 3}", "s") for i in range(30)], "doc_id bigint, text string, lang string, source string")
    got = language.identify(docs, declared=None, host=None).collect()
    assert len(got) == 30 and not any(r.kept or r.language or r.declared for r in got)
    assert len(language.identify(docs, declared=None, label="lang").collect()) == 30
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 labels"):
        language.identify(docs)


def test_sample_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 200)
    named = spark.range(20_000).select(F.when(F.col("id") % 4 != 1, F.col("id")).alias("i"), F.when(F.col("id") < 40, "b").when(F.col("id") < 300, "c").otherwise("a").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    limits = language._limits(named)
    assert {r.k: r.docs for r in limits.collect()} == {"a": 19_700, "b": 40, "c": 260}
    n = {r.k: r["count"] for r in language._sample(named, limits).groupBy("k").count().collect()}
    assert n["b"] == 40 and 200 <= n["a"] < 300 and 200 <= n["c"] <= 260


def test_evidence_settles_short_texts(spark):
    rows = [(i, "the cat and the dog went to the house with them", "en", "a") for i in range(30)] + [(100 + i, "le chat et le chien sont dans la maison avec nous", "fr", "b") for i in range(30)]
    rows += [(200, "x", "fr", "b"), (201, "x", "en", "a"), (202, "123 !", "fr", "b"), (203, None, "en", "a"), (204, "le chat et le chien", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[200].language == "fr" and got[201].language == "en" and got[204].language == "fr"
    assert got[202].language is None and not got[202].kept and not got[203].kept and got[204].kept
    only = {r.doc_id: r.kept for r in language.identify(docs, accept=["fr"]).collect()}
    assert only[100] and not only[0]


def test_language_edges(spark):
    schema = "doc_id bigint, text string, lang string, source string, p int, ll int, language string"
    assert language.identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "word", "en", None, 1, 1, "q"), (1, "word " * 50_000, None, "h", 1, 1, "q"), (1, "word " * 50_000, None, "h", 1, 1, "q")]
    assert len(language.identify(spark.createDataFrame(rows, schema)).collect()) == 3
    nolabel = spark.createDataFrame([(1, "word", None, None, 1, 1, "q")], schema)
    assert [r.kept for r in language.identify(nolabel).collect()] == [False]


def test_page_evidence(spark):
    df = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="FR-ca">', "a.example.org"), ("<p lang='de'>", ""), (None, None)], "html string, host string")
    got = df.select(language.markup_language(F.col("html")), language.address_suffix(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [("fr", "org"), (None, None), (None, None)]


def site_rows():
    """Documents of few and many hosts and paths, null ones, blanks and a repeated row."""
    good, bad = "the quiet river went past an old mill in the evening number {}", "BUY NOW!!! ### 99 $$$ CLICK {} !!! ***"
    rows = []
    for i in range(240):
        host = None if i % 41 == 0 else f"h{i % 7 if i % 3 else i % 2}.example.{'org' if i % 2 else 'com'}"
        text = None if i % 53 == 0 else " \n" if i % 59 == 0 else (good if (i * 7) % 10 < (8 if i % 2 else 4) else bad).format(i % 11)
        rows.append((i, text, host, None if i % 37 == 0 else f"p{i % 4}"))
    return [*rows, rows[5], rows[5]]


@pytest.mark.parametrize("small", [20_000, 0])
def test_quality_posteriors_by_hand(spark, monkeypatch, small):
    """Everything after the text's own score, recomputed in plain Python; by broadcast and by shuffle."""
    monkeypatch.setattr(_common, "SMALL_KEYS", small)
    monkeypatch.setattr(_common, "HOT_ROWS", 30)
    rows = site_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("BUY" not in (rows[i][1] or ""))) for i in range(0, 240, 2)] + [(4, 1), (4, 0)], "doc_id bigint, quality int")
    got = [r.asDict() for r in quality.score(docs, labels).join(docs.distinct(), "doc_id").collect()]
    full = [r for r in got if (r["text"] or "").strip()]
    assert len(got) == len(rows)
    level = lambda key: {k: [r["p_text"] for r in full if key(r) == k] for k in {key(r) for r in full}}
    of_host, of_path = (lambda r: r["source"]), (lambda r: (r["source"], r["lang"]))
    hosts, paths = level(of_host), level(of_path)
    mean = sum(r["p_text"] for r in full) / len(full)

    def pull(groups, above):
        n = sum(map(len, groups.values()))
        mu = sum(map(sum, groups.values())) / n
        between = sum(len(v) * (sum(v) / len(v) - above(k)) ** 2 for k, v in groups.items()) / n
        noise = sum(p * (1 - p) for v in groups.values() for p in v) / n * len(groups) / n
        return min(10_000, max(2, mu * (1 - mu) / max(between - noise, 1e-9) - 1))

    a = pull(hosts, lambda k: mean)
    b = pull(paths, lambda k: (sum(hosts[k[0]]) + a * mean) / (len(hosts[k[0]]) + a))
    logit = lambda p: math.log(p / (1 - p))
    weights = set()
    for r in got:
        blank = r not in full
        own, one = (0, 0) if blank else (r["p_text"], 1)
        h, p = hosts.get(of_host(r), []), paths.get(of_path(r), [])
        p_host = (sum(h) - own + a * mean) / (len(h) - one + a)
        p_path = (sum(p) - own + b * p_host) / (len(p) - one + b)
        assert r["p_host"] == pytest.approx(p_host, abs=1e-9) and r["p_path"] == pytest.approx(p_path, abs=1e-9)
        assert blank == (r["score"] == 0) and r["kept"] == (r["score"] >= 0.5)
        site = logit(p_path) - logit(mean)
        if not blank and abs(site) > 1e-3 and 1e-4 < r["p_text"] < 1 - 1e-4:
            weights.add(round((logit(r["score"]) - logit(r["p_text"])) / site, 6))
    assert len(weights) == 1 and 0 <= weights.pop() <= 1


def test_weight_of_the_site():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000).astype(float)
    text, site = (2 * y - 1) * 1.0 + rng.normal(0, 2, 4000), (2 * y - 1) * 1.0 + rng.normal(0, 2, 4000)
    assert quality.site_weight(text, site, y) > 0.7
    assert quality.site_weight(text, rng.normal(0, 1, 4000), y) < 0.1
    assert quality.site_weight(text, np.zeros(4000), y) == 0 == quality.site_weight(text, site, np.ones(4000))


@pytest.mark.parametrize("small", [20_000, 0])
def test_language_posteriors_by_hand(spark, monkeypatch, small):
    """Fusion of the text likelihoods with declaration, host, suffix and corpus, recomputed in plain Python."""
    monkeypatch.setattr(_common, "SMALL_KEYS", small)
    monkeypatch.setattr(_common, "HOT_ROWS", 30)
    words = {"en": "the river and the old mill of the town with some bread".split(), "fr": "le moulin et la ville avec du pain dans les rues".split(), "de": "der fluss und die stadt mit dem brot auf den wegen".split()}
    rows = []
    for i in range(150):
        lang = "en" if i % 2 else "fr" if i % 3 else "de"
        text = None if i % 31 == 0 else "1 2" if i % 37 == 0 else " ".join(words[lang][(i + j) % 9] for j in range(1 + i % 4))
        host = None if i % 29 == 0 else f"h{i % 5}.{'fr' if lang == 'fr' else 'com'}" if i % 7 else "plain"
        rows.append((i, text, None if i % 11 == 0 else "fr-CA" if lang == "fr" else lang if i % 13 else "en", host))
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("label", F.regexp_extract("lang", "^[a-z]*", 0))
    got = {r.doc_id: r for r in language.identify(docs, label="label").collect()}
    names, table, _ = language.train(docs, "text", "label", "doc_id")
    K = len(names)
    ll, n = language._scores([r[1] for r in rows], table)
    ll = ll * (np.minimum(n, language.PAIRS) / np.maximum(n, 1))[:, None]
    p = np.exp(ll - ll.max(1)[:, None])
    p /= p.sum(1)[:, None]
    real = n > 0
    total = real.sum()
    prior = (p[real].sum(0) + 1) / (total + K)
    said = [r[2] and r[2].split("-")[0] for r in rows]
    suffix = [r[3].split(".")[1] if r[3] and "." in r[3] else None for r in rows]
    sums, counts = defaultdict(lambda: np.zeros(K)), defaultdict(int)
    for i, r in enumerate(rows):
        if real[i]:
            for kind in (("d", said[i]), ("s", suffix[i]), ("h", r[3])):
                sums[kind] += p[i]
                counts[kind] += 1
    for i, r in enumerate(rows):
        one, own = (1, p[i]) if real[i] else (0, np.zeros(K))
        site = prior
        for kind, value, pull in (("s", suffix[i], language.SUFFIX_PULL), ("h", r[3], language.HOST_PULL)):
            if value is not None:
                site = (np.maximum(sums[kind, value] - own, 0) + pull * site) / (counts[kind, value] - one + pull)
        e = ll[i] + np.log(site)
        if said[i] is not None and counts["d", said[i]]:
            e = e + np.log((sums["d", said[i]] + language.VALUE_PULL * counts["d", said[i]] / total + 1e-3) / (prior * total + language.VALUE_PULL))
        answer = got[r[0]]
        if real[i]:
            assert answer.language == names[int(e.argmax())]
            assert answer.confidence == pytest.approx(1 / np.exp(e - e.max()).sum(), abs=1e-6)
        else:
            assert (answer.language, answer.confidence, answer.kept) == (None, 0, False)


def test_suffix_counts(spark):
    """Only the address suffix tells what a text of one word is; its host is new."""
    rows = [(i, "the cat and the dog went to the house with them", f"h{i}.com") for i in range(60)] + [(100 + i, "le chat et le chien sont dans la maison avec nous", f"k{i}.fr") for i in range(60)]
    rows += [(200, "x", "new.fr"), (201, "x", "new.com")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string").withColumn("label", F.when(F.col("doc_id") < 100, "en").when(F.col("doc_id") < 200, "fr"))
    got = {r.doc_id: r.language for r in language.identify(docs, declared=None, host="host", label="label").collect()}
    assert got[200] == "fr" and got[201] == "en"


def test_language_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = queries.language_of_pages(spark, sf)
    right, n = got.join(pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).where("lang <> ''"), "page_id").agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert got.count() == pages.count() and right / n > 0.95
