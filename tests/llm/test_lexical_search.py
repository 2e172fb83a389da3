import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np

from sedimark.llm import lexical_search
from sedimark.llm._common import written
from sedimark.llm.lexical_search import Block, rank_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(split(t))) for i, t in docs]
    docs_n = sum(1 for _, c in counted if c)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * docs_n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return Counter(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "straße", "1990", "don", "t"]
    text = lambda: " ".join(words[min(304, int(r.expovariate(0.03)))] for _ in range(r.choice([0, 1, 5, 30, 200])))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[17][1] + " w5 W6-w7") for i in range(60)]  # copies: ties go to the smaller id
    docs += [(2000, None), (2001, ""), (2002, "?! --"), (None, docs[17][1] + " w5 W6-w7"), (17, docs[3][1]), (5, docs[5][1]), (2003, "w1 " * 5000 + "éa b w7_w8")]
    items = [(i, text()) for i in range(12)] + [(50, docs[17][1]), (50, "w290"), (51, None), (52, ""), (None, "w5 w6 w7 été"), (53, "nowhere"), (54, "éa b")]
    return docs, items


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, 2.0, "s") for i, t in docs], "doc_id bigint, text string, rank int, score double, term string").repartition(parts)
    return rank_documents(d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string"))


def test_matches_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK_DOCS", 90), ("LEAF", 4), ("WIDTH", 3), ("PIECE", 50), ("GROUP_BYTES", 1500)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus(4)
    got = run(spark, docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items)


def test_production_parameters_give_the_same(spark):
    docs, items = corpus(9)
    assert Counter(tuple(r) for r in run(spark, docs, items, 1).collect()) == brute(docs, items)


def test_few_items_write_no_files(spark):
    docs, items = corpus(6)
    before, settings = written(), {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = run(spark, docs, items)
        assert got.rdd.getNumPartitions() <= lexical_search.PARTS
        assert Counter(tuple(r) for r in got.collect()) == brute(docs, items)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    files = [f for table in written() - before for f in Path(table.removeprefix("file://")).glob("part-*.parquet")]
    assert 2 <= len(files) <= 6  # postings and hits of three tasks, however many shuffle partitions there are


def test_empty_tables(spark):
    docs, items = corpus(1, 30)
    assert run(spark, [], items).collect() == []
    assert run(spark, docs, []).collect() == []
    assert run(spark, [(1, None), (2, "")], items).collect() == []


def test_range_maxima_and_pruning():
    rng = np.random.default_rng(2)
    n, starts = 500, np.array([0, 500, 500, 730])
    docs = np.concatenate([np.arange(500), np.sort(rng.choice(500, 230, replace=False))]).astype(np.int32)
    adds = rng.integers(1, 50, 730)
    adds[[123, 600]] = 1000
    block = Block(list(range(n)), starts, docs, adds)
    a, b = np.sort(rng.integers(0, 500, (2, 300)), axis=0)
    top = block.largest(a, b)
    for x, y, t in zip(a, b, top, strict=True):
        assert (t == -1) if x == y else (x <= t < y and adds[t] == adds[x:y].max())
    real = block.adds
    hits = block.search(np.array([0, 1, 2]), 2, [])
    full = np.zeros(n, int)
    np.add.at(full, docs, real)
    order = sorted(range(n), key=lambda d: (-full[d], d))[:2]
    assert [(s, -i) for s, i in hits] == [(full[d], d) for d in order]
    looked = []
    largest = block.largest
    block.largest = lambda f, t: looked.append(f.shape) or largest(f, t)
    assert block.search(np.array([0, 2]), 2, [(5000, 0), (5000, -1)]) == [(5000, 0), (5000, -1)]
    assert len(looked) == 1  # the bound of the whole block is enough
