import math

import numpy as np
import pytest

from sedimark.llm import topk_search
from sedimark.llm.topk_search import Lists, top_matches


def brute(rows, k=5, every=50):
    good = {(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=700, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=d) * rng.choice([0.01, 0.3, 2]))]) for i in range(n)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_NUMBERS", 24 * 90)
    monkeypatch.setattr(topk_search, "BATCH", 5)
    rows = rows_of(3)
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # copies: ties go to the smaller id
    rows += [(1200, [0.0] * 24), (1250, [1.0, 2.0]), (1251, [3.0, -1.0]), (1300, None), (1301, []), (1302, [None] * 24), (1303, [float("nan")] * 24), (1304, [float("inf")] * 24)]
    rows += [rows[100], rows[7], (None, rows[8][1]), (50, rows[9][1])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score int, block string").repartition(5)
    got = top_matches(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_few_or_no_candidates(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert top_matches(spark.createDataFrame([], kind)).collect() == []
    assert top_matches(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    assert [tuple(r) for r in top_matches(spark.createDataFrame([(0, [-0.5, 0.001]), (3, [-0.001, 1.0])], kind)).collect()] == [(0, 1, 3, -128 * -1 + 0)]


def test_large_components(spark):
    kind = "vec_id bigint, embedding array<double>"
    rows = [(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 4.0])]
    assert sorted(tuple(r) for r in top_matches(spark.createDataFrame(rows, kind)).collect()) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        top_matches(spark.createDataFrame([(0, [1e12]), (1, [1e12])], kind)).collect()


def test_bounds_hold_at_every_depth_and_reading_stops_early():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(640, 16))).astype(np.int64)
    lists = Lists(np.arange(640), x)
    for q in (x[5], np.zeros(16, np.int64), -x[9]):
        frontier = lists.frontiers(q[None].astype(float))[0]
        for at, depth in enumerate(lists.depths):
            lower, upper = lists.read(q.astype(float), int(depth))
            assert (lower <= x @ q).all() and (upper >= x @ q).all()
            assert upper[lower == lower.min()].max() >= frontier[at]
    q, reads = x[5], []
    real, lists.read = lists.read, lambda q, depth: reads.append(depth) or real(q, depth)
    best = sorted(x @ q)[-2]
    assert lists.search(q, 5, 1, best, lists.frontiers(q[None].astype(float))[0])[0][0] == best
    assert len(reads) == 1 and reads[0] < 640
    assert lists.search(q, 5, 1, float((np.abs(q) * np.abs(x).max(0)).sum() + 1), lists.frontiers(q[None].astype(float))[0]) == []
    assert len(reads) == 1
