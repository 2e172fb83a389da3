import numpy as np
import pytest

from sedimark.llm import _common, embedding_dedup


def brute(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: [] for i, _ in rows}
    for a in ids:
        for b in ids:
            if a != b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.linalg.norm(good[a]), good[b] / np.linalg.norm(good[b])
                if x @ y >= threshold:
                    links[a].append(b)
    label = {i: i for i in links}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
        if new == label:
            return sorted((i, len(links[i]), label[i], label[i] == i) for i in links)
        label = new


def rows_of(seed, d=64, groups=60):
    rng = np.random.default_rng(seed)
    rows = [(0, None), (1, [0.0] * d), (2, [None] + [1.0] * (d - 1)), (3, [float("nan")] * d), (4, [float("inf")] + [0.0] * (d - 1)), (5, [1.0, 2.0]), (6, [1.0, 2.0])]
    for _ in range(groups):
        base = rng.normal(size=d)
        base /= np.linalg.norm(base)
        for _ in range(rng.choice([1, 2, 6, 25])):
            off = rng.normal(size=d)
            off -= off @ base * base
            off /= np.linalg.norm(off)
            cos = rng.uniform(0.97, 1.0)
            rows.append((len(rows), [float(x) for x in np.float32((cos * base + np.sqrt(1 - cos**2) * off) * rng.uniform(0.5, 3))]))
    rows += [(len(rows) + k, rows[20][1]) for k in range(30)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_of(5)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, links int, many string").repartition(4)
    got = embedding_dedup.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = {tuple(r) for r in got.collect()}, set(brute(rows))
    assert len(got) == len(want) == len(rows)
    mine, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_links * 0.999 <= mine <= all_links
    assert len(got & want) >= 0.99 * len(want)


def test_split_rooms_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROOM", 7)
    rows = rows_of(6, d=16, groups=12)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=1, tables=10).collect()
    want = brute(rows)
    assert sum(r[1] for r in want) * 0.999 <= sum(r.n_links for r in got) <= sum(r[1] for r in want)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_recall_at_the_threshold(k):
    """With the tables that an input large enough for this k gets."""
    rng = np.random.default_rng(1)
    n = 2000 if k < 4 else 600
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    tables = embedding_dedup.tables_for(k)
    a, b = (embedding_dedup.buckets(v, tables, k, embedding_dedup.PROBES) for v in (x, y))
    found = (embedding_dedup._meets(a, b) != np.iinfo(np.int64).max).any(1).mean()
    print("recall at cosine 0.95:", k, tables, found)
    assert found >= 0.99


@pytest.mark.parametrize("small", [20_000, 0])
def test_null_and_repeated_ids(spark, monkeypatch, small):
    monkeypatch.setattr(_common, "SMALL_KEYS", small)
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(None, a), (1, a), (1, a), (2, a), (3, b), (4, a), (4, b), (None, None)]
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    one = [r for r in got if r[0] in (1, 2)]
    links_of_a = 3 + [r for r in got if r[0] == 4].count((4, 3, 1, False))  # 1, 1, 2 and perhaps 4
    assert one == [(1, links_of_a - 1, 1, True)] * 2 + [(2, links_of_a - 1, 1, False)]
    four = [r for r in got if r[0] == 4]
    assert len(four) == 2 and (4, 0, 4, True) in four and len(got) == 8
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)] * 2 or all(r[1] == 0 for r in got if r[0] is None)


def test_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
