import random

import pytest

from sedimark.llm import _common, graph, jaccard


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a  B"), (4, "a b c"), (5, " \n")]
    line = [rng.choice(words) for _ in range(9)]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))] + (line if g % 3 else [])
        for _ in range(rng.choice([1, 2, 8, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 3) :]
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else "\t".join(copy).upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, place int, component int, n int").repartition(4)
    got = jaccard.jaccard_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_without_helping_clusters(spark, monkeypatch):
    """The matrix alone finds every link."""
    rows = rows_of(3)
    meet = jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda docs, visits, homes, words, percent, among: meet(docs, visits.where("not " + str(among).lower()), homes, words, percent, among))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (8, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == [(7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 2, 7), (None, 2, None)]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_one_short_text_alone(spark, n):
    rows = [(7, " ".join("abcd"[:n])), (8, ""), (9, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows) == [(7, 1, 7), (8, 0, 8), (9, 0, 9)]


@pytest.mark.parametrize("hot", [1_000_000, 2, 4])
def test_components_of_chains_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200), (101, 100)] + [(350, 300 + i) for i in range(30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200} | {i: 300 for i in [*range(300, 330), 350]}


def test_stars_need_no_round_and_small_links_no_broadcast(spark, monkeypatch):
    tables, asked = [], []
    monkeypatch.setattr(graph, "materialize", lambda df: tables.append(df) or _common.materialize(df))
    monkeypatch.setattr(graph.F, "broadcast", lambda df: asked.append(df) or df)
    stars = [(i, i % 3) for i in range(3, 60)] + [(70, 70)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(stars, "u bigint, v bigint")).collect()}
    assert got == {i: i % 3 for i in range(60)} | {70: 70} and len(tables) == 1
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*stars, (58, 59), (5, 80), (90, 80)], "u bigint, v bigint")).collect()}
    assert got == {i: 0 if i % 3 == 0 else 1 for i in range(60)} | {70: 70, 80: 1, 90: 1} and not asked


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_components_of_random_links(spark, monkeypatch, hot):
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    rng = random.Random(hot)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)


def test_large_clusters_are_opened_in_steps(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    monkeypatch.setattr(jaccard, "ROOM", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # and everything by shuffle
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == brute(rows)


@pytest.mark.parametrize("union", [200_000, 30])
def test_opens_only_groups_whose_overlap_bound_reaches_the_threshold(spark, monkeypatch, union):
    """The bound is recomputed from the sets; what was asked for and lies below it is not opened. With unions in a row, and by rows."""
    monkeypatch.setattr(jaccard, "UNION_TOKENS", union)
    monkeypatch.setattr(jaccard, "ASKERS", 3)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(4000)]
    line = [rng.choice(words) for _ in range(14)]
    rows = rows_of(5)
    for _ in range(60):  # sets of one size that share a passage too short for the threshold
        rows.append((len(rows), " ".join(line + [rng.choice(words) for _ in range(24)])))
    seen = {}
    qualifying = jaccard.qualifying

    def spy(queries, placed, percent):
        out = qualifying(queries, placed, percent)
        seen.update(queries=[tuple(r) for r in queries.collect()], placed=placed.collect(), opened={(r.doc_id, r.cluster) for r in out.collect()})
        return out

    monkeypatch.setattr(jaccard, "qualifying", spy)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == brute(rows)
    sets = {r.doc_id: (r.n, set(r.tokens)) for r in seen["placed"]}
    groups = {}
    for r in seen["placed"]:
        groups.setdefault(r.cluster, []).append(r)
    assert len(seen["opened"]) < len(seen["queries"])
    for q, c in seen["queries"]:
        a, prefix = sets[q]
        shared = len(prefix & set().union(*[set(r.tokens) for r in groups[c]]))
        sizes = [b for b in range(min(r.n for r in groups[c]), max(r.n for r in groups[c]) + 1) if 4 * min(a, b) >= 3 * max(a, b)]
        reaches = any(7 * shared + 7 * 0.75 * max(a, b) > 3 * (a + b) for b in sizes)
        assert ((q, c) in seen["opened"]) <= reaches, (q, c)
        links = any(4 * len(sets[q][1] & set(r.tokens)) >= 3 * max(len(prefix), len(r.tokens)) and r.n == a for r in groups[c] if set(r.tokens) == prefix)
        assert not links or (q, c) in seen["opened"]


def test_an_id_with_several_texts_links_through_each(spark):
    a, b = "one two three four five six seven", "red blue green white black grey pink"
    rows = [(5, a), (5, b), (3, a), (9, b), (8, "x y z")]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (8, 1, 8), (9, 3, 3)]


def test_a_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(250_000))
    rows = [(1, long), (2, long[:-30]), (3, "a b c d e f")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
