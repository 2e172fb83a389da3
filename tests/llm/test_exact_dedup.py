import hashlib
import random
import re

from sedimark.llm import _common, exact_dedup
from sedimark.llm.exact_dedup import CuckooIndex


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(5)
    base = ["", "a b", "ab ", "\ta\nb", "é", "e\u0301", "x" * 50_000, "\xa0", "\u2003"]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(1000 + i, f"text {i % 40}" + " " * rng.randint(0, 3)) for i in range(200)]
    rows += [(None, "a b"), (None, None), (2000, None), (1000, rows[300][1])]
    return rows


def test_matches_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, key string, rows int").repartition(4)
    got = exact_dedup.exact_groups(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "mark"]
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute(rows)


def test_hot_groups_beside_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(_common, "SMALL_KEYS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 8)
    monkeypatch.setattr(exact_dedup, "LIVE", 20)
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted([tuple(r)[:5] for r in exact_dedup.exact_groups(df).collect()], key=str) == brute(rows)


def test_index_with_few_live_digests_gives_the_same():
    rng = random.Random(1)
    rows = [(hashlib.sha256(str(rng.randrange(50)).encode()).digest(), rng.randrange(9), i, 1) for i in range(2000)]
    whole = {k: (c, i, n) for k, c, i, n in exact_dedup._merge(iter(rows), None)}
    parts = {k: (c, i, n) for k, c, i, n in exact_dedup._merge(exact_dedup._merge(iter(rows), 7), None)}
    assert whole == parts and sum(n for *_, n in whole.values()) == 2000


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live, rng = CuckooIndex(2), {}, random.Random(2)
    for step in range(20_000):
        key = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        if rng.random() < 0.4:
            assert index.delete(key) == live.pop(key, None)
        else:
            index.put(key, step)
            live[key] = step
        probe = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        assert index.get(probe) == live.get(probe)
    assert dict(index.items()) == live and index.size == len(live) and index.mask > 1


def test_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
