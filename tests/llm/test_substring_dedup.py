import hashlib
import os
import random
import subprocess
import sys

import pytest

from sedimark.llm import substring_dedup

COLUMNS = "doc_id bigint, text string, spans string, mark string"


def brute(rows, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, w in split:
        for at in range(len(w) - width + 1):
            k = tuple(w[at : at + width])
            if k not in first or key(i) < key(first[k]):
                first[k] = i
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - width + 1):
            if key(first[tuple(w[at : at + width])]) < key(i):
                gone.update(range(at, at + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "日本"]
    passages = [[rng.choice(words) for _ in range(rng.randint(40, 120))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a b " * 60), (5, "a b " * 90), (None, "x " + "a b " * 40)]
    for i in range(10, 150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 150))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200 + i, rows[20][1]) for i in range(40)]  # copies
    rows += [(300, " ".join(rng.choice(words) for _ in range(9000)) + " " + " ".join(passages[0]))]
    rows += [rows[30], rows[30]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [700, 1_000_000])
def test_matches_brute_force(spark, monkeypatch, block):
    rows = rows_of(block)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], COLUMNS).repartition(5)
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 50)


def test_kept_text_and_wider_hashes(spark, monkeypatch):
    rows = rows_of(3)
    monkeypatch.setattr(substring_dedup, "total_bytes", lambda *a: 10**15)
    monkeypatch.setattr(substring_dedup, "REDUCER_WINDOWS", 10**13)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], COLUMNS)
    got = substring_dedup.remove_repeats(df, with_text=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows, 50)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], COLUMNS)).collect() == []


def test_rolling_is_by_content():
    import numpy as np

    words = np.array([5, 6, 7, 1, 5, 6, 7, 2, 7, 6, 5], np.uint64)
    got = substring_dedup.rolling(words, 3, substring_dedup.BASES[0])
    assert got[0] == got[4] and got[0] != got[8] and len(set(got.tolist())) == 8


def test_rewrite_whatever_the_columns_are_called(spark):
    rows = rows_of(8)
    want = {}
    for i, _, removed, digest in brute(rows, 50):
        want.setdefault(i, set()).add((removed, digest))
    schema = "_spans string, doc_id bigint, text string, _hash bigint, spans int, mark string, c1 int, key int, block int, maybe int"
    df = spark.createDataFrame([("s", i, t, 77, 1, "m", 2, 3, 4, 5) for i, t in rows], schema).repartition(4)
    out = substring_dedup.rewrite(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows) and {(r["_spans"], r["_hash"], r["spans"], r["mark"], r["c1"], r["key"], r["block"], r["maybe"]) for r in got} == {("s", 77, 1, "m", 2, 3, 4, 5)}
    texts = {(i, t) for i, t in rows}
    for r in got:
        assert (r.doc_id, r.text) in texts or any(n and hashlib.sha256(r.text.encode()).hexdigest() == d for n, d in want[r.doc_id])
    assert sum((r.doc_id, r.text) not in texts for r in got) == sum(n > 0 for _, _, n, _ in brute(rows, 50))
    assert substring_dedup.rewrite(spark.createDataFrame([], schema)).collect() == []


def test_answers_in_a_fresh_process():
    """The reducer's function needs nothing that another module happens to have imported."""
    code = """
import pyarrow as pa
from sedimark.llm.substring_dedup import _answer
print(_answer(pa.table({"r": pa.array([0], pa.int32()), "block": [1], "docs": [b"x"], "places": [b""], "hashes": pa.array([None], pa.binary())}), 0).num_rows)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "1", done.stderr
