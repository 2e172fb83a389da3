import hashlib
import random
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402
from test_exact_dedup import brute as exact_brute  # noqa: E402
from test_jaccard import brute as jaccard_brute  # noqa: E402
from test_substring_dedup import brute as substring_brute  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from sedimark.llm import _common  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    english = "the of and to in that it is was for on are with as this be at by from have".split()
    french = "le la les des et un une dans pour que qui sur avec est au du ne pas plus par".split()
    texts = []
    for i in range(60):
        words = english if i % 3 else french
        texts.append((" ".join(rng.choice(words) + rng.choice(["", "", rng.choice("abcdefgh")]) for _ in range(rng.randint(6, 150))), "en" if i % 3 else "fr"))
    passage = " ".join(rng.choice(english) + str(k) for k in range(60))
    texts += [(t + " " + passage, lang) for t, lang in texts[:6]]
    texts += [(t.replace(" ", "\n", 1), lang) for t, lang in texts[10:16]] + [(t + " extra", lang) for t, lang in texts[16:22]]
    texts += [("", "en"), (None, "fr"), ("123 456", "en")]
    return [(i, t, lang, f"s{i % 4}", len(t or "")) for i, (t, lang) in enumerate(texts)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "in/documents.parquet"))
    state = {r[0]: r[1] for r in rows}
    for at, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path / "in"))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if at < 4:
            assert out.columns == docs.columns
            got = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(state) - set(got) == {i for i, t in state.items() if not any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            assert set(got) == {i for i, keep, *_ in exact_brute(list(state.items())) if i == keep} and len(got) < len(state)
        elif name == "ngram_jaccard":
            assert set(got) == {i for i, _, c in jaccard_brute(list(state.items())) if i == c} and len(got) < len(state)
        elif name == "substring_dedup":
            want = {i: (removed, digest) for i, _, removed, digest in substring_brute(list(state.items()), 50)}
            assert any(r for r, _ in want.values()) and set(got) == set(want)
            for i, t in got.items():
                assert t == state[i] if not want[i][0] else hashlib.sha256(t.encode()).hexdigest() == want[i][1]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in state.values())
            assert sum(r.length for r in out.collect()) == total
        state = got
        docs = out


def test_run_is_the_stages_in_turn(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "substring_dedup", "packing"]
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns and np.all([r.length > 0 for r in got.collect()])


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, ids with several texts, a very long text, extra columns with clashing names, and no rows."""
    rng = random.Random(5)
    words = "the of and to in that it is was for on are with as this be at by from have".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefghij") * rng.randint(0, 3) for _ in range(n))
    a, b, c, d, long = text(30), text(40), text(50), text(60), text(90_000)
    rows = [(1, a), (1, a), (1, b), (2, c), (2, "  " + c + " "), (3, c.replace(" ", "\n")), (None, d), (None, d), (None, None), (4, None), (4, None), (5, ""), (6, long), (7, long + " x"), (8, "1 2 3"), (9, a + " more")]
    schema = "key string, doc_id bigint, text string, lang string, source string, n_chars bigint, mark int, block int, c0 int, spans int, maybe int, place int"
    made = [("k", i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6) for i, t in rows]
    df = spark.createDataFrame(made, schema).repartition(3)
    kept = {}
    for at, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, df, "")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if at < 4:
            assert out.columns == df.columns
            assert {(r.key, r.mark, r.block, r.c0, r.spans, r.maybe, r.place) for r in out.collect()} == {("k", 1, 2, 3, 4, 5, 6)}
            kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        df = out
    assert kept["language_id"] == sorted([(i, t) for i, t in rows if any(x.isalpha() for x in t or "")], key=str)
    assert kept["exact_dedup"] == sorted([(1, a), (1, b), (2, "  " + c + " "), (None, d), (6, long), (7, long + " x"), (9, a + " more")], key=str)
    assert kept["ngram_jaccard"] == sorted([(1, a), (1, b), (2, "  " + c + " "), (None, d), (6, long)], key=str)
    assert kept["substring_dedup"] == kept["ngram_jaccard"]
    assert {r.doc_id for r in df.collect()} == {1, 2, 6, None}
    none = spark.createDataFrame([], schema)
    for at, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, none, "")
        assert out.collect() == [] and (at == 4 or out.columns == none.columns)


def test_run_leaves_only_what_its_result_reads(spark):
    other = _common.materialize(spark.range(3))  # a table of somebody else, still to be read
    before = _common.written()
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    n = got.count()
    assert n > 0 and len(_common.written() - before) <= 2 and other.count() == 3
    _common.purge(spark, before=before)
    assert _common.written() == before


def test_written_tables_have_no_marker(spark):
    table = _common.materialize(spark.range(3))
    names = {p.name for p in Path(table.written_to.removeprefix("file:")).resolve().iterdir()}
    assert names and not [n for n in names if "SUCCESS" in n] and table.count() == 3
    _common.discard(table)
