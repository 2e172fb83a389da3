import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sedimark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["the", "Word", "don't", "x" * 70, "12", "<|endoftext|>", "<|startoftext|>ab", "é", "ΑΣ", "日本", "é", "!!", "<", "\x1c", "ﬁ"]
SPACES = [" ", "  ", "\n", "\t", "\xa0", " ", "\x85"]


def random_text(rng):
    return "".join(rng.choice(PIECES) + rng.choice(SPACES) for _ in range(rng.randint(0, 60)))


def test_ids_are_the_library_s():
    rng = random.Random(3)
    library, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = [random_text(rng) for _ in range(300)] + ["", " ", "̸ ̸a"]
    got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(pa.array([*texts, None]))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


FORMS = ["word", "Word", "WORD.", "word,", "wOrd!!", "été", "Été", "ÉTÉ;", "ß", "ẞ", "STRASSE", "ÿ", "Ÿ", "H\u0331", "I\u0307", "A\u030a", "a=\u0338", "x×y", "÷", "ª", "µm", "don't", "Don'T.", "ab'", "a_b", "a^", "{b}", "b|", "b<|endoftext|>", "B<|ENDOFTEXT|>", "a1", "a.b", "...", "q" * 3000, "Q" * 3000 + "?!"]


def test_forms_of_a_word_keep_the_library_s_ids():
    library, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(5)
    texts = [*FORMS, *(" ".join(rng.choices(FORMS, k=40)) for _ in range(50))]
    texts += ["".join(rng.choice("abcEFGéÉÿßñÑ") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "$$$", ".###", "&&&", "-", "'", ">"]) for _ in range(3000)]
    for _ in range(2):  # the second time from what is remembered
        got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_spelling_rules_go_to_the_library(tmp_path):
    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    spec["normalizer"]["normalizers"].pop()  # letters keep their case
    (path := tmp_path / "other.json").write_text(json.dumps(spec))
    library, own = Tokenizer.from_file(str(path)), packing.WordIds(str(path))
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(pa.array(FORMS))] == [library.encode(t, add_special_tokens=False).ids for t in FORMS]


def test_forms_of_a_word_are_encoded_once():
    seen = []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, words, **more):
            seen.extend(w for text in words for w in text.split())
            return self.inner.encode_batch_fast(words, **more)

    own = packing.WordIds(PATH)
    for name in ("tokenizer", "bare"):
        if hasattr(own, name):
            setattr(own, name, Watched(getattr(own, name)))
    own.encode(pa.array(["word Word WORD, word.", "wORd, Word!! it's"]))
    assert sorted(seen) == ["!!", ",", ".", "it's", "word"]


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_is_gapless_and_whole(spark, window):
    rng = random.Random(window)
    rows = [(0, None), (1, ""), (1, "again"), (None, "nobody")] + [(i, random_text(rng)) for i in range(2, 200)] + [(900, "long words " * 9000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, n int, part int, ids int").repartition(5)
    got = packing.pack(df, PATH, 2, window).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=str)
    total = sum(len(ids) for _, ids in want)
    by_place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:
        assert (r.sequence_id, r.offset) == divmod(at, window) and r.length > 0 and r.offset + r.length <= window
        at += r.length
    assert at == total
    docs, pieces = [], []
    for r in by_place:
        if r.start == 0:
            pieces = []
            docs.append((r.doc_id, r.doc_tokens, pieces))
        pieces.append((r.start, r.length, r.ids_crc32))
    left = [(i, ids) for i, ids in want]
    for i, n, pieces in docs:
        match = next(k for k, (j, ids) in enumerate(left) if j == i and len(ids) == n and pieces == [(s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())) for s, m, _ in pieces])
        assert sum(m for _, m, _ in pieces) == n
        left.pop(match)
    assert not left


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH, 2).collect() == []


def test_the_driver_loads_no_tokenizer(spark):
    packing.word_ids.cache_clear()
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    assert packing.pack(docs, PATH, 2).count() == 2 and packing.word_ids.cache_info().currsize == 0
