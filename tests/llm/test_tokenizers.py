import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from sedimark.llm import byte_bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\xa0", "\u2003", "a", "é", "ß", "1", "²", "'s", "'", "!!", "<|endoftext|>", "日本", "العربية", "ab", "the ", "\u0301", "😀", "\x85", "Word", "\r\n"]


def samples(seed, n=400):
    rng = random.Random(seed)
    return ["", " ", "x" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>" * 3] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900_000, None, "x", 1), (None, "null id", "x", 1), (0, texts[0], "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)


def test_counts_are_the_library_s(spark):
    rows, df = frame(spark, samples(1))
    library = Tokenizer.from_file(JSON)
    got = token_counts.count_tokens(df, JSON, P.PATTERN, limit=20).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted([(*w, w[2] > 20) for w in want], key=str)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s_and_come_back(spark):
    rows, df = frame(spark, samples(2))
    library = encoding()
    got = byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    texts = samples(3, 60)
    rows, df = frame(spark, texts)
    back = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted([(r.doc_id, bytes(r.data).decode()) for r in back], key=str) == sorted([(i, t or "") for i, t, *_ in rows], key=str)


def test_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    bpe, count, library, other = byte_bpe.ByteBpe(RANKS, P.PATTERN), token_counts.MergeCounter(JSON, P.PATTERN), encoding(), Tokenizer.from_file(JSON)
    for t in samples(4, 100):
        assert bpe.encode(t) == library.encode_ordinary(t)
        assert count.count(t) == len(other.encode(t, add_special_tokens=False).ids)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(empty, JSON, P.PATTERN).collect() == []
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).collect() == []
