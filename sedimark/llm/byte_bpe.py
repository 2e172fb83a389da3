"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of linked-list positions. A bit per non-empty bucket, 256 of
them to a word, and above them a bit per non-empty word make the next rank two
find-first-set steps, whatever the number of queued pairs; stale entries are skipped when
they come up. A pre-token of any length so takes time in proportion to its merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import map_rows, sha256, texts
from .pretokens import CHUNK, ChunkCache, splitter

CACHE_ENTRIES = 700_000
BIT = [1 << i for i in range(256)]


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks (.tiktoken)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.start = [self.ranks[bytes([b])] for b in range(256)]
        self.names = [str(i) for i in range(self.size)]
        self.pairs: dict[int, int] = {}  # left << 32 | right to the rank of the token that they make
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.low = [0] * ((self.size >> 8) + 1)  # a bit per rank with a bucket; all 0 between pre-tokens
        self.split = splitter(pattern)
        self.letters = regex.compile(r" ?\p{L}+").fullmatch if r"| ?\p{L}+|" in pattern else lambda chunk: None  # such a chunk is one match
        self.cache = ChunkCache(self.chunk, CACHE_ENTRIES)

    def pretoken(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, pairs, low = len(data), self.pairs, self.low
        symbols = [self.start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}  # rank to positions, the least first
        top = 0
        todo: Iterable[int] = range(n - 1)
        while True:
            for i in todo:
                rank = pairs.get(symbols[i] << 32 | symbols[after[i]])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> 8
                        low[word] |= BIT[rank & 255]
                        top |= 1 << word
            while top:  # the least queued rank, and its least position
                word = (top & -top).bit_length() - 1
                bits = low[word]
                rank = word << 8 | (bits & -bits).bit_length() - 1
                bucket = buckets[rank]
                if len(bucket) > 1:
                    i = heappop(bucket)
                else:
                    i = bucket[0]
                    del buckets[rank]
                    bits &= bits - 1
                    low[word] = bits
                    if not bits:
                        top &= top - 1
                j, s = after[i], symbols[i]
                if s >= 0 and j < n and pairs.get(s << 32 | symbols[j]) == rank:
                    break
            else:
                return [s for s in symbols if s >= 0]
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                todo = (h, i) if h >= 0 else (i,)
            else:
                todo = (h,) if h >= 0 else ()

    def chunk(self, chunk: str) -> tuple[int, ...]:
        if self.letters(chunk):
            return tuple(self.pretoken(chunk.encode()))
        return tuple(chain.from_iterable([self.pretoken(p.encode()) for p in self.split.findall(chunk)]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, CHUNK.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of whole texts: doc_id, ids array<int>.

    One row per input row, repeated rows and null ids included; null and empty texts give no ids;
    a text of any length is encoded whole; other columns are ignored; an empty table gives an
    empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(ranks, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_rows(docs, {"doc_id": doc_id, "text": text}, work, "doc_id bigint, ids array<int>", "bpe")


def decode(tokens: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of token ids: doc_id, data binary.

    One row per input row; null ids give no bytes; an id outside the vocabulary is an error; other
    columns are ignored; an empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(ranks, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "data"])

    return map_rows(tokens, {"doc_id": doc_id, "ids": ids}, work, "doc_id bigint, data binary", "bpe")


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text and decode its ids in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the decimal ids joined by commas and of the decoded bytes. One row per
    input row, repeated rows included; null text counts as empty; other columns are ignored;
    an empty table gives an empty result. No shuffle, and no token list leaves the worker.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(ranks, pattern)
        name = bpe.names.__getitem__
        counts, ids_digests, text_digests = [], [], []
        for t in texts(batch):
            ids = bpe.encode(t)
            counts.append(len(ids))
            ids_digests.append(sha256(",".join(map(name, ids)).encode()))
            text_digests.append(sha256(bpe.decode(ids)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs, {"doc_id": doc_id, "text": text}, work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "bpe")
