"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a pre-token form a doubly linked list; a heap holds (rank, position) of
every adjacent pair that can merge. The lowest is popped again and again, entries whose
pair has changed are skipped. The count is the initial symbols less the merges: no token
identifiers are put out.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_rows, texts
from .pretokens import CHUNK, ChunkCache, splitter

CACHE_ENTRIES = 400_000
_BITS = 32
_LOW = (1 << _BITS) - 1


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others get 256, 257, ... in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of whole texts under a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = {}
        one = lambda s: ids.setdefault(s, len(ids))
        alphabet = byte_alphabet()
        self.start = [one(alphabet[b]) for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(one(a) << _BITS | one(b), (rank << _BITS, one(a + b)))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = splitter("|".join(map(_escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_strings = special
        self.split = splitter(pattern)
        self.cache = ChunkCache(self.chunk, CACHE_ENTRIES)

    def pretoken(self, data: bytes) -> int:
        n, pairs = len(data), self.pairs
        if n < 2:
            return n
        symbols = [self.start[b] for b in data]
        heap = []
        last = symbols[0]
        for i in range(1, n):
            s = symbols[i]
            if hit := pairs.get(last << _BITS | s):
                heap.append(hit[0] | i - 1)
            last = s
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            entry = heappop(heap)
            i = entry & _LOW
            j = after[i]
            a = symbols[i]
            if a < 0 or j >= n:
                continue
            hit = pairs.get(a << _BITS | symbols[j])
            if hit is None or hit[0] | i != entry:
                continue
            s = symbols[i] = hit[1]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := pairs.get(s << _BITS | symbols[k]):
                    heappush(heap, hit[0] | i)
            h = before[i]
            if h >= 0 and (hit := pairs.get(symbols[h] << _BITS | s)):
                heappush(heap, hit[0] | h)
        return left

    def chunk(self, chunk: str) -> int:
        return sum([self.pretoken(p.encode()) for p in self.split.findall(chunk)])

    def plain(self, text: str) -> int:
        return sum(map(self.cache.__getitem__, CHUNK.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of ``text``; a special string in it counts as one, as is the library's default."""
        if not any(s in text for s in self.special_strings):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def _escape(s: str) -> str:
    import re

    return re.escape(s)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts of whole texts: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One row per input row, repeated rows and null ids included; null text counts as empty
    (0 bytes, 0 tokens); other columns are ignored whatever their names; an empty table gives
    an empty result. No shuffle. ``tokenizer`` is a path that every executor can open.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(tokenizer, pattern).count
        rows = texts(batch)
        tokens = [count(t) for t in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_rows(docs, {"doc_id": doc_id, "text": text}, work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "counts")
