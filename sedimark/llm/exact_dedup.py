r"""Exact deduplication through cuckoo-filter indexes of text digests.

Texts are equal when they are after every character of ``[\x20\x09-\x0D]`` is deleted; their
digest is the SHA-256 of what is left. An index keeps the live digests: a cuckoo filter says
"not here" for most lookups; its hits are verified against the stored digests, bucketed by
their first bits. Overflow of the filter doubles it and fills it again from the stored keys.

Each input partition first collapses its own copies in an index with a bounded number of
live digests (the oldest are deleted from it and put out), so a group that holds a third of
all rows reaches the exchange as a few rows a partition. The exchange is by digest, to as many
partitions as hold the index of each to about LIVE digests; indexes of the same kind there
merge what the partitions found.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_figures, map_arrow, map_rows, materialize, sha256, texts

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
MOST_KICKS = 200
#: Live digests in the index of one input partition: about 100 MB.
LIVE = 200_000


class CuckooIndex:
    """Digest to payload, with insertion and deletion."""

    def __init__(self, buckets: int = 1024):
        self._resize(buckets)
        self.shelves: dict[int, dict[bytes, Any]] = {}
        self.size = 0

    def _resize(self, buckets: int) -> None:
        self.mask = buckets - 1  # buckets is a power of two
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[4:6], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * 0x5BD1E995) & self.mask

    def _find(self, digest: bytes) -> int:
        """Slot with the digest's mark, or -1. A mark may be another digest's."""
        mark = self._mark(digest)
        one = self._home(digest)
        for bucket in (one, self._other(one, mark)):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.slots[slot] == mark:
                    return slot
        return -1

    def get(self, digest: bytes) -> Any:
        """Payload of a live digest, else None."""
        if self._find(digest) < 0:
            return None
        shelf = self.shelves.get(int.from_bytes(digest[:2], "big"))
        return shelf.get(digest) if shelf else None

    def put(self, digest: bytes, payload: Any) -> None:
        """Insert a digest, or give a live one another payload."""
        shelf = self.shelves.setdefault(int.from_bytes(digest[:2], "big"), {})
        new = digest not in shelf
        shelf[digest] = payload
        if new:
            self.size += 1
            if not self._place(digest):
                self._grow()

    def delete(self, digest: bytes) -> Any:
        """Remove a live digest and return its payload; None if it isn't live."""
        key = int.from_bytes(digest[:2], "big")
        shelf = self.shelves.get(key, {})
        if digest not in shelf:
            return None
        self.slots[self._find(digest)] = 0
        self.size -= 1
        payload = shelf.pop(digest)
        if not shelf:
            del self.shelves[key]
        return payload

    def items(self) -> Iterator[tuple[bytes, Any]]:
        for shelf in self.shelves.values():
            yield from shelf.items()

    def _place(self, digest: bytes) -> bool:
        mark = self._mark(digest)
        bucket = self._home(digest)
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot] = mark
                    return True
        for kick in range(MOST_KICKS):
            slot = SLOTS * bucket + kick % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.slots[slot]:
                    self.slots[slot] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double the filter and fill it from the stored keys, until all fit."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._resize(buckets)
            if all(self._place(digest) for digest, _ in self.items()):
                return


def digest(text: str) -> str:
    return sha256(text.encode().translate(None, WHITE))


def _order(chars: int, doc_id: int | None) -> tuple:
    """The least is the row that stays: most code points, then least id, null last."""
    return -chars, doc_id is None, doc_id or 0


def _merge(rows: Iterator[tuple[bytes, int, int | None, int]], live: int | None) -> Iterator[tuple[bytes, int, int | None, int]]:
    """One row per digest with the best (chars, id) and the summed count.

    live: as many digests are kept at most; the oldest is deleted and put out beyond that.
    """
    index = CuckooIndex()
    age: dict[bytes, None] = {}
    for key, chars, doc_id, count in rows:
        if (old := index.get(key)) is None:
            index.put(key, (chars, doc_id, count))
            if live:
                age[key] = None
                if index.size > live:
                    oldest = next(iter(age))
                    del age[oldest]
                    yield oldest, *index.delete(oldest)
        else:
            best = (chars, doc_id) if _order(chars, doc_id) < _order(*old[:2]) else old[:2]
            index.put(key, (*best, old[2] + count))
    for key, payload in index.items():
        yield key, *payload


_PART = "key binary, chars bigint, best_id bigint, rows bigint"


def _batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), types, strict=True)], names=["key", "chars", "best_id", "rows"])
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), types, strict=True)], names=["key", "chars", "best_id", "rows"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((k, c, i, 1) for b in batches for k, c, i in zip(b.column("key").to_pylist(), b.column("chars").to_pylist(), b.column("doc_id").to_pylist(), strict=True))
    yield from _batches(_merge(rows, LIVE))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(_merge((row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)), None))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, mark (xxhash64 of the text), one row per input row.

    Null text counts as empty, and all empty texts are one group. The row with the most code
    points stays, of several the one with the least id; null ids come last. Rows that repeat id
    and text wholly each count in group_size and share ``kept``. Texts of any length are read
    whole. Other columns are ignored; an empty table gives an empty result.
    """

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch)
        keys = [bytes.fromhex(digest(t)) for t in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(t) for t in rows], pa.int64()), batch.column("mark")], names=["doc_id", "key", "chars", "mark"])

    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    signed = materialize(map_rows(named, {c: c for c in named.columns}, sign, "doc_id bigint, key binary, chars bigint, mark bigint"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() // LIVE))
    groups = materialize(map_arrow(map_arrow(signed.drop("mark"), _collapse, _PART).repartition(parts, "key"), _combine, _PART))
    kept = join_figures(signed, groups.select("key", F.col("best_id").alias("keep_id"), F.col("chars").alias("most"), F.col("rows").alias("group_size")), "key", "group_size")
    return kept.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most"))).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"), "mark")
