r"""Substring deduplication by Rabin-Karp hashes of word windows.

Words are ``[^\x20\x09-\x0D]+``. Every window of ``width`` words gets a rolling hash, and a
word is removed if a window over it also starts in a document with a smaller id.

1. Each input partition is read in blocks of about 350,000 words. A block settles its own
   repeats; of each hash only the windows of its first document go on, in one compact row per
   reducer (hashes, and the windows' places as compressed differences). However hot a passage
   is, a block asks about it for one document.
2. Reducers, by hash, find the windows whose hash has a smaller document elsewhere and answer
   each block.
3. Blocks merge the windows to remove into maximal intervals of words, one row per document.
4. The intervals meet the texts by document id and text hash; the kept words are joined. A
   broadcast Bloom filter keeps texts that lose nothing off the network.

Spark deals the windows out and groups them by hash; within a block and a reducer NumPy sorts and
counts them. Hashes are as wide as the input asks for: 64 bits and as many bytes of a second hash,
from words hashed with another seed, as hold the expected number of chance matches under
1/1000. A window crosses the network as 9 to 10 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import map_arrow, materialize, sha256, ship, total_bytes, trimmed
from .bloom import flagged

BLOCK_WORDS = 350_000
#: Windows that one reducer gets on average at most: some 70 MB while it sorts them.
REDUCER_WINDOWS = 1_000_000
LEAST_REDUCERS = 64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)
LAST = np.iinfo(np.int64).max  # stands for a null id


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd") if data else b"", dtype)


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places as compressed differences."""
    return _pack(np.diff(places, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T) if len(places) else b""


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.int64) if data else np.zeros(0, np.int64)


class WordHashes(dict):
    """Word to 64-bit hash; two generations of at most 120,000 words."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        out = self.older.get(word)
        if out is None:
            out = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) < 64:
            if len(self) >= 120_000:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=2)
def word_hashes(seed: int = 0) -> WordHashes:
    return WordHashes(seed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each window of ``width`` word hashes.

    From prefix sums of word * base**-i, brought back to the window's start.
    """
    n = len(words)
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.cumsum(words * inverse, dtype=np.uint64)
    out = sums[width - 1 :].copy()
    out[1:] -= sums[:-width]
    return _mix(out * powers[: n - width + 1])


def _read_blocks(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[list[tuple]]:
    """Blocks of (doc_id, text hash, first word, words), pieces of long documents overlapping by width - 1."""
    block: list[tuple] = []
    held = 0
    for batch in batches:
        for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = (text or "").encode().split()
            for first in range(0, len(words) - width + 1, most):
                piece = words[first : first + most + width - 1] if first or len(words) > most else words
                block.append((LAST if doc_id is None else doc_id, mark, first, piece))
                held += len(piece)
                if held >= most:
                    yield block
                    block, held = [], 0
    if block:
        yield block


_ASK = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])
_ASK_DDL = "r int, block bigint, docs binary, places binary, hashes binary"


def _ask(block: list[tuple], number: int, width: int, extra: int, reducers: int) -> Iterator[pa.RecordBatch]:
    """Rows for the reducers, and one row with what the block itself knows."""
    block.sort(key=lambda d: (d[0], d[2]))
    ids, marks, firsts = (np.array([d[i] for d in block], np.int64) for i in range(3))
    sizes = np.array([len(d[3]) for d in block], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashed = lambda seed: np.fromiter((h for d in block for h in map(word_hashes(seed).__getitem__, d[3])), np.uint64, int(sizes.sum()))
    words = hashed(0)
    keys = rolling(words, width, BASES[0])
    more = rolling(hashed(1), width, BASES[1]).view(np.uint8).reshape(-1, 8)[:, :extra] if extra else None
    owner = np.repeat(np.arange(len(block)), sizes)
    place = np.flatnonzero(np.arange(len(words)) + width <= (starts + sizes)[owner])
    order = place[np.argsort(keys[place], kind="stable")]
    sorted_keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if extra:
        new[1:] |= (more[order[1:]] != more[order[:-1]]).any(axis=1)
    first = ids[owner[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]]
    settled = first < ids[owner[order]]
    yield _row(number % reducers, number, _pack(np.concatenate([ids, marks, firsts, starts, sizes])), _gaps(np.sort(order[settled])), None)
    left = order[~settled]
    to = (keys[left] >> np.uint64(32)) % np.uint64(reducers)
    left = left[np.lexsort((left, to))]
    cuts = np.searchsorted(np.sort(to), np.arange(reducers + 1).astype(np.uint64))
    for r in range(reducers):
        own = left[cuts[r] : cuts[r + 1]]
        if len(own):
            docs, where = np.unique(owner[own], return_index=True)
            table = _pack(np.diff(ids[docs], prepend=0)) , _pack(where.astype(np.uint32))
            hashes = keys[own].tobytes() + (more[own].tobytes() if extra else b"")
            yield _row(r, number, len(table[0]).to_bytes(4, "little") + table[0] + table[1], _gaps(own), hashes)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ASK, strict=True)], schema=_ASK)


def _answer(group: pa.Table, extra: int) -> pa.Table:
    """One reducer: the windows of each block whose hash has a smaller document in another."""
    rows = [r for r in group.to_pylist() if r["hashes"] is not None]
    own = group.filter(pc.is_null(group.column("hashes"))).select(["block", "docs", "places"])
    if not rows:
        return own
    keys, more, docs, counts, places = [], [], [], [], []
    for r in rows:
        at = _places(r["places"])
        n = len(at)
        cut = int.from_bytes(r["docs"][:4], "little") + 4
        ids = np.cumsum(_unpack(r["docs"][4:cut], np.int64))
        docs.append(np.repeat(ids, np.diff(_unpack(r["docs"][cut:], np.uint32).astype(np.int64), append=n)))
        keys.append(np.frombuffer(r["hashes"], np.uint64, n))
        if extra:
            more.append(np.frombuffer(r["hashes"], np.uint8, offset=8 * n).reshape(n, extra))
        counts.append(n)
        places.append(at)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((*(np.concatenate(more).T if extra else ()), key))
    sorted_key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    if extra:
        tail = np.concatenate(more)[order]
        new[1:] |= (tail[1:] != tail[:-1]).any(axis=1)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads)
    out = np.zeros(len(order), bool)
    out[order] = least[np.cumsum(new) - 1] < doc[order]
    answers: list[tuple] = []
    at = 0
    for r, n, place in zip(rows, counts, places, strict=True):
        hit = out[at : at + n]
        at += n
        if hit.any():
            answers.append((r["block"], None, _gaps(place[hit])))
    if not answers:
        return own
    return pa.concat_tables([own, pa.table([pa.array(c, f.type) for c, f in zip(zip(*answers, strict=True), own.schema, strict=True)], schema=own.schema)])


_SPANS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(pa.int64()))])


def _merge(group: pa.Table, width: int) -> pa.Table:
    """One block: the marked windows become maximal intervals of words, by document."""
    rows = group.to_pylist()
    own = next(r for r in rows if r["docs"] is not None)
    ids, marks, firsts, starts, sizes = _unpack(own["docs"], np.int64).reshape(5, -1)
    ends = starts + sizes
    edge = np.zeros(int(ends[-1]) + 1, np.int32)
    for r in rows:
        place = _places(r["places"])
        edge[place] += 1
        edge[place + width] -= 1
    cover = np.cumsum(edge)[:-1] > 0
    if not cover.any():
        return _SPANS.empty_table()
    begin, stop = cover.copy(), cover.copy()
    begin[1:] &= ~cover[:-1]
    begin[starts] = cover[starts]
    stop[:-1] &= ~cover[1:]
    stop[ends - 1] = cover[ends - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    owner = np.searchsorted(starts, a, side="right") - 1
    shift = firsts[owner] - starts[owner]
    spans: dict[int, list[int]] = {}
    for o, x, y in zip(owner.tolist(), (a + shift).tolist(), (b + shift).tolist(), strict=True):
        spans.setdefault(o, []).extend((x, y))
    return pa.table([pa.array([None if ids[o] == LAST else int(ids[o]) for o in spans], pa.int64()), pa.array([int(marks[o]) for o in spans], pa.int64()), pa.array(list(spans.values()), pa.list_(pa.int64()))], schema=_SPANS)


def repeated_spans(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Intervals of words to remove: doc_id, mark (xxhash64 of the text), spans [from, to, from, to, ...].

    A row for each block of a document with something to remove: rows of one document may be several.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    most = BLOCK_WORDS
    windows = total_bytes(rows, "text") / 4
    extra = min(8, max(0, math.ceil((2 * math.log2(windows + 1) + 10 - 64) / 8)))
    reducers = max(LEAST_REDUCERS, math.ceil(windows / REDUCER_WINDOWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(_read_blocks(batches, width, most)):
            yield from _ask(block, part << 24 | k, width, extra, reducers)

    ship(docs.sparkSession)
    answers = map_arrow(rows, ask, _ASK_DDL, "words").groupBy("r").applyInArrow(lambda t: trimmed(_answer(t, extra)), "block bigint, docs binary, places binary")
    return answers.groupBy("block").applyInArrow(lambda t: trimmed(_merge(t, width)), "doc_id bigint, mark bigint, spans array<bigint>")


def _kept(words: list[bytes], spans: list[int]) -> list[bytes]:
    kept, at = [], 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def _with_spans(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Columns c0, c1, ... of docs in their order, and spans (null where nothing is to go): the rows that lose nothing, and those that may.

    Own names keep clashes with columns of the caller out. Only the latter are shuffled, at any size
    of the input: spans have no bound for a broadcast.
    """
    spans = materialize(spans.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(F.xxhash64("doc_id", "mark").alias("key"), F.col("doc_id").alias("id"), "mark", "spans"))
    mark = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{doc_id}`").cast("bigint").alias("own_id"), mark.alias("own_mark"))
    rows = flagged(rows.withColumn("key", F.xxhash64("own_id", "own_mark")), "key", spans.select("key").distinct(), "maybe")
    names = [f"c{i}" for i in range(len(docs.columns))]
    stay = rows.where("not maybe").select(*names, F.lit(None).cast("array<bigint>").alias("spans"))
    some = rows.where("maybe").drop("key").join(spans.drop("key").hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")), "left").select(*names, "spans")
    return stay, some


def remove_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove words of repeated windows: doc_id, n_words, n_removed, kept_sha256, and kept_text on demand.

    kept_text is the kept words joined by one space. One row per input row. Null and empty
    texts and texts under ``width`` words lose nothing; a very long text is cut into overlapping
    pieces, so its windows are all judged. Windows are judged on the input. A
    repeat within one document, or in rows with the same id, is no reason to remove; null ids
    come after all others. Other columns are ignored; an empty table gives an empty result.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stay, some = _with_spans(ids, repeated_spans(ids, width), "doc_id", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, s in zip(batch.column("c1").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if s:
                    words = _kept(words, s)
                joined = b" ".join(words)
                out.append((n, n - len(words), sha256(joined), joined.decode() if with_text else None))
            if out:
                n, removed, digests, kept_texts = zip(*out, strict=True)
                arrays = [batch.column("c0"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays[: 4 + with_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    return map_arrow(stay.unionByName(some), apply, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text, "words")


def rewrite(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated words gone: same columns and rows, whatever the columns are called.

    A text that loses words becomes its kept words joined by one space; any other text stays
    as it is, white space and null included. What is removed, also of null ids, repeated rows and
    very long texts, is what ``remove_repeats`` removes. An empty table stays empty.
    """
    at = docs.columns.index(text)
    stay, some = _with_spans(docs, repeated_spans(docs, width, doc_id, text), doc_id, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if not s else b" ".join(_kept((t or "").encode().split(), s)).decode() for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    kinds = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return stay.drop("spans").unionByName(map_arrow(some, apply, kinds, "words")).toDF(*docs.columns)
