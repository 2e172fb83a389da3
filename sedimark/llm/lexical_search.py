"""Ranked lexical search: range maxima over posting lists.

The first pass over the texts counts terms; only terms that some item asks for make postings, and
those stay with their document, one row of term numbers and occurrences a document. Sums
over all rows give the number of documents, their length and each term's document frequency.

The second pass gathers these rows into blocks. A block lists, per term, its documents in order
with what the term adds to their score, and a sparse table of range maxima over all lists (for
every power of two, how far from a posting the largest one is). An item keeps intervals of
documents, each bounded by the sum over its terms of the largest posting therein. The best
intervals are taken first and split at the document of their largest posting, which is
scored; intervals of LEAF documents or fewer are scored whole. Search ends when no bound reaches
the k-th score, which a task carries from block to block. Items go in groups of bounded vocabulary.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_arrow, map_rows, materialize

#: Bytes of the terms of a group of items, at most (but for a longer single item).
GROUP_BYTES = 16_000_000
#: Documents and postings of a block; documents that are scored together; intervals that are split together.
BLOCK_DOCS, BLOCK_POSTINGS, LEAF, WIDTH = 8192, 1_000_000, 48, 64
#: Parts of the answer to a group of items, at least, and rows that meet in one.
PARTS, PART_ROWS = 8, 1_000_000
#: Salts of an item's hits: the first ranking is among those of one salt.
SALTS = 64
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 22

#: Bytes as terms have them: ASCII other than letters and digits is a space.
_LOWER = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces: runs of anything but ASCII characters that are neither letters nor digits, A-Z lower-cased."""
    data = (text or b"").translate(_LOWER)
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of a block of documents.

    starts: per term, where its list begins (one more at the end); docs, adds: per posting the document's
    place in the block and what it adds to the score.
    """

    def __init__(self, ids: list[int | None], starts: np.ndarray, docs: np.ndarray, adds: np.ndarray):
        self.ids, self.starts, self.docs, self.adds = ids, starts, docs, adds
        lists = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.keys = lists * len(ids) + docs
        far = [np.zeros(len(docs), np.uint16)]  # far[j][i]: of the 2^j postings from i on, which is the largest
        longest, width = int(np.diff(starts).max(initial=0)), 1
        at = np.arange(len(docs))
        while 2 * width <= longest:
            near = far[-1][: len(docs) - 2 * width + 1].astype(np.int64)
            beyond = far[-1][width : len(docs) - width + 1].astype(np.int64) + width
            here = at[: len(near)]
            far.append(np.where(adds[here + near] >= adds[here + beyond], near, beyond).astype(np.uint16))
            width *= 2
        self.flat = np.concatenate(far)
        self.level = np.concatenate([[0], np.cumsum([len(f) for f in far])[:-1]])

    def largest(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Places of the largest postings in [first, after), -1 where the range is empty."""
        n = after - first
        j = np.frexp(np.maximum(n, 1))[1] - 1
        left = first + self.flat[self.level[j] + np.where(n > 0, first, 0)]
        right = after - (1 << j)
        right = right + self.flat[self.level[j] + np.where(n > 0, right, 0)]
        left, right = np.where(n > 0, left, 0), np.where(n > 0, right, 0)
        return np.where(n > 0, np.where(self.adds[left] >= self.adds[right], left, right), -1)

    def search(self, wanted: np.ndarray, k: int, best: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """The k best of ``best`` and this block: (score, -id), null ids as minus infinity. wanted: term numbers."""
        wanted = wanted[self.starts[wanted + 1] > self.starts[wanted]]
        if not len(wanted):
            return best
        heap = list(best)
        heapq.heapify(heap)
        base = wanted * len(self.ids)

        def place(docs: np.ndarray) -> np.ndarray:
            return np.searchsorted(self.keys, base[:, None] + docs[None, :])

        def offer(docs: np.ndarray, scores: np.ndarray) -> None:
            if len(heap) == k:
                good = scores >= heap[0][0]
                docs, scores = docs[good], scores[good]
            elif len(docs) > k:
                good = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[good], scores[good]
            for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                if s > 0:
                    row = (s, -math.inf if self.ids[d] is None else -self.ids[d])
                    if len(heap) < k:
                        heapq.heappush(heap, row)
                    elif row > heap[0]:
                        heapq.heapreplace(heap, row)

        def bounds(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Per interval its bound and the document of its largest posting."""
            top = self.largest(first, after)
            adds = np.where(top >= 0, self.adds[top], 0)
            most = adds.argmax(0)
            return adds.sum(0), self.docs[top[most, np.arange(top.shape[1])]]

        def may(bound: np.ndarray, lo: np.ndarray) -> np.ndarray:
            """Whether an interval can hold a document for the answer. Documents are in order of id."""
            if len(heap) < k:
                return bound > 0
            score, least = heap[0]
            good = bound > score
            for i in np.nonzero(bound == score)[0]:
                own = self.ids[lo[i]]
                good[i] = own is not None and -own > least
            return good

        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64)
        first, after = place(lo), self.starts[wanted + 1][:, None].copy()
        bound, split = bounds(first, after)
        while len(lo):
            live = may(bound, lo)
            if not live.all():
                lo, hi, bound, split, first, after = lo[live], hi[live], bound[live], split[live], first[:, live], after[:, live]
                if not len(lo):
                    break
            take = np.argpartition(-bound, min(WIDTH, len(bound)) - 1)[:WIDTH]
            rest = np.ones(len(lo), bool)
            rest[take] = False
            small = take[hi[take] - lo[take] <= LEAF]
            if len(small):  # all postings of these intervals, added up by document
                n = (after - first)[:, small].ravel()
                at = np.repeat(first[:, small].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
                sums = np.zeros(len(self.ids), np.int64)
                np.add.at(sums, self.docs[at], self.adds[at])
                found = np.nonzero(sums)[0]
                offer(found, sums[found])
            big = take[hi[take] - lo[take] > LEAF]
            parts = [(lo[rest], hi[rest], bound[rest], split[rest], first[:, rest], after[:, rest])]
            if len(big):
                middle = split[big].astype(np.int64)
                cut = place(middle)
                there = (cut < after[:, big]) & (self.docs[np.minimum(cut, len(self.docs) - 1)] == middle[None, :])
                offer(middle, np.where(there, self.adds[np.minimum(cut, len(self.docs) - 1)], 0).sum(0))
                for a, b, f, t in ((lo[big], middle, first[:, big], cut), (middle + 1, hi[big], cut + there, after[:, big])):
                    some = b > a
                    if some.any():
                        bd, sp = bounds(f[:, some], t[:, some])
                        parts.append((a[some], b[some], bd, sp, f[:, some], t[:, some]))
            lo, hi, bound, split = (np.concatenate([p[i] for p in parts]) for i in range(4))
            first, after = (np.concatenate([p[i] for p in parts], 1) for i in (4, 5))
        return sorted(heap, reverse=True)


def block_of(rows: list[tuple[int | None, int, np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, length: int) -> Block:
    """rows: id, number of terms, term numbers asked for, their occurrences. weights: by term number."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    n = np.array([len(r[2]) for r in rows])
    term, tf = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (2, 3))
    m = np.array([100 - 90 + (90 * r[1] * docs) // length for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), n)
    adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    order = np.lexsort((doc, term))
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(weights)))])
    return Block([r[0] for r in rows], starts, doc[order].astype(np.int32), adds[order])


def _postings(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all its terms), terms and tfs of ``vocabulary``: every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, ids, ns, words, tfs = batch.slice(at, 64), [], [], [], []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n, found = 0, Counter()
                    for piece in terms(t):
                        n += len(piece)
                        found.update(filter(number.__contains__, piece))
                    if n:
                        ids.append(d), ns.append(n), words.append([number[w] for w in found]), tfs.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return map_arrow(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")), run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _search(postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """item (its number), doc_id, score: each task's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]

        def settle(rows: list) -> None:
            if rows:
                block = block_of(rows, weights, docs, length)
                for i, wanted in enumerate(items):
                    best[i] = block.search(wanted, k, best[i])

        rows, size = [], 0
        for batch in batches:
            ids, ns = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            term, tf = batch.column("terms"), batch.column("tfs")
            for i, (d, n) in enumerate(zip(ids, ns, strict=True)):
                mine = term[i].values.to_numpy()
                if len(mine):
                    rows.append((d, n, mine, tf[i].values.to_numpy()))
                    size += len(mine)
                if len(rows) == BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    settle(rows)
                    rows, size = [], 0
        settle(rows)
        found = [(i, None if d == -math.inf else -d, s) for i, hits in enumerate(best) for s, d in hits]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], ["item", "doc_id", "score"])

    return map_arrow(postings, run, "item int, doc_id bigint, score bigint")


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, terms (distinct, in order) of every item that has any; rows of the same id count as one item."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, sorted({w for piece in terms(t) for w in piece})) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["item_id", "terms"])

    named = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = map_rows(named, {"item_id": "item_id", "text": "text"}, work, "item_id bigint, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0.

    A term is a longest run of characters other than ASCII ones that are neither letter nor
    digit; only A-Z are lower-cased. A null or empty text has no terms. N counts the documents with
    terms, L their terms, n those of one, df the documents with a term, tf its occurrences in one. A term of the
    item, once each, adds w * (10^9 * tf // (1000 * tf + 8 * m)) where w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 10 + 90 * n * N // L. Ties go to the smaller doc_id, a null one last. Rows that repeat a doc_id are documents of
    their own, rows that repeat an item_id make one item; null is an id like another. Texts are read whole, in
    pieces of bounded size. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = _item_terms(items, item_id, item_text)
    total = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    if groups > 1:  # one group is collected at once; written, a few items would make a file for every shuffle partition
        asked = materialize(asked)
    out = None
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # GROUP_BYTES or so
        vocabulary = sorted({bytes(w) for r in mine for w in r.terms})
        if not vocabulary:
            continue
        number = {w: i for i, w in enumerate(vocabulary)}
        postings = materialize(_postings(docs, vocabulary, doc_id, text))
        count, length = postings.agg(F.count("*"), F.sum("n")).first()
        if not count:
            continue
        found = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a term of the group
        weights = np.zeros(len(vocabulary), np.int64)
        for r in found:
            weights[r.term] = weight(count, r.df)
        wanted = [np.array([number[bytes(w)] for w in r.terms], np.int64) for r in mine]
        hits = materialize(_search(postings, wanted, weights, count, length, k))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], "item int, item_id bigint")
        # k rows a task and item: first the best of some tasks each, then of these
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        named = named.coalesce(max(PARTS, len(mine) * SALTS * k // PART_ROWS))  # else a few items make a file for every shuffle partition
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
