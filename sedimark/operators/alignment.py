"""Labels carried from a source text to its reading by character alignment.

Dynamic programming has no column expression, so each document's pair of texts is aligned in
an Arrow batch; documents are small, and each is on its own.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship


#: Cells of a table of costs that are kept at once; longer texts are halved first.
CELLS = 1 << 20
# Labels of what is drawn, not written.
DRAWN = ["barcode", "qr", "logo", "separator"]


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of turning all of ``a`` into each beginning of ``b``, in memory of one row."""
    places = np.arange(len(b) + 1)
    row = places.copy()
    for i, c in enumerate(a, 1):
        best = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], best]) - places) + places
    return row


def align(a: str, b: str) -> list[tuple[int, int]]:
    """Pairs of places of a cheapest edit path: matches and substitutions in order.

    Texts whose table would have more than CELLS cells are split where a cheapest path crosses the middle of ``a``, found from both ends.
    """
    if (len(a) + 1) * (len(b) + 1) <= CELLS:
        return _path(a, b)
    codes = [np.array([ord(c) for c in t], np.int64) for t in (a, b)]
    path: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if (i1 - i0 + 1) * (j1 - j0 + 1) <= CELLS or i1 - i0 < 2:
            path += [(i0 + i, j0 + j) for i, j in _path(a[i0:i1], b[j0:j1])]
            continue
        middle = (i0 + i1) // 2
        before, after = _costs(codes[0][i0:middle], codes[1][j0:j1]), _costs(codes[0][middle:i1][::-1], codes[1][j0:j1][::-1])[::-1]
        cut = j0 + int((before + after).argmin())
        parts += [(middle, i1, cut, j1), (i0, middle, j0, cut)]
    return path


def _path(a: str, b: str) -> list[tuple[int, int]]:
    """``align`` without a split: the table of costs by columns, its differences as the bits of whole numbers, one a cell (Hyyrö's form of Myers' algorithm).

    Walking back, a step along both texts goes before one along ``a``, and this before one along ``b``.
    """
    n, full = len(a), (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    above, below = full, 0  # cells one dearer, and one cheaper, than the cell of the character of ``a`` before
    same, dearer = [], []  # by columns: cells that cost what the one before in both texts costs, and ``above``
    for c in b:
        met = at.get(c, 0)
        even = ((met & above) + above ^ above | met | below) & full
        right = ((below | (even | above) ^ full) << 1 | 1) & full
        above, below = (even & above) << 1 | (even | right) ^ full, even & right
        same.append(even)
        dearer.append(above)
    i, j, path = n - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if a[i] == b[j] or not same[j] >> i & 1:
            path.append((i, j))
            i, j = i - 1, j - 1
        elif dearer[j] >> i & 1:
            i -= 1
        else:
            j -= 1
    return path[::-1]


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of its table as the bits of a whole number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        met = free & at.get(c, 0)
        free = (free + met | free - met) & full
    return len(a) - free.bit_count()


def local(a: str, b: str) -> list[tuple[int, int]]:
    """Pairs of places of a best local alignment (match 2, mismatch and gap -1); of equal ones the first in the longer text."""
    if len(a) < len(b):
        return [(i, j) for j, i in local(b, a)]
    if (at := a.find(b)) >= 0:  # all of it in one piece: nothing scores more
        return [(at + k, k) for k in range(len(b))]
    n, m = len(b), len(a)  # rows: the shorter text
    score = np.zeros((n + 1, m + 1), np.int32)
    long, places = np.array([ord(c) for c in a], np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1, :-1] + np.where(long == ord(b[i - 1]), 2, -1), score[i - 1, 1:] - 1)
        steps = np.concatenate([[0], np.maximum(best, 0)]) + places  # a gap costs one a place
        score[i] = np.maximum.accumulate(steps) - places
    i, j = map(int, np.unravel_index(int(score.argmax()), score.shape)) if n and m else (0, 0)
    path = []
    while i and j and score[i, j]:
        if score[i, j] == score[i - 1, j - 1] + (2 if b[i - 1] == a[j - 1] else -1):
            path.append((j - 1, i - 1))
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return path[::-1]


def _folded(s: str) -> str:
    """Without case and accents, as long as before."""
    return s.lower() if s.isascii() else "".join(unicodedata.normalize("NFD", c)[0].lower()[:1] or c for c in s)


def relabel(source: list[tuple[str, str]], read: list[str], lines: list[int] | None = None, doc_share: float = 0.5, word_share: float = 0.6) -> tuple[list[str | None], int, int]:
    """A label for each word read from labelled source words, how many source characters met an equal one, and how many there are.

    Source words without letter or digit, and those with a label of DRAWN, are left out. Equal characters vote; the label seen first wins a
    tie. Where the whole text meets under ``doc_share``, its lines come in another order: each line read (``lines``: the number of each word's; one line without)
    is looked for alone. A word of which less than ``word_share`` met its equal is looked for on its own, and stays without a label if that fails too.
    """
    source = [(w, label) for w, label in source if label not in DRAWN and (w.isalnum() or any(c.isalnum() for c in w))]
    a, words = " ".join(_folded(w) for w, _ in source), [_folded(w) for w in read]
    b = " ".join(words)
    of = [label for w, label in source for _ in range(len(w) + 1)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    letters = sum(len(w) for w, _ in source)
    equal = lambda pairs, t: [(i, j) for i, j in pairs if a[i] == t[j] and a[i] != " "]
    few = doc_share * letters
    # What meets on a path is a common subsequence, whose greatest length costs a fraction of the path.
    pairs = equal(align(a, b), b) if longest_common(a.replace(" ", ""), b.replace(" ", "")) >= few else []
    if len(pairs) < few:
        number = lines if lines is not None else [0] * len(words)
        firsts = [k for k in range(len(words)) if k == 0 or number[k] != number[k - 1]]
        pairs = []
        for first, after in zip(firsts, [*firsts[1:], len(words)], strict=True):
            t = " ".join(words[first:after])
            pairs += [(i, starts[first] + j) for i, j in equal(local(a, t), t)]
    met = [j for _, j in pairs]  # pairs are in order of the reading
    votes = [bisect_left(met, s) for s in starts]
    out: list[str | None] = []
    for k, w in enumerate(words):
        own = [of[i] for i, _ in pairs[votes[k] : votes[k + 1]]]
        if len(own) < word_share * len(w):
            own = [of[i] for i, _ in equal(local(a, w), w)]
        enough = own and len(own) >= word_share * len(w)
        out.append((own[0] if own.count(own[0]) == len(own) else Counter(own).most_common(1)[0][0]) if enough else None)
    return out, len(set(met)), letters


def dealt(docs: DataFrame) -> DataFrame:
    """docs in as many tasks as there are cores, not by their size: aligning costs far more than its rows weigh."""
    spark = docs.sparkSession
    return docs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def relabel_documents(docs: DataFrame, *also: str, deal: bool = True) -> DataFrame:
    """docs: k, source (array of struct word, label), read (array of strings), perhaps lines (array of int); gives k, labels, met and characters (of the source), share, and the columns of ``also`` as they are.

    Documents are ``dealt`` out first; without ``deal`` they stay where they are: who has them as whole lines deals these, which weigh less than words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, labels, read, lines = (b.column(c).to_pylist() for c in ("words", "source_labels", "read", "lines"))
            done = [relabel(list(zip(w, s, strict=True)), r, n) for w, s, r, n in zip(words, labels, read, lines, strict=True)]
            out, met, characters = map(list, zip(*done, strict=True)) if done else ([], [], [])
            figures = [pa.array(out, pa.list_(pa.string())), pa.array(met, pa.int64()), pa.array(characters, pa.int64()), pa.array([m / max(1, c) for m, c in zip(met, characters, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("k"), *figures, *(b.column(c) for c in also)], names=["k", "labels", "met", "characters", "share", *also])

    ship(docs.sparkSession)
    lines = F.col("lines") if "lines" in docs.columns else F.lit(None).cast("array<int>")
    rows = docs.select(F.col("k").cast("bigint").alias("k"), F.col("source.word").alias("words"), F.col("source.label").alias("source_labels"), "read", lines.alias("lines"), *also)
    schema = StructType.fromDDL("k bigint, labels array<string>, met bigint, characters bigint, share double")
    for c in also:
        schema = schema.add(c, rows.schema[c].dataType)
    return (dealt(rows) if deal else rows).mapInArrow(run, schema)


def corpus_share(relabelled: DataFrame, keep_share: float = 0.5) -> DataFrame:
    """Of ``relabel_documents``: documents, how many are kept (share at least ``keep_share``), words and words with a label, the share of all source characters that met an equal one; one row."""
    with_label = F.size(F.filter("labels", lambda x: x.isNotNull()))
    return relabelled.agg(F.count("*").alias("documents"), F.count_if(F.col("share") >= keep_share).alias("kept"), F.sum(F.size("labels")).alias("words"), F.sum(with_label).alias("labelled"), (F.sum("met") / F.sum("characters")).alias("met_share"))
