"""Packing by concatenation and cutting.

The first pass tokenises, and gives every row the number of ids before it in its partition.
The partition totals, one number a partition, are summed up in order, which turns those
into offsets in the concatenation of all documents. The second pass cuts each document at
the multiples of the window; a document across a boundary gets a record on either side.
Neither pass shuffles a text or an id.
"""

from __future__ import annotations

import json
import os
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialize

#: Bytes of text whose words are made distinct at a time.
PIECE_BYTES = 6_000_000
#: Words of a gather at a time.
GATHER_WORDS = 200_000
#: Frequent words that a worker remembers, of at most so many characters.
KNOWN, KNOWN_CHARS = 150_000, 32
#: Words that the library gets at a time.
BATCH = 2000
#: Latin letters, then perhaps ASCII punctuation, which begins neither a special token nor a suffix like 's.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = rf"^(?P<stem>[{LETTERS}]+)(?P<tail>[!-&(-/:;=?@\x5b-\x60{{-~]*)$"
#: Normalizer and pre-tokenizer under which a plain word is its stem in lower case, then its tail.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Characters that such a vocabulary has for bytes; a space stays one.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTES = "".join(chr(b) if b in _SHOWN or b == 32 else chr(256 + _HIDDEN.index(b)) for b in range(256))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Ids of whole texts under a vocabulary that drops white space (.json of tokenizers).

    Arrow splits the texts of a piece at ASCII white space and makes the words distinct; the
    library encodes each of these once, since nothing in such a vocabulary looks past a word;
    NumPy puts the ids in the places of the words. Where normalizer and pre-tokenizer are the
    known ones, plain words are parted into stem and tail: each stem in lower case goes once to
    the library's model, without the steps that would leave it as it is, many at a time. As many
    word ends come back as there are stems, which tells whose ids are whose.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        if suffix and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, int] = {}  # words to their places in the arrays below
        self.kept = np.zeros(0, f"<u{self.width}")
        self.kept_starts, self.kept_lengths = np.zeros((2, 0), np.int64)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words as the library gives them, and how many each has."""
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(rows)), f"<u{self.width}"), np.fromiter(map(len, rows), np.int64, len(rows))

    def stems(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for stems of plain words in lower case."""
        text = charmap_decode(" ".join(words).encode(), "strict", BYTES)[0]
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(ids) else self.library(words)

    def looked_up(self, words: list[str], counts: np.ndarray, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct words begin and how many they are. counts: how often the words occur."""
        slots = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        unknown = [words[i] for i in new.tolist()]
        parts = [encode(unknown[at : at + BATCH]) for at in range(0, len(unknown), BATCH)]
        starts, lengths = np.zeros((2, len(words)), np.int64)
        old = slots >= 0
        starts[old], lengths[old] = self.kept_starts[slots[old]], self.kept_lengths[slots[old]]
        if parts:
            lengths[new] = np.concatenate([n for _, n in parts])
            starts[new] = len(self.kept) + np.cumsum(lengths[new]) - lengths[new]
        flat = np.concatenate([self.kept, *(ids for ids, _ in parts)])
        if len(self.known) < KNOWN:
            often = [i for i in new[counts[new] > 2].tolist() if len(words[i]) <= KNOWN_CHARS][: KNOWN - len(self.known)]
            n = lengths[often]
            self.known.update(zip((words[i] for i in often), range(len(self.known), len(self.known) + len(often)), strict=True))
            self.kept_starts = np.concatenate([self.kept_starts, len(self.kept) + np.cumsum(n) - n])
            self.kept_lengths = np.concatenate([self.kept_lengths, n])
            self.kept = np.concatenate([self.kept, gather(flat, starts[often], n)])
        return flat, starts, lengths

    def distinct(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct words of any kind."""
        if self.bare is None:
            return self.looked_up(words.to_pylist(), counts, self.library)
        parts = pc.extract_regex(words, PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        odd = self.looked_up(words.filter(pa.array(~plain)).to_pylist(), counts[~plain], self.library)
        parts = parts.drop_null()
        found, places = [odd], [np.flatnonzero(~plain)]
        for part, encode in ((pc.utf8_lower(parts.field("stem")), self.stems), (parts.field("tail"), self.library)):
            index = part.dictionary_encode()
            place = index.indices.to_numpy().astype(np.int64)
            often = np.bincount(place, counts[plain], len(index.dictionary))
            flat, starts, lengths = self.looked_up(index.dictionary.to_pylist(), often, encode)
            found.append((flat, starts[place], lengths[place]))
            places.append(np.flatnonzero(plain))
        # a word is two runs of ids, those of its stem and its tail; an odd word has one
        flat = np.concatenate([f for f, _, _ in found])
        before = np.cumsum([0, *(len(f) for f, _, _ in found)])
        runs = np.zeros((2, len(words), 2), np.int64)
        for (_, starts, lengths), place, side, at in zip(found, places, (0, 0, 1), before[:3], strict=True):
            runs[0, place, side], runs[1, place, side] = starts + at, lengths
        lengths = runs[1].sum(1)
        return gather(flat, runs[0].ravel(), runs[1].ravel()), np.cumsum(lengths) - lengths, lengths

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each; null is an empty text."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        index = split.flatten().dictionary_encode()
        place = index.indices.to_numpy()
        flat, starts, lengths = self.distinct(index.dictionary, np.bincount(place, minlength=len(index.dictionary)))
        offsets = offsets - offsets[0]
        out: list[bytes] = []
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GATHER_WORDS, side="right")) - 1)
            some = place[offsets[row] : offsets[last]]
            n = lengths[some]
            cuts = np.concatenate([[0], np.cumsum(n)])[offsets[row : last + 1] - offsets[row]]
            raw, w = gather(flat, starts[some], n).tobytes(), self.width
            out += [raw[w * a : w * b] for a, b in pairwise(cuts.tolist())]
            row = last
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of a partition in pieces of about PIECE_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= PIECE_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(c).cast(t) for b in held]) for c, t in (("doc_id", pa.int64()), ("text", pa.large_string())))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: doc_id, part, before (ids of the partition before this row), n, ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = word_ids(tokenizer), 0, TaskContext.get().partitionId()
        end = coder.pack([end_id])
        for ids, columns in _pieces(batches):
            rows = [x + end for x in coder.encode(columns)]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // coder.width
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            for at in range(0, len(rows), 4096):
                to = at + 4096
                yield pa.RecordBatch.from_arrays([ids[at:to], pa.array(np.full(len(rows[at:to]), part, np.int32)), pa.array(starts[at:to]), pa.array(lengths[at:to]), pa.array(rows[at:to], pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    return map_arrow(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")), run, "doc_id bigint, part int, before bigint, n bigint, ids binary", "ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids, one row per piece.

    doc_id, start, length, ids_crc32 (of unsigned 32-bit little-endian ids), doc_tokens (with
    the end id), sequence_id, offset. Every sequence is full but the last. Null text counts as
    empty: its document is the end id alone. Rows that repeat an id are packed as documents of
    their own; other columns are ignored; an empty table gives no piece. The order of documents
    in the concatenation is that of the input partitions.
    """
    spark = docs.sparkSession
    first = materialize(tokenised(docs, tokenizer, end_id, doc_id, text))
    totals = first.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()  # a row per input partition
    bases, base = [], 0
    for row in totals:
        bases.append((row["part"], base))
        base += row["total"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, at, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                packed = ids.as_buffer()
                wide = memoryview(np.frombuffer(packed, f"<u{packed.size // n}").astype("<u4").tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    out.append((row, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, sequence, offset))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    starts = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))  # 12 bytes per input partition
    rows = first.join(starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return map_arrow(rows, cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "ids")
