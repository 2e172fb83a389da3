r"""Join of documents by the Jaccard similarity of their word shingles, over a token-group matrix.

The set of a document is its distinct shingles of ``words`` words (A-Z lower-cased), as 64-bit
hashes. The join is exact: no link between two different sets is lost.

1. Equal sets collapse into one representative.
2. Similar sets come together by three min-hashes; what is verified there forms groups (a
   group is named ``cluster`` below), one set alone being one too.
3. Each group's union of prefix tokens is stored as rows (token, group): the matrix. A
   set's prefix is as many of its tokens, rarest first, as a similar set must meet at least
   one of. The order comes from a sketch of fixed size that counts, over all documents, the
   tokens that repeat within a block of them; any order is exact.
4. A set queries the larger groups in which it meets a prefix token that sizes and places
   allow to be the first common one. For each such query and group the tokens that they
   share are added up: with what may still follow beyond the prefixes, they bound the overlap
   with any set of the group. Only groups whose bound reaches the threshold are opened: one of
   at most ``GROUP`` sets in full; of a larger one first ``FIRST`` sets, and all of it, in
   blocks, if none of them links.
5. Links give the components. Sets already in one group need no comparison with each other,
   so a group of copies of any size costs rows in proportion to it, never pairs.

A large cell or a group that many sets query is split into rooms; its few residents are copied
to each, the visitors are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import claim, join_figures, map_arrow, materialize, ship, trimmed
from .bloom import flagged
from .graph import components
from .substring_dedup import BASES, _gaps, _mix, _pack, _places, _unpack, word_hashes

GROUP = 128
FIRST = 16
#: Visitors of a room on average.
ROOM = 500
#: Clusters that a set is compared with while clusters form. The join stays exact beyond it.
LEADERS = 24
SKETCH = 1 << 22
SKETCH_PARTS = 16
#: Tokens in which repeats are looked for at a time.
BLOCK_TOKENS = 2_000_000
#: Rows of ids and numbers (some 50 bytes each) that are broadcast at most.
BROADCAST_ROWS = 300_000
REDUCER_TOKENS = 600_000
#: Tokens of a group's union in one row at most, and sets that one copy of it is compared with on average.
UNION_TOKENS, ASKERS = 200_000, 2_000
#: Pairs of a set and a group that are looked at at a time.
CELLS = 500_000
LEAST_REDUCERS = 64
HASHES = 3
PIECE_WORDS = 200_000


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append((text or "").encode().lower().split())
        size += len(held[-1])
        if size >= PIECE_WORDS:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(split: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    lengths = [len(w) for w in split]
    base = np.uint64(BASES[0])
    hashed = np.fromiter(map(word_hashes().__getitem__, chain.from_iterable(split)), np.uint64, sum(lengths))
    rolled = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * base + hashed[k : k + len(rolled)]
    rolled = _mix(rolled)
    at = 0
    for n in lengths:
        if n >= words:
            yield np.unique(rolled[at : at + n - words + 1])
        elif n:
            whole = n
            for h in hashed[at : at + n].tolist():
                whole = (whole * BASES[0] + h) % (1 << 64)
            yield _mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """First pass: a row per document (kind 0: id, n, print, m0...) and the sketch's parts of a partition (kind 1)."""
    names = ["kind", "doc_id", "n", "print", *[f"m{k}" for k in range(HASHES)]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * HASHES]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    part = lambda: TaskContext.get().partitionId()

    def repeats(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(sets))
        ends = np.flatnonzero(np.append(tokens[1:] != tokens[:-1], True))
        many = np.diff(ends, prepend=-1)
        cells, back = np.unique(tokens[ends[many > 1]] & np.uint64(SKETCH - 1), return_inverse=True)
        counts = np.bincount(back, many[many > 1], len(cells)).astype(np.int64) if len(cells) else np.zeros(0, np.int64)
        cuts = np.searchsorted(cells, np.arange(SKETCH_PARTS + 1).astype(np.uint64) * np.uint64(SKETCH // SKETCH_PARTS))
        rows = []
        for k in range(SKETCH_PARTS):
            own = slice(cuts[k], cuts[k + 1])
            places = cells[own].astype(np.int64) - k * (SKETCH // SKETCH_PARTS)
            rows.append((1, k, part(), _sparse(places, counts[own]), *[0] * HASHES))
        return batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [np.uint64(0xA24BAED4963EE407 * (2 * k + 1) & (1 << 64) - 1) for k in range(HASHES)]
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(shingle_sets(batch.column("text").to_pylist(), words))
            lengths = np.array([len(s) for s in sets])
            full = np.flatnonzero(lengths)
            least = np.zeros((HASHES, len(sets)), np.int64)
            if len(full):
                every, starts = np.concatenate(sets), (np.cumsum(lengths) - lengths)[full]
                for k, salt in enumerate(salts):
                    least[k, full] = np.minimum.reduceat(_mix(every ^ salt), starts).view(np.int64)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), pa.array(lengths.astype(np.int64)), pa.array(prints, pa.binary()), *[pa.array(x) for x in least]], names=names)
            for p, s in zip(prints, sets, strict=True):
                if len(s) and p not in seen:
                    seen.add(p)
                    held.append(s)
                    size += len(s)
                    if size >= BLOCK_TOKENS:
                        yield repeats(held)
                        held, seen, size = [], set(), 0
        if held:
            yield repeats(held)

    return map_arrow(docs, run, ", ".join(["kind int", "doc_id bigint", "n bigint", "print binary", *[f"m{k} bigint" for k in range(HASHES)]]), "words")


def _sparse(places: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = _gaps(places)
    return len(gaps).to_bytes(8, "little") + gaps + _pack(counts.astype(np.uint32))


def _read_sparse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = int.from_bytes(data[:8], "little") + 8
    return _places(data[8:cut]), _unpack(data[cut:], np.uint32)


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // SKETCH_PARTS, np.int64)
    for x in rows.column("print").to_pylist():
        places, counts = _read_sparse(x)
        total[places] += counts
    places = np.flatnonzero(total)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "print": pa.array([_sparse(places, np.minimum(total[places], 0xFFFFFFFF))], pa.binary())})


def _levels(profile: DataFrame) -> bytes:
    """How often the tokens of each sketch cell repeat, as a power of two; SKETCH bytes."""
    parts = profile.where("kind = 1").select(F.col("doc_id").alias("part"), (F.col("n") % 64).alias("some"), "print")
    once = parts.groupBy("part", "some").applyInArrow(_add, "part bigint, print binary")
    rows = once.groupBy("part").applyInArrow(_add, "part bigint, print binary").collect()  # SKETCH_PARTS rows of bounded size
    levels = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.uint8)
    for r in rows:
        places, counts = _read_sparse(r["print"])
        levels[r["part"], places] = np.ceil(np.log2(counts + 1.0))
    return levels.tobytes()


def _only(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """docs joined with ``needed`` (doc_id and more): broadcast up to BROADCAST_ROWS, else by shuffle behind a small Bloom filter that keeps other texts off the network."""
    if needed.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(needed), "doc_id")
    some = flagged(docs, "doc_id", needed.select("doc_id").distinct(), "maybe").where("maybe").select("doc_id", "text")
    return some.join(needed, "doc_id")


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare(rows: pa.Table, words: int, percent: int, among: bool) -> pa.Table:
    """One room: links of visitors with residents, and among visitors if asked for.

    A visitor that meets a cluster found here links with one of its members at most.
    """
    claim("words")
    residents, visitors = [], []
    every = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("resident").to_pylist(), rows.column("text").to_pylist(), strict=True), key=lambda r: r[0])
    for (doc_id, home, _), s in zip(every, shingle_sets([t for _, _, t in every], words), strict=True):
        (residents if home else visitors).append((doc_id, s))
    links: list[tuple[int, int]] = []
    if among:
        leaders = residents[:]
        for v, s in visitors:
            for r, t in leaders[:LEADERS]:
                if r != v and similar(s, t, percent):
                    links.append((v, r))
                    break
            else:
                leaders.append((v, s))
    else:
        sizes = np.array([len(t) for _, t in residents], np.int64)
        for v, s in visitors:
            n = len(s)
            for k in np.flatnonzero((100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))).tolist():
                r, t = residents[k]
                if r != v and similar(s, t, percent):
                    links.append((v, r))
                    break
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], schema=_LINK)


def _meet(docs: DataFrame, visits: DataFrame, homes: DataFrame, words: int, percent: int, among: bool) -> DataFrame:
    """Links found in rooms. visits: place, doc_id; homes: place, doc_id of its residents."""
    sizes = visits.groupBy("place").agg(F.ceil(F.count("*") / ROOM).cast("int").alias("rooms"))
    inside = visits.join(sizes, "place").select("place", F.pmod(F.xxhash64("doc_id", "place"), F.col("rooms")).cast("int").alias("room"), "doc_id", F.lit(False).alias("resident"))
    at_home = homes.join(sizes, "place").select("place", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"), "doc_id", F.lit(True).alias("resident"))
    needed = materialize(inside.unionByName(at_home))
    return _only(docs, needed).groupBy("place", "room").applyInArrow(lambda t: _compare(t, words, percent, among), "u bigint, v bigint")


_ASK = pa.schema([("r", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("rest", pa.binary())])


def _prefixes(docs: DataFrame, levels: bytes, words: int, percent: int) -> DataFrame:
    """Second pass: doc_id, the prefix tokens (rarest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                n = len(s)
                most = n - (percent * n + 99) // 100 + 1
                order = np.argsort(table[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")  # by level, then by hash
                out.append(s[order[: most if n else 0]].view(np.int64))
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))], names=["doc_id", "tokens"])

    return map_arrow(docs, run, "doc_id bigint, tokens array<bigint>", "words")


def _columns(rows: DataFrame, reducers: int) -> DataFrame:
    """Blocks of sets (doc_id, cluster, weight, n, tokens) as one row of the matrix per reducer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "cluster", "weight", "n")]).astype(np.int64)
            lists = batch.column("tokens")
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            every = lists.flatten().to_numpy().view(np.uint64)
            n = head[3][owner]
            place = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rest = (-(-(n - place) * 255 // n)).astype(np.uint8)  # share of the set from this token on, rounded up
            to = (_mix(every) % np.uint64(reducers)).astype(np.int64)
            order = np.lexsort((owner, to))
            cuts = np.searchsorted(to[order], np.arange(reducers + 1))
            for r in range(reducers):
                own = order[cuts[r] : cuts[r + 1]]
                if len(own):
                    who, counts = np.unique(owner[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_pack(head[:, who])], pa.binary()), pa.array([_pack(counts.astype(np.uint32))], pa.binary()), pa.array([every[own].tobytes()], pa.binary()), pa.array([rest[own].tobytes()], pa.binary())], schema=_ASK)

    return map_arrow(rows, run, "r int, docs binary, counts binary, tokens binary, rest binary", "words")


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """Distinct columns of arrays of two rows."""
    every = np.concatenate(pairs, axis=1)
    every = every[:, np.lexsort(every)]
    return every[:, np.append(True, (every[:, 1:] != every[:, :-1]).any(0))[: every.shape[1]]]


def _query(group: pa.Table, percent: int) -> pa.Table:
    """One reducer: (set, cluster) that share a prefix token and may hold similar sets.

    Sets of a and b tokens need an overlap of percent / (100 + percent) * (a + b). If the token is the
    first that they share, the overlap is at most what either has from it on; so each can only
    go with sets up to a size ``reach``. A pair is found by its first common token at the latest.
    """
    heads, owners, tokens, rests, base = [], [], [], [], 0
    for d, c, t, r in zip(*[group.column(x).to_pylist() for x in ("docs", "counts", "tokens", "rest")], strict=True):
        head = _unpack(d, np.int64).reshape(4, -1)
        heads.append(head)
        owners.append(np.repeat(np.arange(base, base + head.shape[1]), _unpack(c, np.uint32)))
        tokens.append(np.frombuffer(t, np.uint64))
        rests.append(np.frombuffer(r, np.uint8))
        base += head.shape[1]
    ids, cluster, weight, size = np.concatenate(heads, axis=1)
    owner, token = np.concatenate(owners), np.concatenate(tokens)
    left = -(-np.concatenate(rests).astype(np.int64) * size[owner] // 255)
    reach = left * (100 + percent) // percent - size[owner]
    order = np.lexsort((cluster[owner], token))
    owner, token, reach = owner[order], token[order], reach[order]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    ends = np.append(starts[1:], len(token))
    mixed = cluster[owner[starts]] != cluster[owner[ends - 1]]
    found = [np.zeros((2, 0), np.int64)]
    held = 0
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        mine = owner[a:b]
        c = cluster[mine]  # ascending
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        far = reach[a:b]
        few, most = np.minimum.reduceat(size[mine], head), np.maximum.reduceat(far, head)
        names, heavy = c[head], weight[mine][head]
        step = max(1, CELLS // len(head))
        for at in range(0, len(mine), step):
            x = mine[at : at + step]
            w, own, n = weight[x][:, None], cluster[x][:, None], size[x][:, None]
            q, g = np.nonzero(((heavy > w) | (heavy == w) & (names > own)) & (n <= most) & (few <= far[at : at + step][:, None]))
            if len(q):
                found.append(np.stack([ids[x[q]], names[g]]))
                held += len(q)
            if held > 2 * CELLS:
                found, held = [_distinct(found)], 0
    pairs = _distinct(found)
    return pa.table({"doc_id": pa.array(pairs[0], pa.int64()), "cluster": pa.array(pairs[1], pa.int64())})


def _spare(a: Column, b: Column, percent: int) -> Column:
    """100 * (100 + percent) times the prefix tokens that sets of a and b tokens must share beyond none.

    They need percent / (100 + percent) * (a + b) common tokens. Up to the earlier end of the two
    prefixes all common tokens are in both; after it come fewer than percent / 100 of the larger set.
    """
    return percent * (100 * (a + b) - (100 + percent) * F.greatest(a, b))


def qualifying(queries: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The queries (doc_id, cluster) whose overlap with the group can reach the threshold.

    placed: doc_id, n, cluster, few, most (the least and greatest set of the group), tokens (the
    prefix). For each query and group the tokens of the query's prefix in the union of the
    group's prefixes are counted. ``_spare`` is least at an end of the sizes that the group has
    and the threshold allows; where it is below one token, the token that brought the query
    here is enough, and nothing is counted.
    """
    one = 100 * (100 + percent)
    groups = placed.select("cluster", "few", "most").distinct()
    sized = queries.join(groups, "cluster").join(placed.select("doc_id", "n"), "doc_id")
    low, high = F.greatest(F.col("few"), F.ceil(F.col("n") * percent / 100)), F.least(F.col("most"), F.floor(F.col("n") * 100 / percent))
    sized = sized.withColumn("low", low.cast("bigint")).withColumn("high", high.cast("bigint")).where("low <= high")
    sized = materialize(sized.select("doc_id", "cluster", F.least(_spare(F.col("n"), F.col("low"), percent), _spare(F.col("n"), F.col("high"), percent)).alias("spare")))
    rest = sized.where(F.col("spare") >= one)
    asked = rest.groupBy("cluster").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("rooms"))
    held = materialize(placed.groupBy("cluster").agg(F.sum(F.size("tokens")).alias("held")).join(asked, "cluster"))
    few, many = (held.where(F.col("held") <= UNION_TOKENS).select("cluster", "rooms"), held.where(F.col("held") > UNION_TOKENS).select("cluster"))

    # the union as one array, copied to the rooms of a group that many sets query; only prefixes that are needed are shuffled
    dealt = materialize(rest.join(few, "cluster").withColumn("room", F.pmod(F.xxhash64("doc_id"), F.col("rooms")).cast("int")).drop("rooms"))
    own = flagged(placed.select("doc_id", "tokens"), "doc_id", dealt.select("doc_id").distinct(), "maybe").where("maybe").drop("maybe")
    union = flagged(placed.select("cluster", "tokens"), "cluster", few.select("cluster"), "maybe").where("maybe").groupBy("cluster").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union")).join(few, "cluster")
    union = union.select("cluster", "union", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"))
    enough = dealt.join(own, "doc_id").join(union, ["cluster", "room"]).where(F.size(F.array_intersect("tokens", "union")) * one > F.col("spare")).select("doc_id", "cluster")
    if not many.isEmpty():  # unions too large for a row, by rows
        askers = rest.join(many, "cluster", "left_semi").join(placed.select("doc_id", "tokens"), "doc_id").select("cluster", F.explode("tokens").alias("token"), "doc_id", "spare")
        tokens = placed.select("cluster", "tokens").join(many, "cluster", "left_semi").select("cluster", F.explode("tokens").alias("token")).distinct()
        large = askers.join(tokens, ["cluster", "token"]).groupBy("doc_id", "cluster", "spare").agg(F.count("*").alias("shared")).where(F.col("shared") * one > F.col("spare"))
        enough = enough.unionByName(large.select("doc_id", "cluster"))
    return sized.where(F.col("spare") < one).select("doc_id", "cluster").unionByName(enough)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components under the join: doc_id, n_shingles, component_id, one row per input row.

    Two documents link when 100 * intersection >= percent * union. Documents with fewer words
    than a shingle have their whole sequence as one; those without words (null, empty, white
    space) have an empty set, link with nothing and are their own component. component_id is
    the least id reachable. Rows that repeat an id are one document that links through each of
    their texts; rows with a null id count as unlinked. Texts may be of any length: a set is
    held whole, 8 bytes a word, in one task. Other columns are ignored; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    profile = materialize(_profile(docs, words))
    every = profile.where("kind = 0")
    full = every.where("n > 0 and doc_id is not null")
    sets = materialize(full.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(f"m{k}").alias(f"m{k}") for k in range(HASHES)]))

    cells = sets.select("doc_id", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col(f"m{k}")) for k in range(HASHES)])).alias("cell"))
    pivots = cells.groupBy("cell").agg(F.min("doc_id").alias("place"), F.count("*").alias("many")).where("many > 1")
    visits = materialize(cells.join(pivots, "cell").where("doc_id <> place").select("place", "doc_id").distinct())
    near = materialize(_meet(docs, visits, visits.select("place", F.col("place").alias("doc_id")).distinct(), words, percent, True))
    clusters = components(near)

    labels = sets.select("doc_id", "n").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("cluster"))
    weights = labels.groupBy("cluster").agg(F.count("*").alias("weight"), F.min("n").alias("few"), F.max("n").alias("most"))
    labels = materialize(labels.join(weights, "cluster"))
    many, tokens = labels.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    reducers = max(LEAST_REDUCERS, -(-tokens * (100 - percent) // 100 // REDUCER_TOKENS))
    placed = materialize(_prefixes(docs, _levels(profile), words, percent).join(F.broadcast(labels) if many <= BROADCAST_ROWS else labels, "doc_id"))
    asked = _columns(placed, reducers).groupBy("r").applyInArrow(lambda t: trimmed(_query(t, percent)), "doc_id bigint, cluster bigint")
    queries = materialize(qualifying(materialize(asked.distinct()), placed, percent))
    whole = clusters.select(F.col("node").alias("u"), F.col("component").alias("v"))  # a cluster's links stand for it: its sets with the least one

    opened = labels.join(queries.select("cluster").distinct(), "cluster").select("cluster", "doc_id", "weight")
    some = opened.where(F.col("weight") > GROUP).groupBy("cluster", F.pmod(F.xxhash64("doc_id"), F.lit(FIRST))).agg(F.min("doc_id").alias("doc_id"))
    homes = opened.where(F.col("weight") <= GROUP).select("cluster", "doc_id").unionByName(some.select("cluster", "doc_id"))
    first = materialize(_meet(docs, queries.select(F.col("cluster").alias("place"), "doc_id"), homes.withColumnRenamed("cluster", "place"), words, percent, False))
    whole = whole.unionByName(first)
    large = opened.where(F.col("weight") > GROUP).select("cluster", "weight").distinct()
    if not large.isEmpty():  # sets that no one of the first links with meet the whole cluster, unless they got there otherwise
        parts = components(whole)
        left = queries.join(large, "cluster").join(parts.select(F.col("node").alias("cluster"), F.col("component").alias("there")), "cluster", "left").join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("here")), "doc_id", "left")
        left = left.where(~F.coalesce("here", "doc_id").eqNullSafe(F.coalesce("there", "cluster"))).select("doc_id", "cluster", "weight")
        grp = lambda k: F.xxhash64("cluster", k.cast("bigint"))
        blocks = F.ceil(F.col("weight") / GROUP)
        visits = materialize(left.select("doc_id", "cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("k")).select("doc_id", grp(F.col("k")).alias("place")))
        members = opened.where(F.col("weight") > GROUP).select(grp(F.pmod(F.xxhash64("doc_id"), blocks)).alias("place"), "doc_id").join(visits.select("place").distinct(), "place")
        whole = whole.unionByName(_meet(docs, visits, members, words, percent, False))
    final = components(materialize(whole)).withColumnRenamed("node", "first_id")
    firsts = full.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).join(final, "first_id", "left")
    firsts = materialize(firsts.select("print", F.coalesce("component", "first_id").alias("component_id"), "copies"))
    linked = join_figures(full.select("print", "doc_id", "n"), firsts, "print", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
