"""Repair of the turn structure of conversations: an auction algorithm for shortest paths.

A conversation is a lattice: a layer per row, in each the four states of ``(s?(ua)+)?`` (nothing yet,
after the system row, after a user row, after an assistant row), and arcs for the edits with
whole costs. Every node has a price, at first too low. A path from a state grows along the cheapest arc
(cost plus price of its end; of equal ones the first by letter) as long as that cost is the price of its
end node; else the price rises to it and the path gives up that node. When it arrives, the prices along
shortest paths are the costs still to come, arcs between them are tight, and following the
tight arc with the first letter gives the least audit. Windows of a few rows are solved from the last to
the first, the prices of one being the end of the next, so prices rise a little at a time.

Rows are sorted by conversation into partitions. A conversation inside a partition is
repaired there. Those at the ends of partitions (a very long one fills many) are repaired by pieces:
each piece gives its cost from any state to any other, these add up to the prices at its end, with which
each piece is traced alone. Only the hash over the repaired text of such a conversation goes
through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_arrow, materialize, ship

#: Bytes of a sorted partition, and rows of a window of the auction.
PARTITION_BYTES, WINDOW = 32_000_000, 16
#: More than the prices of two states of a layer can differ.
FAR = 64
SPACE = " \t\n\x0b\x0c\r"
#: State that a user or assistant row leads to from each state.
STEP = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2, "": 4}
SOUND, GONE, CUT = range(3)
END = 15
LEGAL = {"su", "ua", "au"}

FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROW = "none boolean, conv bigint, turn bigint, role string, text string, digest binary, gone boolean"


def _keep(state: int, initial: int) -> int | None:
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    if initial == 2:
        return 3 if state == 2 else None
    return state if initial == 4 else None


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row in order of letter: letter, cost, node they lead to, counted from the layer's first."""
    if code == END:
        return [[("", 0, 4)] * (s in (0, 3)) + [("I", 3, STEP[s])] for s in range(4)]
    initial, fault = divmod(code, 3)
    more, out = 3 * (fault == CUT), []
    for s in range(4):
        arcs, kept = [("D", 4, 4 + s), ("I", 3, STEP[s])], _keep(s, initial)
        if fault != GONE:
            if kept is not None:
                arcs.append(("K", more, 4 + kept))
            arcs.append(("R", 3 + more, 4 + STEP[s]))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(END + 1)]


def auction(codes: bytes, end: list[int]) -> list[int]:
    """Prices of a window's nodes (layer by layer, then ``end``), exact along the shortest paths from all states of its first layer."""
    last = 4 * len(codes)
    price = [min(end)] * last + end
    for origin in range(4):
        path = [origin]
        while path[-1] < last:
            node = path[-1]
            layer, best, to = node & ~3, None, 0
            for _, cost, step in ARCS[codes[node >> 2]][node & 3]:
                if best is None or cost + price[layer + step] < best:
                    best, to = cost + price[layer + step], layer + step
            if best > price[node]:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def prices(codes: bytes, end: list[int]) -> list[int]:
    """Prices of all nodes, window by window from the last."""
    parts = []
    for at in range((max(0, len(codes) - 1)) // WINDOW * WINDOW, -1, -WINDOW):
        price = auction(codes[at : at + WINDOW], end)
        parts.append(price[:-4])
        end = price[:4]
    parts.reverse()
    return [p for part in parts for p in part]


def trace(codes: bytes, price: list[int], state: int) -> tuple[str, int]:
    """Letters along the tight arcs, the first by letter at each node, and the state at the end. price: of all nodes and the end."""
    node, letters = state, []
    while node < 4 * len(codes):
        letter, cost, step = next(a for a in ARCS[codes[node >> 2]][node & 3] if price[node] == a[1] + price[(node & ~3) + a[2]])
        letters.append(letter)
        node = (node & ~3) + step
    return "".join(letters), node & 3


def _whole(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    codes += bytes([END])
    price = [*prices(codes, [0] * 4), 0, 0, 0, 0]
    return price[0], trace(codes, price, 0)[0]


_remembered = lru_cache(1 << 16)(_whole)


def code_of(role: str, text: str, known: bool) -> int:
    """A row as a number: what its role begins with, and its first fault."""
    body = text.rstrip(SPACE)
    fault = GONE if not body or known else CUT if body[-1] not in ".!?" else SOUND
    return INITIALS.get(role[:1], 3) * 3 + fault


def render(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """The repaired rows as role:text. rows: role and text; state: the one before them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = STEP[state]
            out.append(f"{ROLE[state]}:")
            continue
        role, text = rows[at]
        at += 1
        if letter == "R":
            state = STEP[state]
            out.append(f"{ROLE[state]}:{text}")
        elif letter == "K":
            state = _keep(state, INITIALS.get(role[:1], 3))
            out.append(f"{role}:{text}")
    return out


class Rows:
    """Rows of a conversation or a piece of it, in order."""

    def __init__(self, known: set[bytes] | None = None):
        self.rows: list[tuple[str, str]] = []
        self.codes, self.counts = bytearray(), [0, 0, 0]
        self.turns: set[int] = set()
        self.known, self.seen, self.illegal = known or set(), set(), 0

    def add(self, turn: int | None, role: str, text: str, digest: bytes) -> None:
        again = digest in self.seen or digest in self.known
        code = code_of(role, text, again)
        fault = code % 3
        if fault == CUT:
            self.counts[2] += 1
        elif fault == GONE:
            self.counts[1 if text.strip(SPACE) else 0] += 1
        if self.rows:
            self.illegal += self.rows[-1][0][:1] + role[:1] not in LEGAL
        self.codes.append(code)
        self.seen.add(digest)
        self.rows.append((role, text))
        if turn is not None:
            self.turns.add(turn)

    def solved(self) -> tuple:
        """The figures of a whole conversation."""
        cost, audit = (_remembered if len(self.codes) <= 32 else _whole)(bytes(self.codes))
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        return (gaps, *self.counts, self.illegal, cost, audit, hashlib.sha256("\n".join(render(self.rows, audit, 0)).encode()).hexdigest())


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, dealt to partitions of about PARTITION_BYTES."""
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    order = ["none", "conv", "turn", "digest", "tie"]
    tied = rows.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))  # equal rows alone are dealt out by it
    return tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")


def _inside(rows: DataFrame) -> DataFrame:
    """Figures of the conversations inside a partition; rows (part, at) of its first and last one."""
    kinds = [("none", pa.bool_()), ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("gone", pa.bool_())]
    more = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    schema = pa.schema([*kinds, ("part", pa.int32()), ("at", pa.int64()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, first, key, held = TaskContext.get().partitionId(), 0, True, None, []
        out: list[tuple] = []

        def edge() -> None:
            nonlocal at
            for r in held:
                out.append((*r, part, at, *[None] * len(more)))
                at += 1
            held.clear()

        def batches_of() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[i : i + 1024]], f.type) for j, f in enumerate(schema)], schema=schema)
            out.clear()

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (r[0], r[1]) != key:
                    if key is not None and not first:
                        whole = Rows()
                        for x in held:
                            if not x[6]:
                                whole.add(x[2], x[3], x[4], x[5])
                        held.clear()
                        out.append((*key, *[None] * 7, *whole.solved()))
                    elif key is not None:
                        edge()
                        first = False
                    key = (r[0], r[1])
                held.append(r)
                if first and len(held) >= 1024:
                    edge()
            yield from batches_of()
        edge()
        yield from batches_of()

    return map_arrow(rows, run, f"{ROW}, part int, at bigint, {FIGURES}")


PIECE = "none boolean, conv bigint, part int, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, least bigint, most bigint, turns bigint, costs array<bigint>"
KEY = ["none", "conv"]


def _piece(key, rows: pa.Table, earlier: pa.Table) -> pa.Table:
    """One row for a piece: its rows as numbers, its counts, and its costs between states (targets by origins)."""
    mine = Rows(set(earlier.column("digest").to_pylist()))
    for r in sorted(rows.to_pylist(), key=lambda r: r["at"]):
        if not r["gone"]:
            mine.add(r["turn"], r["role"], r["text"], r["digest"])
    codes = bytes(mine.codes)
    costs: list[int] = []
    for t in range(4):
        end = [FAR * (s != t) for s in range(4)]
        costs += (prices(codes, end) if codes else end)[:4]
    ends = [mine.rows[0][0][:1], mine.rows[-1][0][:1]] if mine.rows else [None, None]
    row = [*[k.as_py() for k in key], codes, *mine.counts, mine.illegal, *ends, min(mine.turns, default=None), max(mine.turns, default=None), len(mine.turns), costs]
    names = ["none", "conv", "part", "codes", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns", "costs"]
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64())]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


TOTALS = "none boolean, conv bigint, part int, end array<bigint>, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _totals(pieces: pa.Table) -> pa.Table:
    """Prices at the end of each piece of a conversation (null: it is the last); its figures beside the first piece."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["part"])
    end = [0, 6, 3, 0]
    for r in reversed(rows):
        r["end"], costs = end, r["costs"]
        end = [min(costs[4 * t + s] + end[t] for t in range(4)) for s in range(4)]
    rows[-1]["end"] = None
    distinct, low, high, illegal, last = 0, None, None, 0, None
    for r in rows:
        if r["turns"]:
            distinct += r["turns"] - (high == r["least"])
            low, high = r["least"] if low is None else low, r["most"]
        if r["first"] is not None:
            illegal += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
    figures = [high - low + 1 - distinct if distinct else 0, *[sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")], illegal + sum(r["illegal"] for r in rows), end[0]]
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    first = [[v] + [None] * (len(rows) - 1) for v in figures]
    columns = [pa.array([r[c] for r in rows], k) for c, k in (("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("end", pa.list_(pa.int64())))]
    return pa.table([*columns, *[pa.array(c, pa.int64()) for c in first]], ["none", "conv", "part", "end", *names])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, exits = [], []
        for codes, end in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist(), strict=True):
            if end is None:
                codes, end = codes + bytes([END]), [0] * 4
            price = [*(prices(codes, end) if codes else []), *end]
            found = [trace(codes, price, s) for s in range(4)]
            audits.append([a for a, _ in found])
            exits.append([s for _, s in found])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("none", "conv", "part")], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], ["none", "conv", "part", "audits", "exits"])


def _entries(pieces: pa.Table) -> pa.Table:
    """The state in which the repaired conversation comes to each piece."""
    state, rows = 0, sorted(pieces.to_pylist(), key=lambda r: r["part"])
    for r in rows:
        r["entry"], state = state, r["exits"][state]
    return pa.table([pa.array([r[c] for r in rows], k) for c, k in (("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()))], ["none", "conv", "part", "entry"])


def _rendered(key, rows: pa.Table, traced: pa.Table) -> pa.Table:
    kept = [(r["role"], r["text"]) for r in sorted(rows.to_pylist(), key=lambda r: r["at"]) if not r["gone"]]
    audit, entry = traced.column("audit")[0].as_py(), traced.column("entry")[0].as_py()
    lines = render(kept, audit, entry)
    body = "\n".join(lines).encode() if lines else None
    values = [*[k.as_py() for k in key], audit, body]
    return pa.table([pa.array([v], k) for v, k in zip(values, (pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.large_binary()), strict=True)], ["none", "conv", "part", "audit", "body"]).cast(pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("audit", pa.string()), ("body", pa.binary())]))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rendered pieces, which come in order."""
    key, audits, digest, begun = None, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.bool_()), pa.array([key[1]], pa.int64()), pa.array(["".join(audits)], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["none", "conv", "audit", "repaired_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            none, conv, audit, body = (batch.column(c)[i].as_py() for c in ("none", "conv", "audit", "body"))
            if (none, conv) != key:
                if key is not None:
                    yield row()
                key, audits, digest, begun = (none, conv), [], hashlib.sha256(), False
            audits.append(audit)
            if body is not None:
                digest.update(b"\n" + body if begun else body)
                begun = True
    if key is not None:
        yield row()


def _pieced(edges: DataFrame) -> DataFrame:
    """Figures of the conversations at the ends of partitions."""
    place = [*KEY, "part"]
    first = F.row_number().over(Window.partitionBy(*KEY, "digest").orderBy("part"))
    earlier = edges.where("not gone").select(*place, "digest").distinct().withColumn("n", first).where("n > 1").drop("n")
    pieces = materialize(edges.groupBy(*place).cogroup(earlier.groupBy(*place)).applyInArrow(_piece, PIECE))
    totals = materialize(pieces.drop("codes").groupBy(*KEY).applyInArrow(_totals, TOTALS))
    ends = pieces.select(*place, "codes").join(totals.select(*place, "end"), place)
    traces = materialize(map_arrow(ends, _traces, "none boolean, conv bigint, part int, audits array<string>, exits array<int>"))
    entries = traces.drop("audits").groupBy(*KEY).applyInArrow(_entries, "none boolean, conv bigint, part int, entry int")
    chosen = traces.join(entries, place).select(*place, "entry", F.col("audits")[F.col("entry")].alias("audit"))
    bodies = edges.groupBy(*place).cogroup(chosen.groupBy(*place)).applyInArrow(_rendered, "none boolean, conv bigint, part int, audit string, body binary")
    done = map_arrow(bodies.repartition(*KEY).sortWithinPartitions(*place), _hashes, "none boolean, conv bigint, audit string, repaired_sha256 string")
    return totals.where("cost is not null").drop("part", "end").join(done, KEY)


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows with known faults, chosen by crc32 of ``conv_id:turn`` modulo 20.

    Nulls in that key, in role and in text count as one space. 0: gone; 1: empty text; 2: text without its ``.!?``;
    3: the row twice; 4: role user.
    """
    named = rows.select(*[F.col(f"`{old}`").cast(kind).alias(new) for new, old, kind in (("conv_id", conv_id, "bigint"), ("turn", turn, "bigint"), ("role", role, "string"), ("text", text, "string"))])
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text_ = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    out = named.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_, "[.!?]", "")).otherwise(text_).alias("text"),
        (kind == 0).alias("gone"),
        kind.alias("kind"),
    )
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row per conversation.

    Rows count in order of turn, nulls first, those of one turn by the SHA-256 of the role's length, ``:``, role and text. The first
    fault of a row counts: blank (white space alone), duplicate (role and text came before), truncated (doesn't end in
    ``.!?``, white space aside). gaps: missing turns between the first and the last, nulls aside. illegal: neighbours whose roles don't begin with su,
    ua or au. audit: the edits of least cost that make the roles' initials ``(s?(ua)+)?``, the first of these in ASCII order: Keep 0,
    Rerole 3, Delete 4 (blank and duplicate rows must go), Insert 3, and 3 for a truncated row that stays. repaired_sha256: of the repaired
    rows as ``role:text``, joined by newlines.

    Null roles and texts count as one space; an empty role has no initial, so it can stay anywhere. A null conv_id is a
    conversation. gone: a boolean column of rows that only name their conversation; without other rows it has zeros, an empty audit and the hash of nothing.
    Texts are read whole. An empty table gives no rows; other columns are ignored.
    """
    ship(rows.sparkSession)
    named = rows.select(
        F.col(f"`{conv_id}`").isNull().alias("none"),
        F.coalesce(F.col(f"`{conv_id}`").cast("bigint"), F.lit(0)).alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    found = materialize(_inside(_sorted(named.select("none", "conv", "turn", "role", "text", digest.alias("digest"), "gone"))))
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    edges = found.where("part is not null").select("none", "conv", "part", "at", "turn", "role", "text", "digest", "gone")
    done = found.where("part is null").select(*KEY, *figures).unionByName(_pieced(edges).select(*KEY, *figures))
    return done.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *figures)
