"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Equal vectors collapse into one with a count. A hash rotates the vector by three rounds of
random signs and a fast Hadamard transform, takes the nearest signed axis, and joins ``k``
of these to a bucket; k grows with the logarithm of the number of vectors. In each table a
vector lives in its own bucket and visits the next likely ones (multiprobe). What meets in a
bucket is compared in double precision by a block product.

A pair that meets several times counts where it meets first, which each room sees from the
buckets that travel with a vector; so rooms put out a row per vector (its links, and the
leader of its cluster), never pairs. First only bucket numbers and ids are dealt out; vectors go
to the buckets in which one lives and another meets it, as narrow as they came (4 bytes a
component of floats) and with bucket numbers of 4 bytes where these suffice. Buckets beyond ``ROOM`` vectors are
split into chunks, and each pair of chunks is a room of its own: no candidate is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import join_figures, map_arrow, materialize, ship
from .graph import components

ROOM = 512
PROBES = 3
TABLES = 8
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, tables: int, k: int, probes: int) -> np.ndarray:
    """Bucket numbers, n x tables x (1 + probes); the vector's own comes first."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.default_rng([SEED, dim, k])
    alternatives = min(1 + probes, d)
    out = np.full((n, tables, 1 + probes), -1, np.int64)  # -1: there are fewer neighbours than probes
    for t in range(tables):
        base, swaps, costs = np.full(n, dim, np.int64), [], []
        for _ in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :alternatives]
            value = np.take_along_axis(y, axis, 1)
            code = axis + d * (value < 0)
            base = base * (2 * d) + code[:, 0]
            for swap in swaps:
                swap *= 2 * d
            for a in range(1, alternatives):
                swaps.append(code[:, a] - code[:, 0])
                costs.append((np.abs(value[:, 0]) - np.abs(value[:, a])) ** 2)
        # besides single swaps, the two cheapest ones of different hashes together
        cost, swap = np.stack(costs, 1), np.stack(swaps, 1)
        if k > 1:
            first = cost.reshape(n, k, -1)[:, :, 0]
            two = np.argsort(first, axis=1, kind="stable")[:, :2]
            both = np.take_along_axis(first, two, 1).sum(1)
            moved = np.take_along_axis(swap.reshape(n, k, -1)[:, :, 0], two, 1).sum(1)
            cost, swap = np.column_stack([cost, both]), np.column_stack([swap, moved])
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = base
        out[:, t, 1 : 1 + order.shape[1]] = base[:, None] + np.take_along_axis(swap, order, 1)
    return out


def _meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per pair and table, the least bucket where one lives and the other is, else the largest int. x, y: pairs x tables x buckets."""
    none = np.iinfo(np.int64).max
    home = np.where((x[:, :, :1] == y).any(2), x[:, :, 0], none)
    return np.minimum(home, np.where((y[:, :, :1] == x).any(2), y[:, :, 0], none))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _room(t: int, bucket: int, ids: np.ndarray, many: np.ndarray, side: np.ndarray, unit: np.ndarray, codes: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Rows (id, links, leader) of one room. side: 0 or 1 if pairs must be across, 2 if any pair counts."""
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if (side < 2).all():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near))
    if not len(i):
        return []
    meets = _meets(codes[i], codes[j])
    here = (meets[:, t] == bucket) & (meets[:, :t] == np.iinfo(np.int64).max).all(1)
    real = meets[:, t] != np.iinfo(np.int64).max
    i, j, here = i[real], j[real], here[real]
    links = np.bincount(i[here], many[j[here]], len(ids)) + np.bincount(j[here], many[i[here]], len(ids))
    label = np.arange(len(ids))
    while len(i):
        least = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (old == label).all():
            break
    touched = np.unique(np.concatenate([i, j]))
    return [(int(ids[x]), int(links[x]), int(ids[label[x]])) for x in touched]


def tables_for(k: int) -> int:
    """Tables for k rotations a bucket: the chance to meet in one falls with k."""
    return math.ceil(TABLES * 1.5 ** max(0, k - 2))


_FOUND = "vec_id bigint, links bigint, leader bigint"


def _rooms(batches: Iterator[pa.RecordBatch], tables: int, threshold: float, vector_type: str, code_type: str) -> Iterator[pa.RecordBatch]:
    """Rooms of a partition sorted by (t, bucket, a, b)."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        key = np.stack([rows.column(c).to_numpy() for c in ("t", "bucket", "a", "b")])
        cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        ends = np.append(cut[1:], rows.num_rows)
        ids, many, side = (rows.column(c).to_numpy() for c in ("vec_id", "many", "side"))
        vectors, codes = rows.column("vector"), rows.column("codes")
        out: list[tuple] = []
        for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
            if e - s > 1:
                unit = _unit(np.frombuffer(b"".join(vectors.slice(s, e - s).to_pylist()), vector_type).reshape(e - s, -1))
                code = np.frombuffer(b"".join(codes.slice(s, e - s).to_pylist()), code_type).astype(np.int64).reshape(e - s, tables, -1)
                out += _room(int(key[0, s]), int(key[1, s]), ids[s:e], many[s:e], side[s:e], unit, code, threshold)
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 50_000], strict=True)], names=["vec_id", "links", "leader"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("t", "bucket", "a", "b"))
        keys = np.stack([batch.column(c).to_numpy() for c in ("t", "bucket", "a", "b")])
        other = np.flatnonzero((keys != np.array(key)[:, None]).any(0))
        if last is not None and tuple(keys[:, 0]) != last:
            yield from flush(pa.Table.from_batches(held))
            held = []
        if len(other):  # all but the last room of the batch are whole
            whole = int(other[-1]) + 1
            yield from flush(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = [batch.slice(whole)]
        else:
            held.append(batch)
        last = key
    if held:
        yield from flush(pa.Table.from_batches(held))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", tables: int | None = None, k: int | None = None) -> DataFrame:
    """Links by cosine >= threshold: vec_id, n_links, component_id, kept, one row per input row.

    n_links is the number of other vectors linked directly, component_id the least vec_id
    reachable, kept whether that is the vector itself. Vectors that are null or zero or hold a
    null or a component that isn't finite link with nothing, nor do vectors of different
    lengths or with a null id. Rows that repeat an id and its vector are vectors of their own, which
    link with each other; of several vectors of one id the one with the least digest links, the
    others with nothing. Vectors exactly at the threshold link. Links are never wrong; one may be
    missed with a small probability, which the tests measure. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = rows.where(good).select("vec_id", "v", F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256).alias("print"))
    members = marked.select("vec_id", "print")
    firsts = members.groupBy("vec_id").agg(F.min("print").alias("first"))
    members = materialize(members.join(firsts, "vec_id").select("vec_id", "print", (F.col("print") == F.col("first")).alias("counts")))
    if not members.where("not counts").isEmpty():  # an id with several vectors
        marked = marked.join(members.where("counts").select("vec_id", "print").distinct(), ["vec_id", "print"], "left_semi")
    sets = materialize(marked.groupBy("print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many"), F.first("v").alias("v")))
    n, dim = sets.agg(F.count("*"), F.max(F.size("v"))).first()
    sides = 2 << max(1, ((dim or 1) - 1).bit_length())
    k = k or max(1, min(round(math.log(max(n, 2)) / math.log(sides)), int(55 // math.log2(sides))))
    tables = tables or tables_for(k)

    narrow = isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    vector_type = "<f4" if narrow else "<f8"
    code_type = "<i4" if (dim or 1) * sides**k < 1 << 31 else "<i8"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            lengths = np.array([len(x) for x in lists])
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                given = np.array([lists[x] for x in own], np.float64)
                unit = _unit(given)
                for at in range(0, len(own), 4096):
                    some = buckets(unit[at : at + 4096], tables, k, PROBES)
                    take = pa.array(own[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("many").take(take), pa.array([x.tobytes() for x in given[at : at + 4096].astype(vector_type)], pa.binary()), pa.array([x.tobytes() for x in some.astype(code_type)], pa.binary()), pa.array(some.reshape(len(some), -1).tolist(), pa.list_(pa.int64()))], names=["vec_id", "many", "vector", "codes", "places"])

    coded = materialize(map_arrow(sets.select("vec_id", "many", "v"), code, "vec_id bigint, many bigint, vector binary, codes binary, places array<bigint>"))
    postings = coded.select("vec_id", F.posexplode("places").alias("p", "bucket")).where("bucket >= 0")
    postings = postings.select(F.floor(F.col("p") / (1 + PROBES)).cast("int").alias("t"), "bucket", "vec_id", (F.col("p") % (1 + PROBES) == 0).alias("home"))
    used = postings.groupBy("t", "bucket").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("size > 1 and homes > 0")
    used = materialize(used.select("t", "bucket", "size", F.ceil(F.col("size") / ROOM).cast("int").alias("chunks")))
    each = join_figures(postings.drop("home"), used, ["t", "bucket"], "size").where("chunks is not null").join(coded.select("vec_id", "many", "vector", "codes"), "vec_id")
    each = each.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    each = each.select("t", "bucket", "vec_id", "many", "vector", "codes", "c", other).select("t", "bucket", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).alias("side"), "vec_id", "many", "vector", "codes")
    found = map_arrow(each.repartition("t", "bucket", "a", "b").sortWithinPartitions("t", "bucket", "a", "b"), lambda b: _rooms(b, tables, threshold, vector_type, code_type), _FOUND)
    found = materialize(found.groupBy("vec_id", "leader").agg(F.sum("links").alias("links")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec_id").alias("u"), F.col("leader").alias("v")))
    known = sets.select("print", F.col("vec_id").alias("first_id"), "many")
    known = known.join(links.withColumnRenamed("vec_id", "first_id"), "first_id", "left").join(parts.withColumnRenamed("node", "first_id"), "first_id", "left")
    known = materialize(known.select("print", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id"), "many"))
    linked = join_figures(members.where("counts"), known, "print", "many").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~good).select("vec_id").unionByName(members.where("not counts").select("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
