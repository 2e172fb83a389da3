"""Exact top-k by inner product: aggregation of sorted lists without random access.

Vectors are dealt into blocks by their nearest signed axis (a crowded axis fills several blocks,
rare ones share one). A block holds, per component, a list of its vectors sorted by it. A query
reads all lists from its good ends down to some depth. What a vector has shown so far, plus the
last value read in the lists where it hasn't come up, bounds its score above; plus the far end of
those lists, below. Reading stops at the first depth where a vector that came up nowhere can't
qualify; those whose upper bound still reaches the k-th best score known are then scored in full.

A query first visits the block that it would live in itself. The k-th score found there goes
with it to the other blocks, of which most end at depth 0 or soon after. Queries visit
blocks in batches, so a task holds a block and a batch, both of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, ship, trimmed

#: Integers in a block (vectors times components), queries of a batch.
BLOCK_NUMBERS, BATCH = 1 << 19, 1024
#: Depths at which reading may stop, in parts of a list.
PARTS = (0, 1 / 64, 1 / 32, 3 / 64, 1 / 16, 3 / 32, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
HITS = "dim int, home bigint, query_id bigint, mark bigint, x array<bigint>, bound bigint, vec_ids array<bigint>, scores array<bigint>"


class Lists:
    """The sorted lists of a block. ids: n; x: n x d integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.value = np.ascontiguousarray(np.take_along_axis(x.T, self.order, 1).astype(np.float64))
        self.depths = np.unique([int(np.ceil(p * self.n)) for p in PARTS])
        at = np.minimum(self.depths, self.n - 1)
        self.top, self.bottom = self.value[:, self.n - 1 - at], self.value[:, at]
        self.largest = int(np.abs(x).max(initial=0)) if len(x) else 0

    def exact(self, q: np.ndarray) -> bool:
        """Whether sums of products are whole numbers that doubles hold."""
        return self.largest * int(np.abs(q).max(initial=0)) * len(q) < 1 << 51

    def frontiers(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of what hasn't come up, queries x depths; the last depth is the whole list."""
        out = np.maximum(queries, 0) @ self.top + np.minimum(queries, 0) @ self.bottom
        out[:, -1] = -np.inf
        return out

    def read(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all vectors after ``depth`` entries of each list."""
        up, down = np.nonzero(q > 0)[0], np.nonzero(q < 0)[0]
        rows = np.concatenate([self.order[up, self.n - depth :], self.order[down, :depth]])
        seen = np.concatenate([self.value[up, self.n - depth :] * q[up, None], self.value[down, :depth] * q[down, None]])
        at = min(depth, self.n - 1)
        last = np.concatenate([q[up] * self.value[up, self.n - 1 - at], q[down] * self.value[down, at]])
        worst = np.concatenate([q[up] * self.value[up, 0], q[down] * self.value[down, -1]])
        rows = rows.ravel()
        upper = last.sum() + np.bincount(rows, (seen - last[:, None]).ravel(), self.n)
        lower = worst.sum() + np.bincount(rows, (seen - worst[:, None]).ravel(), self.n)
        return lower, upper

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors; one beyond 64 bits is an error."""
        if self.exact(q):
            return self.x[rows] @ q
        out = self.x[rows].astype(object) @ q.astype(object)
        if any(not -(1 << 63) <= s < 1 << 63 for s in out):
            raise OverflowError("an inner product doesn't fit in 64 bits")
        return out.astype(np.int64)

    def search(self, q: np.ndarray, own: int, k: int, bound: float, frontier: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best whose score is at least ``bound``, vectors with id ``own`` aside; ties to the smaller id."""
        others = self.ids != own
        if not self.exact(q):  # too large for doubles: nothing to bound them by
            return self.best(q, np.nonzero(others)[0], k)
        at = int(np.argmax(frontier < bound))
        if frontier[at] < bound and at == 0:
            return []
        for at in range(max(at, 1) if frontier[at] < bound else 1, len(self.depths)):
            lower, upper = self.read(q.astype(np.float64), int(self.depths[at]))
            if not frontier[at] < bound:  # the leaders' scores are lower bounds of the k-th
                lower[~others] = -np.inf
                lead = np.argpartition(lower, max(0, self.n - 4 * k))[-4 * k :]
                found = np.sort(self.scores(q, lead[others[lead]]))
                if len(found) >= k:
                    bound = max(bound, float(found[-k]))
            if frontier[at] < bound or at == len(self.depths) - 1:
                return self.best(q, np.nonzero(others & (upper >= bound))[0], k)
        return self.best(q, np.nonzero(others)[0], k)

    def best(self, q: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        scores = self.scores(q, rows)
        first = np.lexsort((self.ids[rows], -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[:k]
        return [(int(scores[i]), int(self.ids[rows[i]])) for i in first]


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _visit(k: int):
    """A function of a block's vectors and the queries that visit it; gives the queries with their k best there."""

    def run(key, block: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["dim", "home", "query_id", "mark", "x", "bound", "vec_ids", "scores"]
        dim = key[0].as_py()
        schema = pa.schema([("dim", pa.int32()), ("home", pa.int64()), ("query_id", pa.int64()), ("mark", pa.int64()), ("x", pa.list_(pa.int64())), ("bound", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        ids, x = block.column("vec_id").to_numpy(), _matrix(block, "x", dim)
        once = np.unique(np.column_stack([ids, x]), axis=0, return_index=True)[1]  # a row that repeats counts once
        lists, q = Lists(ids[once], x[once]), _matrix(queries, "x", dim)
        frontiers = lists.frontiers(q.astype(np.float64))
        bounds, own = queries.column("bound").to_pylist(), queries.column("query_id").to_pylist()
        hits = [lists.search(q[i], own[i], k, -np.inf if bounds[i] is None else bounds[i], frontiers[i]) for i in range(len(q))]
        keep = [i for i, h in enumerate(hits) if h or bounds[i] is None]
        out = queries.select(["dim", "home", "query_id", "mark", "x"]).take(pa.array(keep, pa.int64()))
        if bounds and all(b is not None for b in bounds):  # the second visit: the vectors aren't wanted any more
            out = out.set_column(4, "x", pa.nulls(len(keep), pa.list_(pa.int64())))
        last = [hits[i][-1][0] if len(hits[i]) == k else None for i in keep]
        columns = [*out.columns, pa.array(last, pa.int64()), pa.array([[v for _, v in hits[i]] for i in keep], pa.list_(pa.int64())), pa.array([[s for s, _ in hits[i]] for i in keep], pa.list_(pa.int64()))]
        return trimmed(pa.table(columns, names).cast(schema))

    return run


def _axis(x: Column) -> Column:
    """Number of the signed axis nearest to a vector; the first of equal ones."""
    size = F.transform(x, lambda v: F.abs(v.cast("double")))
    place = F.array_position(size, F.array_max(size))
    return place * 2 + (F.element_at(x, place.cast("int")) < 0).cast("bigint")


def _meet(vectors: DataFrame, queries: DataFrame, keys: list[str], cells: int, k: int) -> DataFrame:
    parts = max(1, min(cells, 100_000))
    left, right = (t.repartition(parts, *keys).groupBy(*keys) for t in (vectors, queries))
    return left.cogroup(right).applyInArrow(_visit(k), HITS)


def top_matches(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the highest integer inner product.

    Components become floor(scale * component), the component as a double. Queries are the rows whose
    id is divisible by ``every``, candidates all rows of other ids; of k or fewer candidates all are given.
    Vectors that are null or empty or hold null or non-finite components, and rows without an id, take
    no part; vectors of another length than the query's are no candidates. Rows that repeat id and vector count once; an id
    with several vectors has each of them as candidate and as query. Ties go to the smaller id. Zero
    vectors score 0. A score beyond 64 bits is an error. An empty table gives no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    e = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.size(e) > 0), F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.when(sound, F.transform(e, lambda v: F.floor(v * scale))).alias("x"))
    rows = rows.where("vec_id is not null and x is not null").select("vec_id", "x", F.size("x").alias("dim"), _axis(F.col("x")).alias("axis"))

    # axes in a row, cut into blocks of equal size; a vector's place on its axis comes from its id
    axes = rows.groupBy("dim", "axis").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("dim").orderBy("axis")) - F.col("rows")
    total = F.sum("rows").over(Window.partitionBy("dim"))
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))
    axes = materialize(axes.select("dim", "axis", "rows", before.alias("before"), F.ceil(total / size).alias("blocks"), size.alias("size")))
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("rows"))) / F.col("size"))
    placed = materialize(rows.join(axes, ["dim", "axis"]).select("dim", place.alias("block"), "vec_id", "x", "blocks"))
    count = axes.groupBy("dim").agg(F.max("blocks").alias("blocks"), F.sum("rows").alias("rows")).agg(F.sum("blocks"), F.sum(F.col("blocks") * F.ceil(F.col("rows") / (every * BATCH)))).first()
    blocks, cells = int(count[0] or 0), int(count[1] or 0)

    asked = placed.where(F.col("vec_id") % every == 0).select("dim", F.col("block").alias("home"), F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("mark"), "x", "blocks").dropDuplicates(["dim", "query_id", "mark"])
    at_home = asked.select("dim", F.col("home").alias("block"), F.lit(None).cast("bigint").alias("bound"), "home", "query_id", "mark", "x")
    first = materialize(_meet(placed.select("dim", "block", "vec_id", "x"), at_home, ["dim", "block"], blocks, k))

    # batches of queries meet all other blocks
    sizes = axes.groupBy("dim").agg(F.max("blocks").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum("rows") / (every * BATCH))).alias("batches"))
    away = first.join(sizes, "dim").select("dim", "home", "query_id", "mark", "x", F.coalesce("bound", F.lit(-(1 << 63))).alias("bound"), F.pmod(F.xxhash64("query_id"), F.col("batches")).alias("batch"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    copies = placed.join(sizes.select("dim", "batches"), "dim").select("dim", "block", "vec_id", "x", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))
    second = _meet(copies, away.where("block <> home"), ["dim", "block", "batch"], cells, k)

    found = first.select("query_id", "mark", "vec_ids", "scores").unionByName(second.select("query_id", "mark", "vec_ids", "scores"))
    pairs = found.select("query_id", "mark", F.explode(F.arrays_zip("vec_ids", "scores")).alias("p")).select("query_id", "mark", F.col("p.vec_ids").alias("vec_id"), F.col("p.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
