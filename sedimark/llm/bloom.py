"""Blocked Bloom filters as tables, with DataFrame functions only.

A key sets bits in one 256-bit block (four longs a block, two bits in each). A key whose bits aren't
all set is not in; of the others a few are not either, which an exact join must settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_A_BLOCK = 10
#: Filters of at most so many blocks (40 bytes each) are broadcast.
BROADCAST_BLOCKS = 1 << 18


def masks(key: Column) -> list[Column]:
    """The bits of a key in the four longs of its block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows: block, w0 to w3. Blocks without a key have no row."""
    rows = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def flagged(rows: DataFrame, key: str, listed: DataFrame, flag: str) -> DataFrame:
    """rows with ``flag``: whether ``key`` may be in ``listed`` (a table with a column of the same name).

    The filter is broadcast; with more keys than it holds at KEYS_A_BLOCK it lets more pass, never fewer.
    """
    blocks = min(BROADCAST_BLOCKS, max(1, -(-listed.count() // KEYS_A_BLOCK)))
    table = F.broadcast(bloom_blocks(listed, key, blocks))
    out = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).join(table, "block", "left")
    hit = F.col(key).isNotNull()
    for i, m in enumerate(masks(F.col(key))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    return out.withColumn(flag, hit).drop("block", "w0", "w1", "w2", "w3")


def anti_join(rows: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """rows whose ``key`` is not in ``listed`` (one column, distinct); rows with a null key stay.

    Only rows that the filter can't clear cross the network, whatever columns they have.
    """
    names = rows.columns
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], key.alias("key"))
    listed = listed.toDF("key")
    asked = flagged(keyed, "key", listed, "maybe")
    stay = asked.where("not maybe").drop("maybe")
    rest = asked.where("maybe").drop("maybe").join(listed, "key", "left_anti").select(*stay.columns)
    return stay.unionByName(rest).drop("key").toDF(*names)
