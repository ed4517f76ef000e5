"""Near hashes by permuted blocks of bits: of parts + distance blocks, `parts` are equal in any two that are near.

Each distinct hash is keyed once for every choice of `parts` blocks; hashes that share a key meet, and are kept where
the bits that differ are few enough. A pair counts at its first common key alone, so none has to be removed afterwards.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Hashes of one key that meet in one task; a key with more of them is split.
MEET = 2048


def from_hex(hash_: Column) -> Column:
    """The bits of 16 hex digits as a bigint."""
    half = lambda at: F.conv(F.substring(hash_, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks(most: int, parts: int, bits: int = 64) -> list[int]:
    """For each choice of `parts` of the blocks a mask of their bits, as signed numbers."""
    blocks = parts + most
    ends = [i * bits // blocks for i in range(blocks + 1)]
    one = [sum(1 << b for b in range(ends[i], ends[i + 1])) for i in range(blocks)]
    every = [sum(one[i] for i in choice) for choice in itertools.combinations(range(blocks), parts)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def near_pairs(hashes: DataFrame, most: int = 3, parts: int | None = None, value: str = "value") -> DataFrame:
    """(a, b, distance): all pairs a < b of different values (bigint, 64 bits) that differ in at most `most` bits.

    parts: equal blocks that make a key, none for a number that follows the rows: more of them are longer keys and more
    rows, as the number of keys a value has grows. Null values are near none; equal values count once.
    """
    own = hashes.select(F.col(value).alias("v")).where("v IS NOT NULL").distinct()
    if parts is None:
        n = own.count()
        parts = 1 + (n > 2000) + (n > 50_000) + (n > 500_000_000)
    every = F.array(*[F.lit(m).cast("bigint") for m in masks(most, parts)])
    keyed = own.select("v", F.posexplode(every).alias("t", "m")).select("v", "t", F.col("v").bitwiseAND(F.col("m")).alias("k"))
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", F.ceil(F.col("n") / MEET).cast("int").alias("of"))
    rows = keyed.join(shared, ["t", "k"])
    left = rows.select("t", "k", F.pmod(F.xxhash64("v"), F.col("of")).cast("int").alias("s"), F.col("v").alias("a"))
    right = rows.select("t", "k", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("s"), F.col("v").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(every, lambda m: x.bitwiseAND(m) == 0), True) - 1
    met = left.join(right, ["t", "k", "s"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= most)).where(first == F.col("t"))
    return met.select("a", "b", F.bit_count(x).alias("distance"))


def near_counts(rows: DataFrame, key: str = "id", hash_: str = "simhash", most: int = 3, parts: int | None = None) -> DataFrame:
    """(key, hash, same, near, first): other rows of the same hash, rows of other hashes within the distance, and the
    smallest key of all these and the row itself. Rows without a hash are left out."""
    own = rows.where(F.col(hash_).isNotNull()).select(key, hash_, from_hex(F.col(hash_)).alias("v"))
    shared_dir(rows.sparkSession)
    own = own.checkpoint()  # hashes are not made again
    groups = own.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    pairs = near_pairs(own, most, parts, "v")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(groups, both["b"] == groups["v"]).groupBy("a").agg(F.sum("n").alias("near"), F.min("least").alias("nearest"))
    found = groups.join(beside, groups["v"] == beside["a"], "left").select("v", (F.col("n") - 1).alias("same"), F.coalesce("near", F.lit(0)).alias("near"), F.least("least", F.coalesce("nearest", "least")).alias("first"))
    return own.join(found, "v").select(key, hash_, "same", "near", "first")
