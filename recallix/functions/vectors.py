"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RESONANCE, SECTORS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the dimensions differ or a norm is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalized(a: Column, epsilon: float = 0.0) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / (n + epsilon))).otherwise(a)


def resized(a: Column, n: int) -> Column:
    """The first n components, with zeros where there are fewer."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), 1, n)


def bucket_means(a: Column, n: int) -> Column:
    """n means over buckets with floor bounds, of length one; a vector of at most n components stays."""
    size = F.size(a)

    def mean(i: Column) -> Column:
        low, high = F.floor(i * size / n).cast("int"), F.floor((i + 1) * size / n).cast("int")
        part = F.slice(a, low + 1, high - low)
        return F.when(high > low, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (high - low)).otherwise(0.0)

    return F.when(size <= n, a).otherwise(normalized(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), mean)))


def pooled(a: Column, share: float | Column, least: int = 64) -> Column:
    """Means over buckets of equal size (the last may be shorter) for floor(size * share) components, least at least."""
    size = F.size(a)
    width = F.ceil(size / F.least(size, F.greatest(F.lit(least), F.floor(size * share)))).cast("int")

    def mean(i: Column) -> Column:
        part = F.slice(a, i * width + 1, width)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)

    return normalized(F.transform(F.sequence(F.lit(0), F.ceil(size / width).cast("int") - 1), mean))


def fused(syntactic: Column, semantic: Column) -> Column:
    """0.6 of one and 0.4 of the other, side by side, of length one."""
    return normalized(F.concat(F.transform(syntactic, lambda x: x * 0.6), F.transform(semantic, lambda x: x * 0.4)))


def resonance(a: Column, b: Column) -> Column:
    """Resonance of two sectors; an unknown one counts as semantic."""
    table = F.array(*[F.array(*map(F.lit, row)) for row in RESONANCE])

    def number(s: Column) -> Column:
        return reduce(lambda c, i: c.when(s == SECTORS[i], i), range(1, 5), F.when(s == SECTORS[0], 0)).otherwise(1)

    return F.get(F.get(table, number(a)), number(b))


def to_bytes(a: Column) -> Column:
    """Components as little-endian 32-bit floats."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, "<f4").tobytes() for v in lists.to_pylist()], pa.binary())

    return run(a)


def from_bytes(b: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.frombuffer(v, "<f4").astype(float) for v in blobs.to_pylist()], pa.list_(pa.float64()))

    return run(b)
