"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import BATCH_BYTES, BATCH_ROWS, short_batches
from ..storage import fresh_dir, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "fresh_dir", "shared_dir", "short_batches"]


#: Rows and bytes of one file of an intermediate table, at least.
FILE_ROWS, FILE_BYTES = 100_000, 16 << 20


def file_count(spark: SparkSession, rows: int | None = None, size: int | None = None) -> int:
    """Files for an intermediate table of about so many rows or bytes: in proportion, and a few for each core."""
    cores = spark.sparkContext.defaultParallelism
    want = max(cores, -(-rows // FILE_ROWS)) if rows is not None else max(4 * cores, -(-(size or 0) // FILE_BYTES))
    return min(1_000_000, want)


def plan_size(df: DataFrame) -> int:
    """Spark's own estimate of a plan's bytes; over joins it may be far too high."""
    said = df._jdf.queryExecution().optimizedPlan().stats().simpleString()  # as a number it may have any length
    number, unit = re.search(r"sizeInBytes=([0-9.E+]+) ([KMGTPE]i)?B", said).groups()
    return int(min(2.0**60, float(number) * 1024.0 ** ("KMGTPE".index(unit[0]) + 1 if unit else 0)))


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and go on from there; it survives lost executors.

    rows: about how many there are at most, if known; else the plan's estimate in bytes counts. Either keeps small
    tables from being written as one file per shuffle partition; large ones keep their partitions.
    """
    spark = df.sparkSession
    shared_dir(spark)
    return df.coalesce(file_count(spark, rows, None if rows is not None else plan_size(df))).checkpoint(eager=True)


def with_struct(df: DataFrame, call, names: list[str]) -> DataFrame:
    """Add the fields of the struct column `call`; they replace columns of the same name."""
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    holder = free_name(df, "r")
    out = df.withColumn(holder, call)
    return out.select(*[F.col(quoted(c)) for c in keep], *[F.col(f"{holder}.{n}").alias(n) for n in names])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *bases: str) -> list[str]:
    return [free_name(df, b) for b in bases]


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def single_thread() -> None:
    """A task owns one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most about `bound` rows (1.2 times), chosen by the hash of the key; the same rows on each run."""
    n = df.count()
    if n <= bound:
        return df
    share = int(1_000_000 * bound / n)
    return df.where(F.pmod(F.xxhash64(F.col(quoted(key))), F.lit(1_000_000)) < share)


def logistic(x, y, weight, ridge: float = 1.0):
    """Weights of a logistic regression over standardized columns, the last for the constant (which the ridge leaves
    alone); by short Newton steps."""
    import numpy as np

    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / dev, np.ones(len(x))]
    w, held = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ a + held
        w = w + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - held @ w), -1, 1)
    return mean, dev, w


def predict(model, x):
    """Probabilities of logistic()'s model."""
    import numpy as np

    mean, dev, w = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / dev, np.ones(len(x))] @ w, -30, 30)))
