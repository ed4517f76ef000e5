"""Exact vector search in blocks: queries and rows meet block by block, and only the best of a block leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..batches import short_batches

#: Vectors of one block, and most of one where the pairs of two blocks are fused.
BLOCK, WIDE = 1024, 8192


def blocks(rows: DataFrame, key: str, vector: str, by: str, size: int | None = None, floor: str | None = None) -> DataFrame:
    """(by, block, of, rows): rows packed into blocks, by a salt that follows each group's own number of them."""
    number = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / (size or BLOCK)).cast("int").alias("of"))
    dealt = rows.join(number, by).withColumn("block", F.pmod(F.xxhash64(key), F.col("of")).cast("int"))
    return dealt.groupBy(by, "block", "of").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *([F.col(floor).alias("f")] if floor else []))).alias("rows"))


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v", by: str = "sector", query_key: str = "query_id", include_self: bool = True, least: float | None = None, floor: str | None = None) -> DataFrame:
    """(query, by, key, similarity, rank): the k rows of the query's group with the greatest cosine, ties by key.

    Both sides are cut into blocks of bounded size; a pair of blocks is one matrix product, after which at most k rows
    of a query go on. Vectors of other dimensions or without length have similarity 0. With least, only rows of that
    similarity or more count; with floor, a column of the queries, only those of their query's (null: all).
    """
    met = similarities(rows, queries, key, vector, by, query_key, k, include_self, least, floor)
    rank = F.row_number().over(Window.partitionBy(query_key, by).orderBy(F.desc("similarity"), key))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def similarities(rows: DataFrame, queries: DataFrame, key: str = "id", vector: str = "v", by: str = "sector", query_key: str = "query_id", k: int = 2**31 - 1, include_self: bool = True, least: float | None = None, floor: str | None = None) -> DataFrame:
    """(query, by, key, similarity): cosines of the queries with the rows of their group, at most k for a query from each
    block of rows. Blocks of queries go to every block of rows of their group, and meet there: a group of any size is
    spread over as many tasks as it has blocks of rows."""
    kind = "array<struct<q:bigint,k:bigint,s:double>>"

    @F.arrow_udf(kind)
    def meet(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            for qs, rs in zip(left, right, strict=True):  # a pair of blocks at a time leaves the task
                found = _best(_matrix(qs), _matrix(rs), k, include_self, least, _floors(qs) if floor else None)
                yield pa.ListArray.from_arrays(pa.array([0, len(found[0])], pa.int32()), pa.StructArray.from_arrays(list(map(pa.array, found)), ["q", "k", "s"]))

    short_batches(rows.sparkSession)
    r = blocks(rows, key, vector, by).select(by, "block", "of", F.col("rows").alias("rs"))
    parts = r.groupBy(by).agg(F.max("of").alias("parts"))
    q = blocks(queries, query_key, vector, by, floor=floor).select(by, F.col("rows").alias("qs")).join(parts, by)
    q = q.select(by, "qs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    met = q.join(r.drop("of"), [by, "block"]).select(by, F.explode(meet(F.col("qs"), F.col("rs"))).alias("m"))
    return met.select(F.col("m.q").alias(query_key), by, F.col("m.k").alias(key), F.col("m.s").alias("similarity"))


def _matrix(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, unit vectors (shorter ones padded) and dimensions of a block's rows."""
    rows = block.values
    keys, lists = rows.field("k").to_numpy(zero_copy_only=False), rows.field("v")
    size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    wide = int(size.max(initial=0))
    if len(size) and (size == wide).all():
        m = flat.reshape(len(size), wide)
    else:
        m = np.zeros((len(size), wide))
        m[np.arange(wide)[None, :] < size[:, None]] = flat
    n = np.linalg.norm(m, axis=1)
    return keys, m / np.where(n > 0, n, 1)[:, None], size


def _floors(block: pa.ListScalar) -> np.ndarray:
    return block.values.field("f").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _cosines(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Products of unit vectors of dimensions na and nb, 0 where these differ."""
    wide = min(a.shape[1], b.shape[1])
    s = np.where(na[:, None] == nb[None, :], a[:, :wide] @ b[:, :wide].T, 0.0)
    s[np.isnan(s)] = 0.0
    return s


def _best(queries: tuple, rows: tuple, k: int, include_self: bool, least: float | None, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (qk, a, na), (rk, b, nb) = queries, rows
    s = _cosines(a, na, b, nb)
    use = np.full(s.shape, True) if include_self else qk[:, None] != rk[None, :]
    if least is not None:
        use &= s >= least
    if floors is not None:
        use &= s >= floors[:, None]
    if k < s.shape[1]:  # what may be among the k best: all from the k-th value on
        masked = np.where(use, s, -np.inf)
        use &= s >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(use)
    order = np.lexsort((rk[j], -s[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i, "left")
    keep = np.arange(len(i)) - first < k
    i, j = i[keep], j[keep]
    return qk[i].astype(np.int64), rk[j].astype(np.int64), s[i, j]


def fused(similarities: DataFrame, weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Weighted mean of a memory's similarities over the sectors that it has; a sector without a weight counts 0.5."""
    w = F.coalesce("weight", F.lit(0.5))
    joined = similarities.join(F.broadcast(weights), "sector", "left")
    return joined.groupBy(*keys).agg((F.sum(F.col("similarity") * w) / F.sum(w)).alias("fusion"))


def fusions(rows: DataFrame, queries: DataFrame, weights: dict[str, float], key: str = "id", query_key: str = "query_id") -> DataFrame:
    """(query, key, fusion): what fused() makes of all similarities, which are not listed: a memory's vectors of all
    sectors lie in one block, so that two blocks give the fusions of their queries and memories at once."""
    spark = rows.sparkSession
    short_batches(spark)
    rows, queries = rows.where("sector IS NOT NULL"), queries.where("sector IS NOT NULL")
    n = rows.count()
    of = max(1, -(-n // WIDE), min(-(-n // BLOCK), 4 * spark.sparkContext.defaultParallelism))

    def packed(df: DataFrame, k: str, parts: int, name: str) -> DataFrame:
        one = F.struct(F.col(k).alias("k"), F.col("sector").alias("g"), F.transform("v", lambda x: x.cast("double")).alias("v"))
        return df.select(F.pmod(F.xxhash64(k), F.lit(parts)).cast("int").alias("block"), one.alias("x")).groupBy("block").agg(F.collect_list("x").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, rs in zip(batch.column("qs"), batch.column("rs"), strict=True):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _fusions(qs, rs, weights))), ["q", "k", "f"])

    q = packed(queries, query_key, max(1, -(-queries.count() // BLOCK)), "qs").select("qs", F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias("block"))
    met = q.join(packed(rows, key, of, "rs"), "block").select("qs", "rs").mapInArrow(run, "q bigint, k bigint, f double")
    return met.select(F.col("q").alias(query_key), F.col("k").alias(key), F.col("f").alias("fusion"))


def _fusions(qs: pa.ListScalar, rs: pa.ListScalar, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (qk, a, na), (rk, b, nb) = _matrix(qs), _matrix(rs)
    (qk, qi), (rk, ri) = np.unique(qk, return_inverse=True), np.unique(rk, return_inverse=True)
    gq, gr = (x.values.field("g").to_numpy(zero_copy_only=False) for x in (qs, rs))
    total, weight = np.zeros((len(qk), len(rk))), np.zeros((len(qk), len(rk)))
    for g in np.unique(gq):
        i, j, w = np.flatnonzero(gq == g), np.flatnonzero(gr == g), weights.get(g, 0.5)
        at = np.ix_(qi[i], ri[j])
        np.add.at(total, at, w * _cosines(a[i], na[i], b[j], nb[j]))  # a memory may have several vectors of a sector
        np.add.at(weight, at, w)
    i, j = np.nonzero(weight)
    return qk[i].astype(np.int64), rk[j].astype(np.int64), total[i, j] / weight[i, j]


def mean_vectors(vectors: DataFrame, key: str = "id", beta: float = 2.0) -> DataFrame:
    """One vector per memory: its sectors' vectors under a softmax of their weights, of length one."""
    from ..config import SECTOR_WEIGHT
    from ..functions.text import let
    from ..functions.vectors import norm

    table = F.create_map(*[F.lit(x) for pair in SECTOR_WEIGHT.items() for x in pair])
    e = vectors.withColumn("_e", F.exp(beta * F.coalesce(F.try_element_at(table, F.col("sector")), F.lit(1.0))))
    parts = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sector", "_e", "v"))).alias("p"))  # five sectors at most
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["_e"])
    first = F.transform(F.get(F.col("p"), F.lit(0))["v"], lambda x: F.lit(0.0))
    summed = F.aggregate("p", first, lambda a, x: F.zip_with(a, x["v"], lambda s, y: s + y * x["_e"] / total))
    out = parts.select(key, summed.alias("mean"))
    return out.select(key, let(F.struct(F.col("mean").alias("v"), (norm(F.col("mean")) + 1e-8).alias("n")), lambda m: F.transform(m["v"], lambda x: x / m["n"])).alias("mean"))


def pooled(vectors: DataFrame, key: str = "id") -> DataFrame:
    """The plain mean of each key's vectors, not brought to length one; components meet by their place."""
    x = vectors.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
