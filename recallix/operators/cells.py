"""Vector search over inverted lists: rows lie in the cell of their nearest centre, and a query reads the cells near it.

Centres are trained on a bounded sample; every row is then dealt to its cell and written to a table partitioned by cell,
so that a search reads the files of the probed cells alone. Found rows are compared exactly. `probed` takes as many
cells as a recall asks for; `widened` goes on, doubling, until each query has its k rows under a filter and no unread
cell can hold a nearer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_dir, shared_dir
from .search import top_k

#: Rows for each centre that it is trained on, most bytes of all those, most cells, and most queries that recall is
#: measured by.
PER_CELL, SAMPLE_BYTES, MOST_CELLS, MEASURED = 64, 128 << 20, 4096, 256


@dataclass(frozen=True)
class Cells:
    """Where the rows lie, and of each cell its centre (of length one), the greatest angle of a row to it, and how many
    rows it holds. probes: cells that a search reads."""

    folder: str
    key: str
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    probes: int = 1


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vector: str, dim: int | None = None) -> Column:
    """Vectors with a direction: not null, of the dimension, finite in all components and not all zero."""
    v = F.col(vector)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return fine if dim is None else fine & (F.size(v) == dim)


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about `most` rows, by the hash of the key; the same ones on each run."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))


def trained(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by spherical k-means; a centre without rows moves to the row worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, -(-len(x) // 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        worst = np.argsort((x * centres[near]).sum(1))
        empty = np.flatnonzero(norm < 1e-12)
        sums[empty], norm[empty] = x[worst[: len(empty)]], 1.0
        centres = sums / norm[:, None]
    return centres


def build(rows: DataFrame, key: str = "id", vector: str = "v", cells: int | None = None) -> Cells:
    """Deal rows to cells (the square root of their number, 4096 at most, unless given) and write them, with all their
    columns, to the shared folder by cell.

    Centres are trained on at most about 64 rows each, and 128 MB, chosen by hash. Rows whose vectors are null, zero, not finite or of
    another dimension than most of the sample's lie in no cell.
    """
    spark = rows.sparkSession
    rows = rows.where(usable(vector))
    wide = rows.select(F.size(vector).alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if wide is None:
        return Cells(fresh_dir(spark, "cells"), key, np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64))
    dim, n = wide["d"], wide["count"]
    rows = rows.where(F.size(vector) == dim)
    cells = cells or min(MOST_CELLS, max(1, round(n**0.5)))
    most = max(1, min(PER_CELL * cells, SAMPLE_BYTES // (8 * dim)))
    told = sampled(rows.select(key, vector), key, most).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).toArrow()["v"].combine_chunks()
    centres = trained(_units(told, dim), cells)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            s = _units(batch, dim) @ centres.T
            near = s.argmax(1)
            angle = np.arccos(np.clip(s[np.arange(len(s)), near], -1, 1))
            yield pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(angle)], ["cell", "angle"])

    folder = fresh_dir(spark, "cells")
    dealt = rows.withColumn("_p", place(F.col(vector))).select(*rows.columns, F.col("_p.cell").alias("cell"), F.col("_p.angle").alias("angle"))
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(folder)
    told = {r["cell"]: r for r in spark.read.parquet(folder).groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    return Cells(folder, key, centres, np.array([told[i]["a"] if i in told else -1.0 for i in range(len(centres))]), np.array([told[i]["n"] if i in told else 0 for i in range(len(centres))]))


def read(spark, index: Cells, cells: list[int] | None = None) -> DataFrame:
    """The rows of the given cells, of all by default; others' files are not opened."""
    rows = spark.read.parquet(index.folder)
    return rows if cells is None else rows.where(F.col("cell").isin(cells))


def _ordered(index: Cells, by_bound: bool, low: int, high: int):
    """Column function: the cells of places low to high in a vector's order, nearest centre first, or greatest similarity
    that a row of the cell can have; with it that similarity of the next cell (below all: there is none)."""
    centres, radius, some = index.centres, index.radius + 1e-7, np.flatnonzero(index.rows > 0)

    @F.arrow_udf("struct<cells:array<int>,rest:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            s = _units(batch, centres.shape[1]) @ centres[some].T
            if by_bound:
                s = np.cos(np.maximum(0, np.arccos(np.clip(s, -1, 1)) - radius[some]))
            order = np.argsort(-s, axis=1, kind="stable")
            rest = np.take_along_axis(s, order[:, high : high + 1], 1)[:, 0] if high < len(some) else np.full(len(s), -2.0)
            yield pa.StructArray.from_arrays([pa.array(list(some[order[:, low:high]]), pa.list_(pa.int32())), pa.array(rest)], ["cells", "rest"])

    return run


def _searched(index: Cells, queries: DataFrame, k: int, vector: str, where: Column | None) -> DataFrame:
    """(query_id, key, similarity): the k best rows of each of the queries' cells (query_id, v, cell), as far as they
    reach the query's last, if it has one."""
    spark = queries.sparkSession
    cells = [r["cell"] for r in queries.select("cell").distinct().collect()]  # MOST_CELLS at most
    rows = read(spark, index, cells)
    rows = rows if where is None else rows.where(where)
    found = top_k(rows.select(index.key, F.transform(vector, lambda x: x.cast("double")).alias("v"), "cell"), queries, k, key=index.key, by="cell", floor="last" if "last" in queries.columns else None)
    return found.select("query_id", index.key, "similarity")


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    """Similarities within 1e-9 of one another count as equal, as rows' products may be summed in another order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def probed(index: Cells, queries: DataFrame, k: int, vector: str = "v", where: Column | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): the k rows of greatest cosine in the cells nearest to each query (query_id, v),
    exactly compared, ties by key. Queries without a direction have none."""
    asked = queries.where(usable("v", index.centres.shape[1])).select("query_id", "v")
    order = _ordered(index, False, 0, probes or index.probes)
    near = asked.withColumn("_o", order(F.col("v"))).select("query_id", "v", F.explode("_o.cells").alias("cell"))
    return _ranked(_searched(index, near, k, vector, where), index.key, k)


def measured(index: Cells, rows: DataFrame, k: int, recall: float = 0.9, vector: str = "v", slack: float = 0.03) -> Cells:
    """The index with as few probes as hold that share of the true k nearest rows (and a little more), by an exact search
    for at most about 256 rows, chosen by hash. That search reads all rows once."""
    spark = rows.sparkSession
    if not len(index.centres):
        return index
    dealt = read(spark, index).select(index.key, F.transform(vector, lambda x: x.cast("double")).alias("v"), "cell")
    asked = sampled(dealt.select(F.col(index.key).alias("query_id"), "v"), "query_id", MEASURED)
    every = lambda df: df.withColumn("one", F.lit("all"))
    true = top_k(every(dealt), every(asked), k, key=index.key, by="one").select("query_id", index.key)
    at = true.join(dealt.select(index.key, "cell"), index.key).join(asked, "query_id")
    order = _ordered(index, False, 0, len(index.centres))
    place = at.withColumn("_o", order(F.col("v"))).select((F.array_position("_o.cells", F.col("cell"))).alias("p"))
    places = np.array([r["p"] for r in place.collect()])  # MEASURED times k at most
    need = min(1.0, recall + slack)
    return replace(index, probes=int(np.quantile(places, need, method="higher")) if len(places) else 1)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(queries, recall): the share of exact rows (query_id, key) that were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def widened(index: Cells, queries: DataFrame, k: int, where: Column, vector: str = "v", exact: bool = True) -> DataFrame:
    """(query_id, key, similarity, rank): the k rows of greatest cosine that pass the filter; never fewer where there are
    k. Ties go by key.

    The first round reads as many cells as hold about 2k rows; each further one reads up to four times as many for the
    queries that are left, and takes up only rows that reach a query's last one. A query is done when it has k rows and
    (exact) no unread cell can hold one as near as its last, by its centre's angle and radius. The filter is applied as
    the cells' files are read.
    """
    spark = queries.sparkSession
    shared_dir(spark)
    left = queries.where(usable("v", index.centres.shape[1])).select("query_id", "v", F.lit(None).cast("double").alias("last"))
    cells, n = int((index.rows > 0).sum()), max(1, int(index.rows.sum()))
    low, high, found = 0, max(1, -(-2 * k * cells // n)), None
    while low < cells:
        order = _ordered(index, True, low, high)
        told = left.withColumn("_o", order(F.col("v"))).select("query_id", "v", "last", "_o.cells", "_o.rest").checkpoint()
        if told.isEmpty():
            break
        new = _searched(index, told.select("query_id", "v", (F.col("last") - 1e-8).alias("last"), F.explode("cells").alias("cell")), k, vector, where)
        found = _ranked(new if found is None else found.drop("rank").unionByName(new), index.key, k).checkpoint()
        last = found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("last"))
        done = F.col("last") > F.col("rest") + 1e-8 if exact else F.col("last").isNotNull()
        left = told.drop("last").join(last, "query_id", "left").where(~F.coalesce(done, F.lit(False))).select("query_id", "v", "last")
        low, high = high, 4 * high
    return found if found is not None else spark.createDataFrame([], f"query_id bigint, {index.key} bigint, similarity double, rank int")
