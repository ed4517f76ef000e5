"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt by hash into shards of bounded size, and each shard has its own graph. A
further coordinate brings a shard's vectors to one length, so that the nearest vector on the sphere is that with the
largest inner product. Nodes enter the graph in growing batches: a greedy search from the starts proposes
neighbours; pruning keeps a candidate only if no kept one is nearer to it by the factor `relax` than the node itself is,
which leaves diverse edges; edges back are added, and pruned where a node has too many. A query walks each shard's graph
with a beam, whose nodes are then compared in double precision; the shards' best meet in one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, quoted, short_batches
from .embeddings import usable


@dataclass(frozen=True)
class Graph:
    """degree: most edges of a node; beam: width of the greedy search of the building and of queries; relax: factor of
    the pruning's distances; shard: nodes of a shard, about; wide: nodes that a search expands at a time; batch: most
    searches that run side by side; queries: query vectors that meet a shard at a time; starts: nodes where walks begin."""

    degree: int = 32
    build_beam: int = 64
    beam: int = 128
    relax: float = 1.2
    shard: int = 4096
    wide: int = 4
    batch: int = 256
    queries: int = 2048
    starts: int = 48
    seed: int = 5


INDEX = "shard long, dim int, ids binary, vectors binary, points binary, edges binary, starts binary"


def beam_search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, asked: np.ndarray, beam: int, wide: int) -> np.ndarray:
    """The nodes (-1: none) that each of the asked vectors' walks holds at its end, nearest first.

    A walk expands its nearest nodes that are not yet expanded, `wide` at a time, and holds the `beam` nearest ones seen;
    it ends when all that it holds are expanded. All walks move side by side.
    """
    n, degree = edges.shape
    rows = np.arange(len(asked))
    held = np.full((len(asked), beam), -1, np.int64)
    near = np.full((len(asked), beam), -np.inf, points.dtype)
    done = np.ones((len(asked), beam), bool)
    first = asked @ points[starts].T
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    begun = order.shape[1]
    held[:, :begun], near[:, :begun], done[:, :begun] = starts[order], np.take_along_axis(first, order, 1), False
    seen = np.zeros((len(asked), n + 1), bool)  # the last column stands for "no edge"
    seen[:, starts] = seen[:, n] = True
    while len(rows):
        order = np.argsort(done[rows], axis=1, kind="stable")[:, :wide]
        fresh = ~np.take_along_axis(done[rows], order, 1)
        some = fresh[:, 0]
        rows, order, fresh = rows[some], order[some], fresh[some]
        if not len(rows):
            break
        done[rows[:, None], order] = True
        nodes = np.where(fresh, held[rows[:, None], order], n)
        next_ = np.where(nodes[:, :, None] < n, edges[np.minimum(nodes, n - 1)], n).reshape(len(rows), -1)
        next_ = np.sort(np.where(next_ < 0, n, next_), axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
        known = seen[rows[:, None], next_]
        seen[rows[:, None], next_] = True
        close = np.full(next_.shape, -np.inf, points.dtype)
        r, c = np.nonzero(~known)
        close[r, c] = np.einsum("ij,ij->i", points[next_[r, c]], asked[rows[r]])
        all_near = np.concatenate([near[rows], close], 1)
        all_held = np.concatenate([held[rows], np.where(known, -1, next_)], 1)
        all_done = np.concatenate([done[rows], known], 1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[rows], held[rows], done[rows] = (np.take_along_axis(x, top, 1) for x in (all_near, all_held, all_done))
    return held


def pruned(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to `degree` of the found neighbours (-1: none) of each node, nearest first: one is kept unless a kept one is
    nearer to it, times `relax`, than the node is. Distances are between unit vectors."""
    found = np.sort(np.where(found == nodes[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    x = points[np.maximum(found, 0)]
    apart = np.where(found >= 0, np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", x, points[nodes])), np.inf)
    order = np.argsort(apart, axis=1, kind="stable")
    order = order[:, : int((found >= 0).sum(1).max(initial=0))]
    found, apart = np.take_along_axis(found, order, 1), np.take_along_axis(apart, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    between = np.maximum(0, 2 - 2 * np.matmul(x, x.transpose(0, 2, 1)))
    alive, rows = found >= 0, np.arange(len(nodes))
    kept = np.full((len(nodes), degree), -1, np.int64)
    for i in range(min(degree, found.shape[1])):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        kept[some, i] = found[rows, pick][some]
        alive &= relax * relax * between[rows, pick] > apart
        alive[rows, pick] = False
    return kept


def build_graph(points: np.ndarray, g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node by degree, -1: none) and the starts of a graph over the points of on_sphere(): the most central node,
    those of the longest vectors, which lie apart from the others there, and some by chance."""
    n = len(points)
    edges = np.full((n, g.degree), -1, np.int64)
    central = int((points @ points.mean(0)).argmax())
    order = np.random.default_rng([g.seed, n]).permutation(n)
    longest = np.argsort(points[:, -1], kind="stable")[: g.starts // 2]
    starts = np.array(list(dict.fromkeys([central, *longest.tolist(), *order[: g.starts - g.starts // 2 - 1].tolist()])))
    order = np.concatenate([starts[1:], order[~np.isin(order, starts)]])
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        at, size = at + len(batch), min(2 * size, g.batch)
        found = beam_search(points, edges, starts, points[batch], g.build_beam, g.wide)
        edges[batch] = out = pruned(points, batch, found, g.degree, g.relax)
        src, dst = np.repeat(batch, g.degree), out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        for low in range(0, len(to), g.batch):
            t, c = to[low : low + g.batch], count[low : low + g.batch]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            more[np.repeat(np.arange(len(t)), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = src[first[low] : first[low] + c.sum()]
            wide = np.concatenate([edges[t], more], 1)
            full = (wide >= 0).sum(1) > g.degree
            if (~full).any():
                edges[t[~full]] = -np.sort(-wide[~full], axis=1)[:, : g.degree]
            for part in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) * wide.shape[1] ** 2 // (1 << 22)))):
                if len(part):
                    edges[t[part]] = pruned(points, t[part], wide[part], g.degree, g.relax)
    return edges, starts


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """The vectors over their greatest length, with a further coordinate that brings each to length one."""
    scaled = vectors / np.abs(vectors).max()
    x = scaled / np.sqrt((scaled * scaled).sum(1)).max()
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def _nodes(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(rep, dim, v) of the distinct vectors, and (rep, id) of each one's k + 1 smallest ids."""
    rows = df.select(F.col(quoted(key)).cast("bigint").alias("id"), F.transform(F.col(quoted(vector)), lambda x: x.cast("double") + 0.0).alias("v")).where(F.col("id").isNotNull()).where(usable("v"))
    rows = rows.select("id", "v", F.struct(F.xxhash64("v"), F.xxhash64(F.lit("other"), "v")).alias("name"))
    smallest = Window.partitionBy("name").orderBy("id")
    ids = rows.select("name", "id").distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = cut_lineage(rows.groupBy("name").agg(F.min("id").alias("rep"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    return nodes, ids.join(nodes.select("name", "rep"), "name").select("rep", "id")


def build_index(nodes: DataFrame, g: Graph = Graph()) -> DataFrame:
    """One row for each shard of nodes (rep, dim, v): ids, vectors, points on the sphere, edges, starts."""
    size = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / g.shard).cast("int").alias("of"))
    shards = size.agg(F.coalesce(F.sum("of"), F.lit(1))).first()[0]
    dealt = nodes.join(size, "dim").withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(g.seed)), F.col("of")))
    dealt = dealt.select("shard", "dim", "rep", "v").repartition(int(shards), "dim", "shard")  # few bytes, much work

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        ids, dim = group["rep"].to_numpy(), group["dim"][0].as_py()
        vectors = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        points = on_sphere(vectors)
        edges, starts = build_graph(points, g)
        row = [group["shard"][0].as_py(), dim, ids.tobytes(), vectors.tobytes(), points.tobytes(), edges.astype(np.int32).tobytes(), starts.tobytes()]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, kinds, strict=True)], kinds)

    kinds = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("points", pa.binary()), ("edges", pa.binary()), ("starts", pa.binary())])
    return cut_lineage(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX))


def search(index: DataFrame, queries: DataFrame, k: int, g: Graph = Graph()) -> DataFrame:
    """(query_id, rep, score): the k nodes of greatest inner product that each shard's walk finds for queries
    (query_id, dim, v)."""
    size = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / g.queries).cast("int").alias("of"))
    dealt = queries.join(size, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("of")))
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    every = index.select("dim", "shard").join(blocks, "dim")

    @F.arrow_udf("array<struct<query_id:bigint,rep:bigint,score:double>>")
    def walk(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            lists = []
            for dim, ids, vectors, points, edges, starts, asked in zip(*columns, strict=True):
                dim, ids = dim.as_py(), np.frombuffer(ids.as_buffer(), np.int64)
                vectors = np.frombuffer(vectors.as_buffer()).reshape(-1, dim)
                points = np.frombuffer(points.as_buffer(), np.float32).reshape(-1, dim + 1)
                edges = np.frombuffer(edges.as_buffer(), np.int32).reshape(len(ids), -1)
                starts = np.frombuffer(starts.as_buffer(), np.int64)
                names = asked.values.field("query_id").to_numpy()
                q = asked.values.field("v").flatten().to_numpy().reshape(-1, dim)
                out = []
                for low in range(0, len(q), g.batch):
                    part = q[low : low + g.batch]
                    scaled = part / np.abs(part).max(1, keepdims=True)
                    flat = np.concatenate([scaled, np.zeros((len(part), 1))], 1).astype(np.float32)
                    held = beam_search(points, edges, starts, flat, max(g.beam, 2 * k), g.wide)
                    score = np.where(held >= 0, np.einsum("bcd,bd->bc", vectors[held], part), -np.inf)
                    top = np.lexsort((ids[held], -score), axis=1)[:, :k]
                    use = np.take_along_axis(held, top, 1) >= 0
                    out.append((np.repeat(names[low : low + g.batch], use.sum(1)), np.take_along_axis(ids[held], top, 1)[use], np.take_along_axis(score, top, 1)[use]))
                lists.append([np.concatenate(x) for x in zip(*out, strict=True)])
            fields = [pa.array(np.concatenate([x[i] for x in lists])) for i in range(3)]
            ends = np.cumsum([0, *(len(x[0]) for x in lists)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["query_id", "rep", "score"]))

    met = index.join(every, ["dim", "shard"])
    return met.select(F.explode(walk("dim", "ids", "vectors", "points", "edges", "starts", "asked")).alias("m")).select("m.*")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", g: Graph = Graph()) -> DataFrame:
    """(query_id, rank, key, score): for each query its k nearest rows of df that the walks find, by the inner product in
    double precision, ties by key.

    queries: rows with the same key and vector columns; a row of df with the query's own key is no candidate of it. Rows
    of df and queries whose vectors are null, empty, zero or hold null or non-finite components, or without a key, take
    no part; vectors of other dimensions do not meet. Rows that repeat a key and vector count once; of a query's key
    with several vectors each nearest row counts by its best. Other columns are left out; empty tables give none.
    """
    short_batches(df.sparkSession)
    nodes, members = _nodes(df, key, vector, k)
    asked = queries.select(F.col(quoted(key)).cast("bigint").alias("query_id"), F.transform(F.col(quoted(vector)), lambda x: x.cast("double") + 0.0).alias("v")).where("query_id IS NOT NULL").where(usable("v")).dropDuplicates(["query_id", "v"])
    found = search(build_index(nodes, g), asked.withColumn("dim", F.size("v")), k + 1, g)
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    found = found.join(members, "rep").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
