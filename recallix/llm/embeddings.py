"""Near duplicates among embeddings by spherical-cap filters.

Directions are those of a random product code: a vector is turned, cut into blocks, and each block has its own random
codewords; a filter is one codeword per block. Each vector is list-decoded to all filters whose direction it exceeds
the cap's height for, which the block structure finds without looking at all of them. Vectors of one label that share a
filter are compared in double precision, in blocks of bounded size. A link counts where it is found first (at its
smallest common filter), so pairs are counted without being listed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, quoted, short_batches
from .components import components


@dataclass(frozen=True)
class Caps:
    """The link's cosine; independent codes; blocks of each code and codewords of each block (none: sized for the number
    of vectors); filters of a code that a vector exceeds on average, and the fewest that it gets: where the cap's height
    leaves fewer, the vector's own height is lowered to that of its fewest-th best filter. block: most vectors that are
    compared at a time."""

    least: float = 0.98
    codes: int = 3
    blocks: int = 2
    codewords: int | None = None
    mean_filters: float = 6.0
    fewest: int = 8
    block: int = 512
    seed: int = 11

    def sized(self, vectors: int, most: int = 1024) -> Caps:
        """With four filters of a code for each vector, so that a filter's vectors stay as few at any number of them;
        more blocks rather than more than `most` codewords a block, which bounds a vector's decoding."""
        if self.codewords:
            return self
        filters, blocks = max(4096, 4 * vectors), self.blocks
        while filters ** (1 / blocks) > most:
            blocks += 1
        return replace(self, blocks=blocks, codewords=math.ceil(filters ** (1 / blocks)))


@functools.lru_cache(maxsize=16)
def _code(dim: int, caps: Caps, which: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, codewords of the blocks, and the cap's height (in sums over blocks) for vectors of a dimension."""
    rng = np.random.default_rng([caps.seed, dim, which])
    wide = caps.blocks * -(-max(dim, 2) // caps.blocks)
    turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, :dim]
    words = [(w := rng.normal(size=(caps.codewords, wide // caps.blocks))) / np.linalg.norm(w, axis=1, keepdims=True) for _ in range(caps.blocks)]
    share = min(0.5, caps.mean_filters / caps.codewords**caps.blocks)
    return turn, words, NormalDist().inv_cdf(1 - share) * (caps.blocks / wide) ** 0.5


def _best_sums(parts: list[np.ndarray], few: int) -> np.ndarray:
    """The `few` greatest sums of one value from each part, greatest first."""
    sums = np.zeros(1)
    for p in parts:
        top = np.sort(p)[::-1][:few]
        sums = np.sort((sums[:, None] + top[None, :]).ravel())[::-1][:few]
    return sums


def decode(x: np.ndarray, caps: Caps) -> np.ndarray:
    """Sorted ids of all filters that the unit vector x exceeds the height for, by pruned sums of its blocks."""
    found, few = [], min(caps.fewest, caps.codewords**caps.blocks)
    for which in range(caps.codes):
        turn, words, height = _code(len(x), caps, which)
        parts = [w @ y for w, y in zip(words, np.split(turn @ x, caps.blocks), strict=True)]
        need = min(height, _best_sums(parts, few)[-1] - 1e-12)
        rest = sum(p.max() for p in parts)
        sums, ids = np.zeros(1), np.full(1, which, np.int64)
        for p in parts:
            rest -= p.max()
            fit = np.flatnonzero(p >= need - rest - sums.max())
            i, j = np.nonzero(sums[:, None] + p[fit][None, :] >= need - rest)
            sums, ids = sums[i] + p[fit[j]], ids[i] * caps.codewords + fit[j]
        found.append(ids[sums >= need])
    return np.unique(np.concatenate(found)).astype(np.int64)


def scaled(values: np.ndarray) -> np.ndarray:
    """Divided by a power of two near the largest component, which rounds nothing that counts, so that no square over-
    or underflows."""
    most = np.abs(values).max(initial=0.0)
    return np.ldexp(values, -int(np.frexp(most)[1])) if most > 0 and np.isfinite(most) else values


def unit(values: np.ndarray) -> np.ndarray | None:
    values = scaled(values)
    norm = np.sqrt((values * values).sum())
    return values / norm if np.isfinite(norm) and norm > 0 else None


def usable(vector: str) -> F.Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(quoted(vector))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _links(rows: list, f: int, cross: bool, caps: Caps):
    """Links of one block pair, between its blocks (cross) or in one, at filter f: sums of copies where the link is not known from a smaller filter, and a
    spanning forest."""
    node = np.array([r[0] for r in rows], object)
    copies = np.array([r[1] for r in rows], np.int64)
    x = np.array([np.frombuffer(r[2], np.float64) for r in rows])
    norm = np.sqrt((x * x).sum(1))
    hit = (x @ x.T) / (norm[:, None] * norm[None, :]) >= caps.least
    np.fill_diagonal(hit, False)
    side = np.array([r[4] for r in rows])
    if cross:
        hit &= side[:, None] != side[None, :]
    some = np.flatnonzero(hit.any(1))
    if not len(some):
        return [], []
    hit, node, copies = hit[np.ix_(some, some)], node[some], copies[some]
    lists = [(g := np.frombuffer(rows[i][3], np.int64))[g < f] for i in some]
    values, owner = np.concatenate(lists), np.repeat(np.arange(len(some)), [len(g) for g in lists])
    fresh = hit
    if len(values):
        names, number = np.unique(values, return_inverse=True)
        seen = np.zeros((len(some), len(some)), np.float32)
        for lo in range(0, len(names), 4096):
            part = (number >= lo) & (number < lo + 4096)
            m = np.zeros((len(some), min(4096, len(names) - lo)), np.float32)
            m[owner[part], number[part] - lo] = 1
            seen += m @ m.T
        fresh = hit & (seen == 0)
    sums = fresh @ copies
    top = np.arange(len(some))
    while True:  # smallest position reachable, by halving steps
        least = np.where(hit, top[None, :], len(some)).min(1)
        new = np.minimum(top, least)
        new = new[new]
        if (new == top).all():
            break
        top = new
    return [(node[i], int(sums[i])) for i in np.flatnonzero(sums)], [(node[i], node[t]) for i, t in enumerate(top) if i != t]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", caps: Caps = Caps()) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df.

    Rows link if their labels are equal and not null, their vectors have one dimension, and their cosine in double
    precision is caps.least or more. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null key, link with nothing; a null key has a null component and is kept. n_links counts other rows, equal
    ones included; component_id is the smallest key that links reach; kept says that it is the row's own. An empty
    table gives an empty one; further columns are left out.
    """
    spark = df.sparkSession
    short_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).alias("label"), F.transform(F.col(quoted(vector)), lambda x: x.cast("double")).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    rows = rows.withColumn("node", F.when(good, F.unhex(F.concat(half("label", "v"), half(F.lit("other"), "v", "label")))))
    rows = cut_lineage(rows.withColumn("v", F.when(good, F.col("v"))))
    n = rows.count()
    caps = caps.sized(n)
    # equal vectors are one node, named by two 64-bit hashes
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))

    @F.arrow_udf("struct<x:binary,filters:array<bigint>>")
    def caps_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            xs, out = [], []
            for v in batch:
                x = scaled(np.array(v.as_py(), np.float64))
                u = unit(x)
                xs.append(x.tobytes())
                out.append(decode(u, caps) if u is not None else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(xs, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["x", "filters"])

    nodes = classes.withColumn("_c", caps_of.asNondeterministic()(F.col("v"))).select("node", "rep", "copies", "label", F.col("_c.x").alias("x"), F.col("_c.filters").alias("filters"))
    nodes = cut_lineage(nodes, n)
    at = nodes.select("node", "label", F.octet_length("x").alias("wide"), F.explode("filters").alias("f"))
    keys = ["label", "wide", "f"]
    size = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(*keys, F.ceil(F.col("_m") / caps.block).cast("int").alias("_nb"))
    shared = at.join(size, keys)

    # the filter lists travel with the vectors, as bytes
    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([np.array(v.as_py(), np.int64).tobytes() for v in lists], pa.binary())

    full = shared.join(nodes.select("node", "copies", "x", packed(F.col("filters")).alias("list")), "node")
    full = full.withColumn("_h", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: F.struct(F.least(F.col("_h"), o).alias("i"), F.greatest(F.col("_h"), o).alias("j")))
    spread = full.select(*keys, F.explode(pair).alias("_p"), "node", "copies", "x", "list", "_h")
    spread = spread.select(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "node", "copies", "x", "list", (F.col("_h") != F.col("_p.i")).alias("side"))
    ordered = spread.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done():
            if len(held) < 2:
                return None
            links, edges = _links(held, now[2], now[3] != now[4], caps)
            if not links and not edges:
                return None
            n = len(links)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links + edges], pa.binary()), pa.array([None] * n + [x[1] for x in edges], pa.binary()), pa.array([x[1] for x in links] + [None] * len(edges), pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for lab, wide, f, i, j, node, copies, x, lists, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lab, wide, f, i, j) != now:
                    if out := done():
                        yield out
                    held, now = [], (lab, wide, f, i, j)
                held.append((node, copies, x, lists, side))
        if out := done():
            yield out

    found = cut_lineage(ordered.mapInArrow(work, "a binary, b binary, n bigint"), n)
    groups = components(found.where("b IS NOT NULL").select("a", "b"), rows=n)
    links = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("_links"))
    own = nodes.select("node", "rep", "copies").join(groups, F.col("node") == F.col("id"), "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("rep").alias("component_id"))
    table = own.join(least, "label").join(links, F.col("node") == F.col("a"), "left")
    table = table.select(F.col("node").alias("_node"), "component_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "node").join(table, F.col("node") == F.col("_node"), "left")
    linked = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), linked.alias("component_id"), F.coalesce(F.col("id") == linked, F.lit(True)).alias("kept"))
