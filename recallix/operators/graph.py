"""Association graphs: expansion, spreading activation, statistics, edge updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DYNAMICS
from ..functions.dynamics import clamped, coactivated
from ..storage import shared_dir
from .search import top_k


def _kept(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def expand(seeds: DataFrame, edges: DataFrame, rounds: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, weight, path) reached from seeds (*by, id): each hop multiplies by the edge and 0.8, and stops below 0.1.

    Level by level, a node keeps the first level's best path (greatest weight, then smallest predecessor). A weight of
    0.8 to the tenth is the least that passes, so ten rounds are all. With `by` each group of seeds walks on its own, and
    all groups in one plan.
    """
    own, places = list(by), [*by, "id"]
    level = seeds.select(*places).distinct().select(*places, F.lit(1.0).alias("weight"), F.array("id").alias("path"))
    seen = level = _kept(level)
    hops = edges.select("src", "dst", clamped(F.col("weight")).alias("edge"))
    for _ in range(rounds):
        step = level.join(hops, level["id"] == hops["src"]).withColumn("_w", F.col("weight") * F.col("edge") * DYNAMICS.hop)
        step = step.where(F.col("_w") >= DYNAMICS.least_hop).join(seen.select(*own, F.col("id").alias("dst")), [*own, "dst"], "left_anti")
        best = F.min_by(F.struct(F.col("_w").alias("weight"), F.concat("path", F.array("dst")).alias("path")), F.struct((-F.col("_w")).alias("m"), F.col("src")))
        level = _kept(step.groupBy(*own, "dst").agg(best.alias("b")).select(*own, F.col("dst").alias("id"), "b.weight", "b.path"))
        if level.isEmpty():
            break
        seen = _kept(seen.unionByName(level))
    return seen


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, activation): an active edge brings its target the activation along the target's own out-edges, once per
    active incoming edge; the greater of the old and the new stays."""
    active = _kept(seeds.select("id").distinct().select("id", F.lit(1.0).alias("activation")))
    for _ in range(rounds):
        a = active.select(F.col("id").alias("_n"), F.col("activation").alias("_a"))
        energy = edges.join(a, edges["dst"] == a["_n"]).groupBy("src").agg(F.sum(F.col("weight") * F.col("_a") * F.exp(F.lit(-DYNAMICS.spread))).alias("energy"))
        hits = edges.join(a, edges["src"] == a["_n"]).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        new = hits.join(energy, hits["dst"] == energy["src"], "left").select(F.col("dst").alias("_d"), (F.coalesce("energy", F.lit(0.0)) * F.col("n")).alias("_v"))
        active = _kept(active.join(new, active["id"] == new["_d"], "full_outer").select(F.coalesce("id", "_d").alias("id"), F.greatest(F.coalesce("activation", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))).alias("activation")))
    return active


def node_energy(edges: DataFrame, active: DataFrame) -> DataFrame:
    a = active.select(F.col("id").alias("dst"), "activation")
    return edges.join(a, "dst").groupBy("src").agg(F.sum(F.col("weight") * F.col("activation") * F.exp(F.lit(-DYNAMICS.spread))).alias("energy"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean out-degree and nodes without an edge at either end."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    every = nodes.select("id").union(touched).distinct()
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    rows = every.join(degree, "id", "left").join(touched.withColumn("t", F.lit(1)), "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("d"), F.lit(0)).alias("edges"), F.avg(F.coalesce("d", F.lit(0))).alias("mean_degree"), F.count_if(F.col("t").isNull()).alias("isolated"))


def central(edges: DataFrame, importance: DataFrame, limit: int = 10) -> DataFrame:
    both = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return both.join(importance, "id").select("id", "degree", (F.col("degree") * F.col("importance")).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(limit)


def pruned(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("weight") >= DYNAMICS.prune)


def path_reinforced(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """0.05 for every traversal of an edge along a path, up to 1."""
    steps = paths.where(F.size("path") > 1).select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")))).alias("s"))
    n = steps.select(F.col("s.0").alias("src"), F.col("s.1").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    return edges.join(n, ["src", "dst"], "left").withColumn("weight", F.least(F.lit(1.0), F.col("weight") + DYNAMICS.edge_boost * F.coalesce("_n", F.lit(0)))).drop("_n")


def coactivation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """New weights of pairs (src, dst, hours): one update each from the edge's weight or 0."""
    e = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return pairs.join(e, ["src", "dst"], "left").withColumn("weight", coactivated(F.coalesce("weight", F.lit(0.0)), F.col("hours")))


def coactivation_folded(pairs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, updates) of pairs (src, dst, hours) after all their updates, from the edge's weight or 0. Each
    update leaves a share of what is missing to 1, so that their order does not count."""
    left = pairs.groupBy("src", "dst").agg(F.product(1 - coactivated(F.lit(0.0), F.col("hours"))).alias("_left"), F.count(F.lit(1)).alias("updates"))
    if edges is not None:
        left = left.join(edges.groupBy("src", "dst").agg(F.max("weight").alias("_w")), ["src", "dst"], "left")
    missing = 1 - F.coalesce("_w", F.lit(0.0)) if edges is not None else F.lit(1.0)
    return left.select("src", "dst", (1 - missing * F.col("_left")).alias("weight"), "updates")


def best_edges(similar: DataFrame) -> DataFrame:
    """One out-edge per memory, to its most similar one (query_id, id, similarity); without one, to itself."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return similar.withColumn("_r", rank).where("_r = 1").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("similarity").alias("weight"))


def contextual(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of 0.3 for pairs that have none, 0.1 more for those that do."""
    p = pairs.select("src", "dst").distinct().withColumn("_p", F.lit(1))
    both = edges.join(p, ["src", "dst"], "full_outer")
    w = F.when(F.col("_p").isNull(), F.col("weight")).when(F.col("weight").isNull(), 0.3).otherwise(F.least(F.lit(1.0), F.col("weight") + 0.1))
    return both.select("src", "dst", w.alias("weight"))


def cross_sector(memories: DataFrame, weight: float = 0.5) -> DataFrame:
    """Edges both ways between a memory (id, additional) and each of its further sectors."""
    one = memories.select(F.col("id").cast("string").alias("src"), F.explode("additional").alias("s")).select("src", F.concat_ws(":", "src", "s").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(weight))


def inter_memory(vectors: DataFrame, new: DataFrame, least: float = 0.75, weight: float = 0.5) -> DataFrame:
    """Edges both ways between new vectors (id, sector, v) and those of their sector that are similar enough."""
    met = top_k(vectors, new.withColumnRenamed("id", "query_id"), 2**31 - 1, include_self=False, least=least)
    one = met.select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(weight))
