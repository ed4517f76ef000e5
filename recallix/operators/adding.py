"""The write path of memories: what is new is classified, cut to its essence, embedded and linked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEGMENT_SIZE
from ..functions import passages, providers
from ..functions.embedding import simhash
from ..functions.text import classify
from ..storage import shared_dir
from . import search
from .memory import with_segments


@dataclass(frozen=True)
class Added:
    """memories, vectors (id, sector, v) and waypoints (src, dst, weight) after a write."""

    memories: DataFrame
    vectors: DataFrame
    waypoints: DataFrame


def embedded(rows: DataFrame, sectors: str, dim: int) -> DataFrame:
    """(id, sector, v): a vector in each of a row's sectors; long texts are the means of their chunks."""
    one = rows.select("id", "_text", F.explode(sectors).alias("sector"))
    return one.select("id", "sector", F.transform(providers.embed_text(F.col("_text"), F.col("sector"), "hybrid", ("synthetic",), dim), lambda x: x.cast("double")).alias("v"))


def add(rows: DataFrame, now: int, state: DataFrame | None = None, means: DataFrame | None = None, dim: int = 256, segment: int = SEGMENT_SIZE, most: int = 200) -> Added:
    """Memories of rows (id, content, user_id, project_id), in order of ids; null contents give none.

    Equal simhashes are one memory, the first; each further arrival adds 0.15 to its salience, up to 1, and arrivals that
    the state (simhash, ...) has already give no memory here (see `strengthened`). Segments are filled in order of ids
    after the state's. A waypoint goes from each new memory to the nearest mean vector of its owner, the state's (means:
    id, user_id, v) or a new one, or to itself where there is none.
    """
    shared_dir(rows.sparkSession)
    own = rows.where("content IS NOT NULL").withColumn("simhash", simhash(F.col("content")))
    if state is not None:
        own = own.join(state.select("simhash").distinct(), "simhash", "left_anti")
    first = F.min_by(F.struct("id", "content", "user_id", "project_id"), F.col("id"))
    fresh = own.groupBy("simhash").agg(first.alias("f"), F.count(F.lit(1)).alias("arrivals")).select("simhash", "arrivals", "f.*")
    c = fresh.withColumn("_c", classify(F.col("content"))).withColumn("_sectors", F.concat(F.array("_c.primary"), F.col("_c.additional")))
    salience = F.least(F.lit(1.0), F.least(F.lit(1.0), 0.4 + 0.1 * F.size("_c.additional")) + 0.15 * (F.col("arrivals") - 1))
    made = c.select("id", F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), "project_id", F.col("content").alias("_text"), passages.essence_of(F.col("content"), most).alias("content"), "simhash", F.col("_c.primary").alias("sector"), "_sectors", "arrivals", salience.alias("salience")).checkpoint()
    begun = (state.agg(F.coalesce(F.max("segment"), F.lit(0)).alias("s")).first()["s"] + 1) if state is not None else 0
    numbered = with_segments(made, segment).withColumn("segment", (F.col("segment") + begun).cast("int"))
    memories = numbered.select("id", "user_id", "project_id", "segment", "content", "simhash", "sector", "arrivals", "salience", F.lit(now).alias("created_at"), F.lit(now).alias("last_seen_at"), F.lit(1).alias("version"))
    vectors = embedded(made, "_sectors", dim).checkpoint()
    mean = search.mean_vectors(vectors).join(memories.select("id", "user_id"), "id").select("id", "user_id", F.col("mean").alias("v"))
    among = mean if means is None else mean.unionByName(means.select("id", "user_id", "v"))
    near = search.top_k(among, mean.withColumnRenamed("id", "query_id"), 1, by="user_id", include_self=False)
    best = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("similarity").alias("weight"))
    links = memories.select(F.col("id").alias("src")).join(best, "src", "left").select("src", F.coalesce("dst", "src").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return Added(memories, vectors, links)


def strengthened(state: DataFrame, rows: DataFrame, now: int, boost: float = 0.15) -> DataFrame:
    """The state's memories after arrivals of their simhash: more salient by each, and just seen. Of several of one
    simhash the most salient one counts, the smallest id on ties."""
    n = rows.where("content IS NOT NULL").groupBy(simhash(F.col("content")).alias("simhash")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("simhash").orderBy(F.desc("salience"), "id"))
    j = state.withColumn("_p", place).join(n, "simhash", "left")
    hit = (F.col("_p") == 1) & F.col("_n").isNotNull()
    out = j.withColumn("salience", F.when(hit, F.least(F.lit(1.0), F.col("salience") + boost * F.col("_n"))).otherwise(F.col("salience")))
    return out.withColumn("last_seen_at", F.when(hit, F.lit(now)).otherwise(F.col("last_seen_at"))).select(state.columns)


def update(memories: DataFrame, vectors: DataFrame, changes: DataFrame, now: int, dim: int = 256) -> Added:
    """Memories and vectors after changes (id, content, tags), null where a part stays.

    A changed content is classified and embedded anew in all its sectors; every changed memory is a version later. No
    waypoints change.
    """
    c = changes.select("id", F.col("content").alias("_content"), F.col("tags").alias("_tags"))
    j = memories.join(c, "id", "left")
    new = F.col("_content").isNotNull() & (F.col("_content") != F.col("content"))
    fresh = j.where(new).select("id", F.col("_content").alias("_text")).withColumn("_c", classify(F.col("_text"))).withColumn("_sectors", F.concat(F.array("_c.primary"), F.col("_c.additional")))
    told = fresh.select("id", F.col("_c.primary").alias("_sector"))
    out = j.join(told, "id", "left").withColumn("sector", F.coalesce("_sector", "sector")).withColumn("content", F.coalesce("_content", "content")).withColumn("tags", F.coalesce("_tags", "tags"))
    changed = F.col("_content").isNotNull() | F.col("_tags").isNotNull()
    out = out.withColumn("version", F.col("version") + changed.cast("int"))
    kept = vectors.join(told.select("id"), "id", "left_anti")
    return Added(out.select(memories.columns), kept.unionByName(embedded(fresh, "_sectors", dim).select(kept.columns)), memories.sparkSession.createDataFrame([], "src bigint, dst bigint, weight double"))
