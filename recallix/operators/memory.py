"""Reads and writes of memories; every write is a function from state and change to state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEGMENT_SIZE
from ..functions.embedding import simhash
from ..functions.text import classify


def page(rows: DataFrame, limit: int, offset: int = 0, order: str = "created_at") -> DataFrame:
    """Newest first, ties by id."""
    return rows.orderBy(F.desc(order), "id").offset(offset).limit(limit)


def segments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("segment"))


def with_segments(rows: DataFrame, size: int = SEGMENT_SIZE, key: str = "id") -> DataFrame:
    """Number rows by the key and cut them into segments of a size, by counts of key ranges rather than one sort."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) + F.col("_before") - 1
    return ranged.join(F.broadcast(before), "_part").withColumn("segment", F.floor(rank / size).cast("int")).drop("_part", "_before")


def upsert(state: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key, by the order column; new rows win ties."""
    both = state.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def insert_missing(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return state.unionByName(new.dropDuplicates([key]).join(state.select(key), key, "left_anti"))


def deduplicated(rows: DataFrame, boost: float = 0.15, bare: str | None = None) -> DataFrame:
    """One memory per simhash, the first by time and id; each further arrival adds to its salience, up to 1. bare:
    the simhash of all texts without tokens, by default one each."""
    own = rows.withColumn("simhash", simhash(F.col("content"), bare))
    first = F.min_by(F.struct("id", "salience"), F.struct("created_at", "id"))
    g = own.groupBy("simhash").agg(first.alias("f"), F.count(F.lit(1)).alias("arrivals"), F.max("created_at").alias("last_seen_at"))
    return g.select(F.col("f.id").alias("id"), "simhash", "arrivals", "last_seen_at", F.least(F.lit(1.0), F.col("f.salience") + boost * (F.col("arrivals") - 1)).alias("salience"))


def added(rows: DataFrame, now: int) -> DataFrame:
    """Classified memories with their first salience: 0.4 and 0.1 for each additional sector."""
    c = rows.withColumn("_c", classify(F.col("content")))
    return c.select(*rows.columns, F.col("_c.primary").alias("sector"), F.col("_c.additional").alias("additional"), F.lit(now).alias("last_seen_at"), F.least(F.lit(1.0), 0.4 + 0.1 * F.size("_c.additional")).alias("salience"))


def reinforced(state: DataFrame, ids: DataFrame, boost: float = 0.1) -> DataFrame:
    marked = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return state.join(marked, "id", "left").withColumn("salience", F.least(F.lit(1.0), F.col("salience") + boost * F.coalesce("_n", F.lit(0)))).drop("_n")


def cascade_delete(ids: DataFrame, memories: DataFrame, vectors: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, their vectors, and edges at either end."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return memories.join(gone, "id", "left_anti"), vectors.join(gone, "id", "left_anti"), left
