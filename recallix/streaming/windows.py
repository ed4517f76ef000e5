"""Event-time windows and stateful operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..batches import short_batches
from ..storage import fresh_dir


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def rate_limited(requests: DataFrame, most: int, width_ms: int) -> DataFrame:
    """(client, at, allowed): a client's window opens at its first request and admits `most`; then a new one opens."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (-(2**62), 0)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at in rows["at"]:
            if at - start >= width_ms:
                start, n = int(at), 0
            n += 1
            out.append((key[0], int(at), n <= most))
        state.update((start, n))
        yield pd.DataFrame(out, columns=["client", "at", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(step, "client string, at long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and give its result back from files in the shared folder.

    append adds a file set per batch; complete and update keep the last batch's table.
    """
    spark = stream.sparkSession
    out = fresh_dir(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)

    w = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", fresh_dir(spark, "progress"))
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def opened(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    short_batches(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if dict(rows.dtypes).get("ts") == "timestamp_ntz" else rows
