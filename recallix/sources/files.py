"""Imports and exports: JSON lines, foreign memory exports, backups, reconciliation, schema repairs, extraction."""

from __future__ import annotations

import hashlib
import hmac
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import text_of

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("created_at", T.LongType()), T.StructField("_corrupt", T.StringType())])
CONTENT = "id string, name string, type string, text string, data binary, meta string"


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records with content, and counts: total, imported, failed."""
    rows = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.col("_corrupt").isNull() & F.col("content").isNotNull()
    counts = rows.select(F.struct(*RECORD.names).alias("r"), good.alias("good")).agg(F.count(F.lit(1)).alias("total"), F.count_if("good").alias("imported"), F.count_if(~F.col("good")).alias("failed"))
    return rows.where(good).drop("_corrupt").withColumn("migrated", F.lit(True)).withColumn("orig_id", F.col("id")), counts


def foreign(rows: DataFrame, provider: str) -> DataFrame:
    """Exports of other memory services as records; each names its fields in its own way."""
    names = {"zep": ("uuid", "session_id", "content"), "mem0": ("id", "user_id", "memory"), "supermemory": ("id", "containerTag", "content")}[provider]
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    key, user, content = map(have, names)
    made = F.coalesce(F.unix_millis(have("created_at").try_to_timestamp() if hasattr(Column, "try_to_timestamp") else F.try_to_timestamp(have("created_at"))), F.lit(0))
    return rows.select(key.alias("id"), F.coalesce(user, F.lit("default")).alias("uid"), content.alias("content"), made.alias("created_at"))


def verify(source: DataFrame, imported: DataFrame, tolerance: float = 0.05, duplicates: float = 0.01) -> DataFrame:
    """Whether counts agree within the tolerance and copies of contents are few."""
    s = source.agg(F.count(F.lit(1)).alias("source"))
    i = imported.agg(F.count(F.lit(1)).alias("imported"), F.approx_count_distinct("content", 0.01).alias("distinct"))
    both = s.crossJoin(i)  # single rows
    share = (F.col("imported") - F.least("imported", "distinct")) / F.greatest(F.col("imported"), F.lit(1))
    return both.select("source", "imported", (F.abs(F.col("imported") - F.col("source")) <= tolerance * F.col("source")).alias("count_ok"), (share <= duplicates + 0.01).alias("duplicates_ok"))


def backup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def restore(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def migrated(rows: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns (name to type) that are missing; a second run changes nothing."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit((defaults or {}).get(name)).cast(kind))
    return rows


def owned(rows: DataFrame, name: str = "__legacy_orphan__") -> DataFrame:
    return rows.withColumn("user_id", F.coalesce("user_id", F.lit(name)))


def extracted(rows: DataFrame) -> DataFrame:
    """Text of items (type, text): HTML is read, text and markup pass, other types give null and an error."""
    kind = F.lower("type")
    html = kind.isin("html", "htm", "text/html")
    plain = kind.isin("txt", "md", "markdown", "text", "text/plain", "text/markdown")
    out = F.when(html, text_of(F.when(html, F.col("text")))).when(plain, F.col("text"))
    return rows.withColumn("content", out).withColumn("error", F.when(~(html | plain), F.concat(F.lit("unsupported type: "), kind)))


def signed(body: Column, signature: Column, secret: str) -> Column:
    """Whether a body carries its HMAC-SHA256, with or without the prefix sha256=."""

    @F.arrow_udf("boolean")
    def run(bodies: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for b, s in zip(bodies.to_pylist(), given.to_pylist(), strict=True):
            made = hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest()
            out.append(bool(s) and hmac.compare_digest(made, s.removeprefix("sha256=")))
        return pa.array(out, pa.bool_())

    return run(body, signature)


def retried(call: Callable[[], object], attempts: int = 3, base: float = 1.0, most: float = 60.0, fatal: tuple = (PermissionError,), sleep=time.sleep):
    """The call's result; after a failure it waits twice as long each time, and never repeats what was refused."""
    for n in range(attempts):
        try:
            return call()
        except fatal:
            raise
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(min(most, base * 2**n))


class TokenBucket:
    """At most `rate` calls a second, with a burst of as many."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep, self.held, self.at = rate, clock, sleep, rate, clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.rate, self.held + (now - self.at) * self.rate)
        self.at = now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held = 1
        self.held -= 1
