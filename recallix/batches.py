"""How much a task holds at once: short Arrow batches, and rows spread over the cores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of one Arrow batch: documents may be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and by bytes, where the session allows more. The settings count when a plan runs,
    so they stay; tighter ones of the caller's are kept."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of few files dealt to four tasks a core by their key, for work on each row that outweighs their shuffle: a
    file of one row group is else a single task. Tables of as many files as that stay."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= tasks else rows.repartition(tasks, key)
