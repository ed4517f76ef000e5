"""Documents to memories: single, or a root with its sections and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passages import section_array
from ..functions.text import estimated_tokens


def ingest(rows: DataFrame, large: int = 8000, section: int = 3000, force_root: bool = False) -> DataFrame:
    """Memories of documents (id, text, kind): (id, parent_id, number, strategy, content, sector).

    A document of more than `large` estimated tokens becomes a root, which says what it is and how it begins, and one
    memory per section; others stay whole. Null texts give no memory.
    """
    d = rows.where("text IS NOT NULL").withColumn("_big", (estimated_tokens(F.col("text")) > large) | F.lit(force_root))
    single = d.where("NOT _big").select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("number"), F.lit("single").alias("strategy"), F.col("text").alias("content"), F.lit(None).cast("string").alias("sector"))
    big = d.where("_big")
    head = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text"))
    content = F.concat(F.lit("[Document: "), F.upper("kind"), F.lit("]\n\n"), head, F.lit("\n\n[Full content split across "), F.ceil(F.length("text") / section).cast("string"), F.lit(" sections]"))
    key = F.col("id").cast("string")
    root = big.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("number"), F.lit("root").alias("strategy"), content.alias("content"), F.lit("reflective").alias("sector"))
    child = big.select("id", key.alias("parent_id"), F.posexplode(section_array(F.col("text"), section)).alias("number", "content"))
    child = child.select("id", "parent_id", (F.col("number") + 1).alias("number"), F.lit("child").alias("strategy"), "content", F.lit(None).cast("string").alias("sector"))
    return single.unionByName(root).unionByName(child)


def links(memories: DataFrame) -> DataFrame:
    """Edges of weight 1 from roots to their sections."""
    return memories.where("strategy = 'child'").select(F.col("parent_id").alias("src"), F.concat_ws("#", "parent_id", F.col("number").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
