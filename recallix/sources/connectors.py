"""Connectors over exports: items of other services as JSON files in a folder of any file system that Spark knows, as a
table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import CONTENT

#: Connector names and the fields in which their exports hold id, name and text.
FIELDS = {
    "github": ("sha", "path", "content"),
    "google_drive": ("id", "name", "text"),
    "google_sheets": ("spreadsheetId", "title", "values"),
    "google_slides": ("presentationId", "title", "text"),
    "notion": ("id", "title", "markdown"),
    "onedrive": ("id", "name", "content"),
}


def items(rows: DataFrame, connector: str, value: str = "value") -> DataFrame:
    """Items (CONTENT, _corrupt) of texts that each hold one JSON object, or an array of them.

    meta has the fields besides the text, each as its JSON text. What is no JSON object gives a row with _corrupt alone.
    """
    key, name, text = FIELDS[connector]
    listed = F.when(F.ltrim(value).startswith("["), F.col(value)).otherwise(F.concat(F.lit("["), F.col(value), F.lit("]")))
    parsed = F.from_json(listed, "array<map<string,string>>", {"mode": "PERMISSIVE"})
    one = rows.where(F.length(F.trim(value)) > 0).select(F.col(value).alias("_v"), F.explode_outer(F.when(F.size(parsed) > 0, parsed)).alias("m"))
    bad = F.col("m").isNull()
    get = lambda field: F.try_element_at("m", F.lit(field))
    rest = F.to_json(F.map_filter("m", lambda k, v: k != text))
    return one.select(get(key).alias("id"), get(name).alias("name"), F.when(~bad, "text").alias("type"), get(text).alias("text"), F.lit(None).cast("binary").alias("data"), rest.alias("meta"), F.when(bad, F.col("_v")).alias("_corrupt"))


def exports(spark: SparkSession, folder: str, connector: str, stream: bool = False, lines: bool = True, files: int = 1000) -> DataFrame:
    """Items of an export's files: with lines each line of *.jsonl is one, else each *.json file holds one or an array.

    As a stream at most so many new files make a batch; a query's checkpoint holds which it has taken, so that a restart
    takes none twice.
    """
    if connector not in FIELDS:
        raise ValueError(f"no such connector: {connector}; there are {', '.join(FIELDS)}")
    reader = spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read
    reader = reader.option("pathGlobFilter", "*.jsonl" if lines else "*.json").option("wholetext", not lines)
    return items(reader.format("text").load(folder), connector)


__all__ = ["CONTENT", "FIELDS", "exports", "items"]
