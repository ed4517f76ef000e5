"""A corpus from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallix.llm import jaccard, packing, quality, secret_scan, toxicity
from recallix.llm.common import fresh_dir, quoted
from recallix.ship import ship
from recallix.storage import remove

ORACLE_SQL = None


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column, so that no operator's own columns replace any of it."""
    return docs.select("doc_id", "text", F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest. Null and empty texts fail the base rules; repeated
    rows are judged alike; further columns stay, whatever their names; an empty table gives an empty one."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality(with_row(docs), labels).where("kept")
    return judged.select("_row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. Null texts are judged as empty ones; the rest is as above."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    judged = toxicity.score(with_row(docs), model).where("predicted = 0")
    return judged.select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Null texts, texts without words and
    rows without a doc_id stay; of rows with one doc_id and one text one stays."""
    ship(spark)
    return jaccard.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark, and n_chars, where there is one, to match. All rows stay."""
    ship(spark)
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(quoted(c)) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 ids: sequence_id, length, pieces (doc_id, piece, start, length, offset) and ids.
    A null text is a document of its end id alone; repeated rows are packed each; an empty table gives no sequence."""
    ship(spark)
    pieces = packing.cut_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.sequences(packing.pack(pieces, order=("doc_id", "piece", "ids")))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again; a stage's folder goes when the
    next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return docs
