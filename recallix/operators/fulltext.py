"""Full-text search over an inverted index in posting blocks, each with a bound of the score that it can give.

Texts are dealt to pages of bounded size as they are read, and a term's block holds its postings of one page; blocks are
then sorted by term, so that a search reads those of its own terms. A query first adds up, from the blocks' heads alone,
what each page can give at most, and scores its most promising pages; the k-th best score so found is a floor, and only
pages that can reach it are scored at all. The result is that of scoring every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_counts
from ..storage import fresh_dir, remove

#: Texts of a page, about; pages that a query scores before it skips any; queries that meet a page at once.
PAGE, FIRST, QUERIES = 1024, 4, 256
BLOCK = "term string, page bigint, n bigint, most int, least int, places array<int>, tfs array<int>, ids array<bigint>, lengths array<int>"


@dataclass(frozen=True)
class Index:
    """Where the blocks lie (BLOCK: n postings, their greatest count and shortest length, places in the page and counts; a
    page's own row has no term, but its texts' ids and lengths), how many texts there are, and their mean length; k1 and
    b of the scores."""

    folder: str
    texts: int
    mean: float
    k1: float = 1.2
    b: float = 0.75

    def weight(self, tf: Column, length: Column) -> Column:
        """The part of a BM25 score that does not depend on the query; it grows with tf and falls with the length."""
        tf = tf.cast("double")
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * (length / F.lit(self.mean or 1.0))))


def _page(number: int, keys: list[int], counts: list) -> pa.RecordBatch:
    """The page's row, which has no term, and its blocks by term."""
    names = {}
    term = np.array([names.setdefault(t, len(names)) for c in counts for t in c], np.int64)
    size = np.array([c.total() for c in counts], np.int64)
    text = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    tf = np.array([n for c in counts for n in c.values()], np.int64)
    by = np.argsort(term, kind="stable")
    term, text, tf = term[by], text[by], tf[by]
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    ends = pa.array(np.r_[0, starts], pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
    own = lambda values, kind: pa.array([values, *[None] * len(names)], pa.list_(kind))
    most = np.maximum.reduceat(tf, starts[:-1]) if len(tf) else tf
    least = np.minimum.reduceat(size[text], starts[:-1]) if len(tf) else tf
    columns = [pa.array([None, *names], pa.string()), pa.array([number] * (len(names) + 1), pa.int64()), pa.array(np.r_[len(counts), np.diff(starts)], pa.int64())]
    columns += [pa.array(np.r_[0, most], pa.int32()), pa.array(np.r_[0, least], pa.int32()), lists(text), lists(tf), own(keys, pa.int64()), own(size, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])


def term_counts(text: Column) -> Column:
    """Canonical terms of a whole text with their numbers."""

    @F.arrow_udf("array<struct<term:string,n:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"term": t, "n": n} for t, n in canonical_counts(x).items()] for x in batch.to_pylist()], kind)

    return run(text)


def build(rows: DataFrame, key: str = "id", text: str = "content", page: int = PAGE, k1: float = 1.2, b: float = 0.75) -> Index:
    """Index the whole texts of rows (one row a key) by their canonical terms, in the shared folder.

    Null texts and texts without terms are indexed as texts of length 0: they count for the means, and are never found.
    Pages are made where the texts are read; only blocks are shuffled, into the order of their terms.
    """
    spark = rows.sparkSession
    folder = fresh_dir(spark, "fulltext")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, counts = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                counts.append(canonical_counts(x.as_py()))
                if len(keys) >= page:
                    yield _page(number, keys, counts)
                    number, keys, counts = number + 1, [], []
        if keys:
            yield _page(number, keys, counts)

    rows.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(pages, BLOCK).write.parquet(f"{folder}/pages")
    made = spark.read.schema(BLOCK).parquet(f"{folder}/pages")
    size = F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda x, y: x + y))
    n, total = made.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(size, F.lit(0))).first()
    # a term's blocks lie side by side, so that a scan skips files and row groups by their terms
    made.repartitionByRange("term", "page").sortWithinPartitions("term", "page").write.parquet(f"{folder}/blocks")
    remove(spark, f"{folder}/pages")
    return Index(f"{folder}/blocks", n, total / n if n else 0.0, k1, b)


def _scored(index: Index, pages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the k best texts of the given pages (query_id, page) of each query (query_id, term, idf).

    A page's blocks meet the queries, QUERIES at a time, in one task; k texts at most leave it for each query."""
    of = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(of)).cast("int").alias("part")
    asks = asked.select(part, "term", F.struct("query_id", "idf").alias("ask")).groupBy("part", "term").agg(F.collect_list("ask").alias("asks"))
    wanted = pages.select(part, "page", "query_id").groupBy("part", "page").agg(F.collect_list("query_id").alias("wanted"))
    blocks = pages.sparkSession.read.schema(BLOCK).parquet(index.folder)
    met = blocks.where("term IS NOT NULL").select("term", "page", "places", "tfs").join(asks, "term").drop("term").join(wanted.select("part", "page"), ["part", "page"], "left_semi")
    heads = blocks.where("term IS NULL").select("page", "ids", "lengths").join(wanted, "page")
    rows = met.unionByName(heads, allowMissingColumns=True)
    k1, b, mean = index.k1, index.b, index.mean or 1.0

    def score(group: pa.Table) -> pa.Table:
        head = next(i for i, x in enumerate(group["wanted"]) if x.is_valid)
        kept, texts, lengths = group["wanted"][head].as_py(), group["ids"][head].values.to_numpy(), group["lengths"][head].values.to_numpy()
        place, total = {q: i for i, q in enumerate(kept)}, np.zeros((len(kept), len(texts)))
        for i, (places, tfs, asks) in enumerate(zip(group["places"], group["tfs"], group["asks"].to_pylist(), strict=True)):
            if i == head:
                continue
            at, tf = places.values.to_numpy(), tfs.values.to_numpy().astype(float)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (lengths[at] / mean)))
            for ask in asks:
                if (row := place.get(ask["query_id"])) is not None:
                    total[row, at] += ask["idf"] * weight
        out = []
        for q, row in zip(kept, np.round(total, 9), strict=True):
            some = np.flatnonzero(row > 0)
            top = some[np.lexsort((texts[some], -row[some]))[:k]]
            out.append((np.full(len(top), q, np.int64), texts[top], row[top]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    return best(rows.groupBy("part", "page").applyInArrow(score, "query_id bigint, id bigint, score double"), k).drop("rank")


def best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bounds(index: Index, queries: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query_id, term, idf) of the queries' distinct terms, and (query_id, page, bound, place) of the pages that hold
    any of them: what a text of the page can score at most, and the page's place by that."""
    spark = queries.sparkSession
    folder = fresh_dir(spark, "asked")
    terms = queries.select("query_id", F.explode(term_counts(F.col(text))).alias("t")).select("query_id", F.col("t.term").alias("term")).distinct()
    terms.write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    heads = spark.read.schema(BLOCK).parquet(index.folder).where("term IS NOT NULL").select("term", "page", "n", "most", "least").join(terms.select("term").distinct(), "term", "left_semi")
    heads.write.parquet(f"{folder}/heads")
    heads = spark.read.parquet(f"{folder}/heads")
    df = F.sum("n")
    idf = heads.groupBy("term").agg(F.greatest(F.log((index.texts - df + 0.5) / (df + 0.5)), F.lit(1e-6)).alias("idf"))
    asked = terms.join(idf, "term")
    top = index.weight(F.col("most"), F.col("least"))
    bound = heads.select("term", "page", top.alias("top")).join(asked, "term").groupBy("query_id", "page").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "page"))
    bound.withColumn("place", place).write.parquet(f"{folder}/pages")
    return asked, spark.read.parquet(f"{folder}/pages")


def search(index: Index, queries: DataFrame, k: int = 10, text: str = "text", first: int = FIRST) -> DataFrame:
    """(query_id, id, score, rank): the k texts of the highest BM25 score above 0 for each query (query_id, text), scores
    to nine places, ties by id. Each distinct canonical term counts once; a term that most texts hold counts 0.000001."""
    spark = queries.sparkSession
    asked, pages = bounds(index, queries, text)
    folder = fresh_dir(spark, "scored")
    _scored(index, pages.where(F.col("place") <= first).select("query_id", "page"), asked, k).write.parquet(folder)
    begun = spark.read.parquet(folder)
    floor = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    rest = _scored(index, reaching(pages, floor, k, first).select("query_id", "page"), asked, k)
    return best(begun.unionByName(rest), k)


def reaching(pages: DataFrame, floor: DataFrame, k: int, first: int) -> DataFrame:
    """Pages after the first ones that can still reach a query's floor (query_id, found, least)."""
    rest = pages.where(F.col("place") > first).join(floor, "query_id", "left")
    full = F.coalesce("found", F.lit(0)) >= k
    return rest.where(~full | (F.col("bound") >= F.col("least") - 1e-8))
