"""Ranked lexical search over an index that is split by documents.

Each task takes its documents apart and writes shards: a shard holds up to so many bytes of text, its documents in the
order of their ids, and one posting list for each term, ascending, as gaps and counts in variable-length bytes. Nothing
is shuffled for that. A batch of queries reads the lists of its own terms. In each shard a query merges its lists
through a heap, document by document, and keeps its best ones in a bounded heap by score, then id; lists whose greatest
scores together cannot reach the heap's least one leave the merge and are only looked up. The shards' best meet in one
ranking.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, quoted, short_batches

#: Bytes of text of one shard, about; bytes of a text that are taken apart at a time; queries that meet a shard at once.
SHARD_BYTES, PART_BYTES, QUERIES = 16 << 20, 1 << 20, 256
#: Everything but digits, letters and what lies beyond ASCII becomes a space; A-Z become a-z.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))
INDEX = "shard bigint, term string, df bigint, times bigint, docs binary, postings binary"


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text and their numbers; long texts in parts that end between terms."""
    found, at = Counter(), 0
    while at < len(text):
        part = text[at : at + PART_BYTES].translate(_FOLD)
        cut = len(part)
        if at + cut < len(text) and (cut := part.rfind(b" ") + 1) == 0:  # one term over the whole part
            end = at + len(part)
            while end < len(text) and text[end : end + 1].translate(_FOLD) != b" ":
                end += 1
            part, cut = text[at:end].translate(_FOLD), end - at
        found.update(part[:cut].split())
        at += cut
    return found


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative integers, 7 bits each, low ones first, and where each value's bytes end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for i in range(1, 9):
        size += values >= np.uint64(1 << 7 * i)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        low = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[(ends - size)[has] + i] = low | np.where(size[has] > i + 1, 128, 0).astype(np.uint64)
    return out, ends


def from_bytes(data: bytes) -> np.ndarray:
    """The integers of to_bytes()."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts) if len(last) else np.zeros(0, np.int64)


class _Shard:
    """Documents of a shard that is being written."""

    def __init__(self):
        self.names, self.ids, self.lengths, self.size = {}, [], [], 0
        self.term, self.doc, self.tf = array("I"), array("I"), array("I")

    def add(self, doc_id: int, text: bytes) -> None:
        counts = term_counts(text)
        if counts:
            names = self.names
            self.term.extend([names.setdefault(t, len(names)) for t in counts])
            self.tf.extend(counts.values())
            self.doc.extend([len(self.ids)] * len(counts))
            self.ids.append(doc_id)
            self.lengths.append(sum(counts.values()))
        self.size += len(text) + 64

    def rows(self, number: int) -> pa.RecordBatch:
        """The shard's own row, without a term: ids and lengths of its documents; then a row for each term."""
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        names = sorted(self.names)
        rank = np.empty(len(names), np.int64)
        rank[[self.names[t] for t in names]] = np.arange(len(names))
        term, doc, tf = rank[np.frombuffer(self.term, np.uint32)], place[np.frombuffer(self.doc, np.uint32)], np.frombuffer(self.tf, np.uint32).astype(np.int64)
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        data, ends = to_bytes(np.stack([gaps, tf], 1).ravel())
        offsets = np.r_[0, ends[2 * np.r_[starts[1:], len(term)] - 1]]
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
        head = np.stack([ids, lengths], 1)[order]
        df = np.diff(np.r_[starts, len(term)])
        one = lambda first, rest, kind: pa.concat_arrays([pa.array([first], kind), rest.cast(kind) if isinstance(rest, pa.Array) else pa.array(rest, kind)])
        columns = [pa.array([number] * (len(names) + 1), pa.int64()), one(None, pa.array(names, pa.binary()).cast(pa.string()), pa.string()), one(len(ids), df, pa.int64()), one(int(lengths.sum()), np.add.reduceat(tf, starts), pa.int64()), one(head.tobytes(), pa.nulls(len(names), pa.binary()), pa.binary()), one(None, lists, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, written to the shared folder: one row for each shard and term, and one for each shard.

    A term's row: df (documents that hold it), times (its occurrences), postings. A shard's row has no term: df counts its
    documents, times their terms, docs holds ids and lengths. Null, empty and
    other texts without terms are no documents, nor are rows without a key; repeated rows are documents each. A text is
    indexed as a whole, whatever its length. Other columns are not read; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(doc_id, data.as_buffer().to_pybytes())
                if now.size >= shard_bytes:
                    if now.ids:
                        yield now.rows(number)
                    number, now = number + 1, _Shard()
        if now.ids:
            yield now.rows(number)

    rows = docs.select(F.col(quoted(key)).cast("bigint").alias("key"), F.col(quoted(text)).cast("binary").alias("text")).where("key IS NOT NULL AND octet_length(text) > 0")
    folder = fresh_dir(spark, "lexical")
    rows.mapInArrow(shards, INDEX).write.parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times) of the queries' texts."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = term_counts(data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["item", "term", "times"])

    rows = queries.select(F.col(quoted(key)).cast("bigint").alias("item"), F.col(quoted(text)).cast("binary").alias("text")).where("item IS NOT NULL AND octet_length(text) > 0")
    return rows.mapInArrow(terms, "item bigint, term string, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))


def merge(lists: list[tuple[int, list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of a shard for one query: lists are (weight, places ascending, impacts, greatest impact).

    A score is the sum of weight x impact over the lists that hold the place. The heap's least score is what a place must
    exceed once there are k, as those that come later have larger ids.
    """
    lists = sorted(lists, key=lambda e: e[0] * e[3])
    bound = [0]
    for weight, _, _, most in lists:
        bound.append(bound[-1] + weight * most)
    best: list[tuple[int, int]] = []
    least, apart = 0, 0  # the lists before `apart` cannot reach the least score together
    at = [0] * len(lists)
    heap = [(places[0], i) for i, (_, places, _, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        place, score = heap[0][0], 0
        while heap and heap[0][0] == place:
            i = heap[0][1]
            if i < apart:
                heapq.heappop(heap)
                continue
            weight, places, impacts, _ = lists[i]
            score += weight * impacts[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapq.heapreplace(heap, (places[at[i]], i))
            else:
                heapq.heappop(heap)
        for i in range(apart - 1, -1, -1):
            if score + bound[i + 1] <= least:
                break
            weight, places, impacts, _ = lists[i]
            at[i] = p = bisect_left(places, place, at[i])
            if p < len(places) and places[p] == place:
                score += weight * impacts[p]
        if score > least:
            if len(best) < k:
                heapq.heappush(best, (score, -place))
            else:
                heapq.heapreplace(best, (score, -place))
            if len(best) == k:
                least = best[0][0]
                while apart < len(lists) and bound[apart + 1] <= least:
                    apart += 1
    return [(s, -p) for s, p in sorted(best, reverse=True)]


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """(key, rank, doc_key, score): the k best documents of the index for each query, by score, then id.

    Rows of one query's key are one query with all their terms, repeats included; rows without a key, and queries whose
    texts share no term with a document, give no rows. A document's score is the sum over the query's terms of
    w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and
    m = 25 + (75 * n * N) div L; only scores above 0 count. Rows of one document key rank each.
    """
    spark = index.sparkSession
    heads = index.where("term IS NULL").select("shard", F.lit(None).cast("binary").alias("postings"), "docs", "df", "times")
    n, total = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("times"), F.lit(0))).first()
    folder = fresh_dir(spark, "ranked")
    query_terms(queries, key, text).write.parquet(f"{folder}/asked")
    asked = spark.read.schema("item bigint, term string, times bigint").parquet(f"{folder}/asked")
    blocks = max(1, -(-asked.select("item").distinct().count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    lists = index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term").select("shard", "term", "df", "postings")
    lists.write.parquet(f"{folder}/lists")
    lists = spark.read.schema("shard bigint, term string, df bigint, postings binary").parquet(f"{folder}/lists")
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.sum("df") + 1)))
    weights = lists.groupBy("term").agg(weight.alias("weight")).where("weight > 0")
    asks = asked.join(weights, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item", (F.col("times") * F.col("weight")).alias("weight"))).alias("asks"))
    met = lists.join(asks, "term").select("shard", "block", "postings", "asks")
    whole = heads.join(met.select("shard", "block").distinct(), "shard")
    rows = met.unionByName(whole.select("shard", "block", "postings", "docs"), allowMissingColumns=True)

    def best(group: pa.Table) -> pa.Table:
        head = group.filter(pyarrow.compute.is_valid(group["docs"]))["docs"][0].as_buffer()
        ids, lengths = np.frombuffer(head, np.int64).reshape(-1, 2).T
        m = 25 + np.array([75 * int(x) * n // total for x in lengths.tolist()], np.int64)
        asked: dict[int, list] = {}
        for data, asks in zip(group["postings"], group["asks"].to_pylist(), strict=True):
            if asks is None:
                continue
            gaps, tf = from_bytes(data.as_buffer()).reshape(-1, 2).T
            places = np.cumsum(gaps)
            impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
            shared = places.tolist(), impacts.tolist(), int(impacts.max())
            for ask in asks:
                asked.setdefault(ask["item"], []).append((ask["weight"], *shared))
        found = [(item, int(ids[place]), score) for item, of in asked.items() for score, place in merge(of, k)]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["item", "doc", "score"])

    found = rows.groupBy("shard", "block").applyInArrow(best, "item bigint, doc bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(key), "rank", F.col("doc").alias(doc_key), "score")
