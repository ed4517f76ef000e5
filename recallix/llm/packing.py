"""Best-fit packing by minimum bin slack: pieces of documents into as few sequences of a fixed length as it can.

A bin takes the longest length left; a subset-sum over bitsets of the other available lengths then finds the fullest
feasible combination for the rest, which is removed. Only the number of pieces of each length matters for that, so the
search runs over a histogram of at most `capacity` lengths, and a combination is applied as often as the histogram
holds it. Pieces then find their places by their rank within their length, which is counted in salted blocks.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WORD_PIECE, PieceTable, encode_pieces, independent, slices
from .common import cut_lineage, free_names, quoted, short_batches, strings


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> PieceTable:
    encode = encode_pieces(path, fold=True)
    return PieceTable(lambda batch: [struct.pack(f"<{len(ids)}I", *ids) for ids in encode(batch)])


def text_ids(text: str, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text."""
    table = _ids(path)
    return b"".join([b"".join(table(independent(part, path, WORD_PIECE))) for part in slices(text)])


def cut_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece: df's columns but the text, with piece, start, length and ids (binary, little-endian uint32).

    A document's ids are its text's (null: none) and end_id. Only those longer than capacity are cut, into pieces of
    capacity ids, of which the last may be shorter. Repeated rows are cut alike; columns of df with the new names are
    replaced. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity

    @F.arrow_udf("array<binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in strings(batch):
                ids = text_ids(x, path) + end
                out.append([ids[i : i + wide] for i in range(0, len(ids), wide)])
            yield pa.array(out, pa.list_(pa.binary()))

    keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in {"piece", "start", "length", "ids", text.lower()}]
    cut = df.select(*keep, F.posexplode(run(F.col(quoted(text)))).alias("piece", "ids"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select(*keep, "piece", start.alias("start"), (F.octet_length("ids") / 4).cast("bigint").alias("length"), "ids")


def fullest(room: int, have: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The combination of the lengths at hand (longest first, with their numbers) that fills most of the room."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length, count in have:
        if length > room:
            continue
        left, step = min(count, room // length), 1
        while left:
            k = min(step, left)
            more = (reach | reach << (length * k)) & full
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            step *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            taken[length] = taken.get(length, 0) + k
    return list(taken.items())


def minimum_slack(lengths: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, combination of (length, number)) until nothing is left; the number of entries follows the
    number of distinct lengths, not the number of pieces."""
    left, plan = {k: v for k, v in lengths.items() if v > 0}, []
    while left:
        order = sorted(left, reverse=True)
        first = order[0]
        rest = [(k, left[k] - (k == first)) for k in order if left[k] - (k == first) > 0]
        combo = {first: 1}
        for k, n in fullest(capacity - first, rest):
            combo[k] = combo.get(k, 0) + n
        times = min(left[k] // n for k, n in combo.items())
        for k, n in combo.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, sorted(combo.items(), reverse=True)))
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on a bin run takes a length, where it stands, which bins."""
    used, bins, rows = {}, 0, []
    for times, combo in plan:
        at = 0
        for length, n in combo:
            rank = used.get(length, 0)
            rows.append((length, rank, bins, n, at))
            used[length] = rank + n * times
            at += n * length
        bins += times
    rows.sort()
    cols = np.array(rows, "int64").reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "number", "at"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), checkpoint: bool = True) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to capacity; offsets in a sequence are gapless from 0.

    The order columns fix ranks within a length; ties among them take any order, each row its own place. Rows of
    other lengths raise an error. An empty table gives an empty one; columns of those names are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    if checkpoint:
        pieces = cut_lineage(pieces)
    blocks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block, number, before, within, rank, place_ = free_names(pieces, "block", "n", "before", "within", "rank", "place")
    own = pieces.withColumn(block, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in order]), F.lit(blocks)))
    counts = own.groupBy("length", block).agg(F.count(F.lit(1)).alias(number))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(number).alias("n")).collect()}  # at most capacity rows
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    at = places(minimum_slack(histogram, capacity))
    earlier = F.sum(number).over(Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", block, F.coalesce(earlier, F.lit(0)).alias(before))
    nth_ = F.row_number().over(Window.partitionBy("length", block).orderBy(*[F.col(quoted(c)) for c in order]))
    ranked = own.withColumn(within, nth_).join(starts, ["length", block]).withColumn(rank, F.col(before) + F.col(within) - 1)
    shift = 1 << 48
    keys = at["length"] * shift + at["rank"]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(keys, n * shift + r, "right") - 1
        nth = r - at["rank"][i]
        return pa.StructArray.from_arrays([pa.array(at["bin"][i] + nth // at["number"][i]), pa.array(at["at"][i] + nth % at["number"][i] * n)], ["sequence_id", "offset"])

    placed = ranked.withColumn(place_, place(F.col("length"), F.col(rank)))
    return placed.select(*[F.col(quoted(c)) for c in pieces.columns], F.col(f"{place_}.sequence_id").alias("sequence_id"), F.col(f"{place_}.offset").alias("offset"))


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, length, pieces (key, piece, start, length, offset) and ids (array of
    int), in order of offsets; a sequence is bounded by the capacity. packed: what pack() gives for cut_pieces()' rows."""
    k = F.col(quoted(key)).alias(key)
    parts = F.array_sort(F.collect_list(F.struct("offset", k, "piece", "start", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("_parts"))

    @F.arrow_udf("array<int>")
    def whole(lists: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(v), "<u4").astype("int32") for v in lists.to_pylist()], pa.list_(pa.int32()))

    pieces = F.transform("_parts", lambda x: F.struct(x[key].alias(key), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset")))
    length = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return joined.select("sequence_id", length.alias("length"), pieces.alias("pieces"), whole(F.transform("_parts", lambda x: x["ids"])).alias("ids"))
