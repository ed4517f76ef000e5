"""Stateful processors: facts in any order of arrival, duplicates as they arrive, a queue of co-activations."""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DAY_MS
from ..functions.embedding import simhash
from ..storage import fresh_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that processors with several states need, for queries that start here."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


#: Lanes to which the keys of a history are dealt: a batch reads and writes the state of lanes, not of each key.
LANES = 1024

_START = itemgetter(0)


class FactHistory(StatefulProcessor):
    """Keeps the facts of a lane's keys in order of their starts, in parts of `width` ms, and gives the changed intervals of
    a batch: those of the new facts, and of the facts just before them."""

    def __init__(self, width: int = 30 * DAY_MS, late: int | None = None):
        self.width, self.late = width, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "parts array<bigint>")
        self.parts = handle.getMapState("parts", "part bigint", "users array<string>, subjects array<string>, predicates array<string>, starts array<bigint>, ids array<bigint>, objects array<string>")

    def _begin(self) -> None:
        found = self.numbers.get()
        self.order, self.held = sorted(found[0]) if found else [], {}
        self.known = set(self.order)

    def _load(self, part: int) -> dict[tuple, list]:
        """A part's facts by key, each key's in order of their starts."""
        if part not in self.held:
            rows = defaultdict(list)
            for *key, start, fact, obj in zip(*self.parts.getValue((part,)), strict=True) if part in self.known else ():
                rows[tuple(key)].append((start, fact, obj))
            self.held[part] = rows
        return self.held[part]

    def _put(self, part: int, rows: dict[tuple, list]) -> None:
        self.parts.updateValue((part,), tuple(list(c) for c in zip(*[(*k, *r) for k, rs in rows.items() for r in rs], strict=True)))

    def _beside(self, key: tuple, start: int, step: int) -> int | None:
        """The next start after, or (step -1) before, a start of a key."""
        at = bisect_left(self.order, start // self.width)
        while 0 <= at < len(self.order):
            if rows := self._load(self.order[at]).get(key):
                i = bisect_right(rows, start, key=_START) if step > 0 else bisect_left(rows, start, key=_START) - 1
                if 0 <= i < len(rows):
                    return rows[i][0]
            at += step
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._begin()
        changed, touched = set(), set()
        for batch in rows:  # all of them first: a fact leaves a batch of the stream once
            columns = [[x if isinstance(x, str) else None for x in batch[c]] for c in ("user_id", "subject", "predicate", "object")]
            for user, subject, predicate, obj, fact, start in zip(*columns, batch["id"].tolist(), batch["valid_from"].tolist(), strict=True):
                own, part = (user, subject, predicate), start // self.width
                if part not in self.known and part not in touched:
                    insort(self.order, part)
                insort(self._load(part)[own], (start, fact, obj), key=_START)
                touched.add(part)
                changed.add((own, start))
        changed |= {(own, s) for own, start in list(changed) if (s := self._beside(own, start, -1)) is not None}
        out = []
        for own, start in changed:
            after, facts = self._beside(own, start, 1), self._load(start // self.width)[own]
            same = facts[bisect_left(facts, start, key=_START) : bisect_right(facts, start, key=_START)]
            out += [(*own, fact, obj, start, None if after is None else after - 1) for _, fact, obj in same]
        for part in touched:
            self._put(part, self.held[part])
        self.numbers.update((self.order,))
        if self.late is not None and self.order:
            self.handle.registerTimer((self.order[-1] + 1) * self.width + self.late)
        frame = pd.DataFrame(out, columns=["user_id", "subject", "predicate", "id", "object", "valid_from", "valid_to"])
        yield frame.astype({"valid_to": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Facts of parts that end before the watermark less `late` go, but for a key's last part: it may still be closed."""
        self._begin()
        left, later = [], set()
        for part in reversed(self.order):
            rows = {k: r for k, r in self._load(part).items() if r}
            if (part + 1) * self.width <= timerValues.getCurrentWatermarkInMs() - self.late:
                kept = {k: r for k, r in rows.items() if k not in later}
                if not kept:
                    self.parts.removeKey((part,))
                    continue
                if len(kept) < len(rows):
                    self._put(part, kept)
                rows = kept
            later |= rows.keys()
            left.append(part)
        self.numbers.update((left[::-1],))
        return iter(())

    def close(self) -> None:
        pass


def fact_history(facts: DataFrame, width: int = 30 * DAY_MS, late: int | None = None, lanes: int = LANES) -> DataFrame:
    """Intervals of facts (user_id, subject, predicate, id, object, valid_from) in any order of arrival, in update mode:
    a fact leaves again, with another end, when one arrives that follows it; it ends just before the next later start.

    With late (ms) and a watermark on the stream, parts of a key's history that lie so far behind are forgotten, and later
    rows are dropped by the watermark; without, all of it is kept and any order gives the batch's result.
    """
    kind = "user_id string, subject string, predicate string, id bigint, object string, valid_from bigint, valid_to bigint"
    lane = F.pmod(F.xxhash64("user_id", "subject", "predicate"), F.lit(lanes)).cast("int")
    rows = facts.select(lane.alias("lane"), "user_id", "subject", "predicate", "id", "object", "valid_from", *(["ts"] if late is not None else []))
    return rows.groupBy("lane").transformWithStateInPandas(FactHistory(width, late), kind, "Update", "None" if late is None else "EventTime")


class Arrivals(StatefulProcessor):
    """One memory a hash: the first by time and id, how many arrived, and its salience with a boost for each."""

    def __init__(self, boost: float, keep_ms: int | None):
        self.boost, self.keep_ms = boost, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", "created_at bigint, id bigint, salience double, arrivals bigint, last_seen_at bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        first, arrivals, seen = (tuple(held[:3]), held[3], held[4]) if held else (None, 0, -(2**62))
        for batch in rows:
            order = batch.sort_values(["created_at", "id"])
            least = int(order["created_at"].iloc[0]), int(order["id"].iloc[0]), float(order["salience"].iloc[0])
            first = least if first is None or least[:2] < first[:2] else first
            arrivals, seen = arrivals + len(batch), max(seen, int(batch["created_at"].max()))
        self.state.update((*first, arrivals, seen))
        salience = min(1.0, first[2] + self.boost * (arrivals - 1))
        yield pd.DataFrame([(*key, first[1], arrivals, seen, salience)], columns=["simhash", "id", "arrivals", "last_seen_at", "salience"])

    def close(self) -> None:
        pass


def arrivals(memories: DataFrame, boost: float = 0.15, keep_ms: int | None = None, bare: str | None = None) -> DataFrame:
    """(simhash, id, arrivals, last_seen_at, salience) of memories (id, content, created_at, salience) in update mode: a
    hash leaves again with each batch that brings one of its memories. The first by time and id stands for all, in any
    order of arrival. keep_ms: how long a hash is remembered after its last arrival; by default for good. bare:
    the simhash of all texts without tokens, by default one each."""
    rows = memories.where("content IS NOT NULL").select(simhash(F.col("content"), bare).alias("simhash"), "id", "created_at", "salience")
    kind = "simhash string, id bigint, arrivals bigint, last_seen_at bigint, salience double"
    return rows.groupBy("simhash").transformWithStateInPandas(Arrivals(boost, keep_ms), kind, "Update", "None" if keep_ms is None else "ProcessingTime")


class Queue(StatefulProcessor):
    """Rows of a lane in order of arrival; a timer lets `most` of them go at each tick, and the others stay."""

    def __init__(self, most: int, tick_ms: int):
        self.most, self.tick = most, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "first bigint, next bigint")
        self.held = handle.getMapState("held", "number bigint", "src array<bigint>, dst array<bigint>, hours array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, end = self.ends.get() or (0, 0)
        waiting = first < end
        last = self.held.getValue((end - 1,)) if waiting else None
        for batch in rows:
            new = [batch[c].tolist() for c in ("src", "dst", "hours")]
            if last and len(last[0]) < self.most:  # the last entry is filled first
                end -= 1
                new = [list(a) + b for a, b in zip(last, new, strict=True)]
            for low in range(0, len(new[0]), self.most):
                last = tuple(c[low : low + self.most] for c in new)
                self.held.updateValue((end,), last)
                end += 1
        self.ends.update((first, end))
        if not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, end = self.ends.get() or (0, 0)
        if first < end:
            src, dst, hours = self.held.getValue((first,))
            self.held.removeKey((first,))
            self.ends.update((first + 1, end))
            if first + 1 < end:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick)
            yield pd.DataFrame({"src": src, "dst": dst, "hours": hours})

    def close(self) -> None:
        pass


def coactivation_queue(pairs: DataFrame, lanes: int = 16, most: int = 50, tick_ms: int = 1000) -> DataFrame:
    """(src, dst, hours) of pairs as they leave: those of one pair of memories share a lane, and a lane lets `most` go at
    each tick of the clock, in the order in which they came. Rows wait in the state, and survive a restart."""
    lane = F.pmod(F.xxhash64("src", "dst"), F.lit(lanes)).cast("int")
    rows = pairs.select(lane.alias("lane"), "src", "dst", F.col("hours").cast("double").alias("hours"))
    return rows.groupBy("lane").transformWithStateInPandas(Queue(most, tick_ms), "src bigint, dst bigint, hours double", "Append", "ProcessingTime")


def drained_queue(stream: DataFrame, rows: int, seconds: float = 3600.0) -> DataFrame:
    """Run a queue until so many rows have left, and give them; an error after so many seconds."""
    spark = stream.sparkSession
    out, left = fresh_dir(spark, "queue"), {}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:09d}")
        left[number] = spark.read.schema(stream.schema).parquet(f"{out}/{number:09d}").count()

    with rocks(spark):
        q = stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", fresh_dir(spark, "progress")).trigger(processingTime="500 milliseconds").start()
        until = time.monotonic() + seconds
        try:
            while sum(left.values()) < rows:
                if q.awaitTermination(0.2) or time.monotonic() > until:
                    raise TimeoutError(f"{sum(left.values())} of {rows} rows have left")
        finally:
            q.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an updating stream over all that is there; of each key the row of its last batch."""
    spark = stream.sparkSession
    out = fresh_dir(spark, "updates")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:09d}")  # again: the same

    with rocks(spark):
        w = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", fresh_dir(spark, "progress"))
        w.queryName(f"latest_{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("_batch", "integer")).option("recursiveFileLookup", "true").parquet(out)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_batch")
