"""Facts with validity intervals: loads, instants, ranges, timelines, differences."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_MS
from ..functions.dynamics import confidence_decay
from .scope import like, of_project, of_user, valid_at, valid_in
from .versions import Versions


class BadFact(ValueError):
    """A batch has a fact that cannot be inserted."""


#: What names a fact: its owner, subject and predicate.
KEY = ("user_id", "subject", "predicate")


def keys(rows: DataFrame) -> list[str]:
    """The columns of KEY that the rows have; without owners all facts are one's."""
    return [c for c in KEY if c in rows.columns]


def close_intervals(rows: DataFrame) -> DataFrame:
    """A history loaded in order: each row of a key ends just before the next later one begins; the last stays open."""
    later = Window.partitionBy(*keys(rows)).orderBy("valid_from").rangeBetween(1, Window.unboundedFollowing)
    return rows.withColumn("valid_to", F.min("valid_from").over(later) - 1)


def insert_facts(state: DataFrame, new: DataFrame) -> DataFrame:
    """New rows close open ones of their owner, subject and predicate that began before; late rows stay open beside
    them. A null owner is an owner of its own."""
    rows = state.withColumn("_start", F.lit(None).cast("bigint"))
    starts = new.select(*keys(state), F.col("valid_from").alias("_start")).distinct().withColumn("valid_from", F.col("_start"))
    later = Window.partitionBy(*keys(state)).orderBy("valid_from").rangeBetween(1, Window.unboundedFollowing)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("_new", F.col("_start").isNotNull()).withColumn("_next", F.min("_start").over(later))
    closed = both.where("NOT _new").withColumn("valid_to", F.coalesce("valid_to", F.col("_next") - 1)).select(state.columns)
    return closed.unionByName(close_intervals(new.drop("valid_to")).select(state.columns))


def checked(new: DataFrame) -> DataFrame:
    """Facts of a batch, which fails as a whole where one lacks subject, predicate or start, or has a confidence outside
    0 to 1."""
    bad = F.col("subject").isNull() | F.col("predicate").isNull() | F.col("valid_from").isNull() | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return new.withColumn("valid_from", F.when(bad, F.raise_error(F.concat(F.lit("bad fact: "), F.coalesce(F.col("id").cast("string"), F.lit("no id"))))).otherwise(F.col("valid_from")))


def insert_batch(tables: Versions, new: DataFrame, table: str = "facts") -> int:
    """Insert a batch of facts in one step: all of them, or none where one is bad (BadFact) or a task fails. Stages that
    meet bad facts at the same time fail in Spark with an error that it does not name, so that the message decides."""
    try:
        return tables.transact(lambda read: {table: insert_facts(read(table), checked(new))})
    except (PySparkException, Py4JJavaError) as e:
        if found := re.search(r"bad fact: (?:-?\d+|no id)", str(e)):
            raise BadFact(found[0]) from e
        raise


def by_id(facts: DataFrame, ids: DataFrame, user: str, project: str | None = None) -> DataFrame:
    """Facts of the given ids as far as they are the user's, and in the project's scope."""
    return facts.join(ids.select("id").distinct(), "id", "left_semi").where(of_user(user) & of_project(project))


def insert_edges(state: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are added open."""
    return state.unionByName(new.withColumn("edge_to", F.lit(None).cast("bigint")).select(state.columns))


def invalidate_edges(state: DataFrame, ids: DataFrame, at: int, key: tuple[str, str] = ("source_id", "target_id")) -> DataFrame:
    marked = ids.select(*key).distinct().withColumn("_hit", F.lit(True))
    return state.join(marked, list(key), "left").withColumn("edge_to", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("edge_to"))).select(state.columns)


def invalidate(state: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Close the rows of the given ids at an instant."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return state.join(marked, "id", "left").withColumn("valid_to", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("valid_to"))).select(state.columns)


def update(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Confidence and object from changes (id, confidence, object) where they are given."""
    c = changes.select("id", F.col("confidence").alias("_c"), F.col("object").alias("_o"))
    return state.join(c, "id", "left").withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("object", F.coalesce("_o", "object")).select(state.columns)


def delete(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("id"), "id", "left_anti")


def at_time(facts: DataFrame, at: int, least: float = 0.1, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    rows = facts.where(valid_at(at) & (F.col("confidence") >= least))
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object_)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def current(facts: DataFrame) -> DataFrame:
    """The newest open fact of each owner, subject and predicate."""
    newest = F.max_by(F.struct("id", "object", "valid_from", "confidence"), F.struct("valid_from", "id"))
    by = keys(facts)
    return facts.where("valid_to IS NULL").groupBy(*by).agg(newest.alias("f")).select(*by, "f.*")


def by_subject(facts: DataFrame, historical: bool = False) -> DataFrame:
    """Each owner's facts about a subject with their position: open ones by predicate and start, or all by start."""
    rows = facts if historical else facts.where("valid_to IS NULL")
    order = [F.desc("valid_from"), "id"] if historical else ["predicate", F.desc("valid_from"), "id"]
    own = Window.partitionBy(*[c for c in keys(facts) if c != "predicate"]).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(own).cast("bigint"))


def in_range(facts: DataFrame, low: int | None, high: int | None) -> DataFrame:
    return facts.where(valid_in(low, high))


def conflicts(facts: DataFrame) -> DataFrame:
    """Facts that overlap one of the same owner, subject and predicate with another object; no pairs are listed.

    Rows in order of their start know the farthest end before them and whose object has it, and the farthest end of any
    other object: the loser of each meeting of two objects. Later rows of another object begin with the next change.
    """
    order = Window.partitionBy(*keys(facts)).orderBy("valid_from", "id")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce("valid_to", F.lit(2**62))
    same = F.col("_best.object").eqNullSafe(F.col("object"))
    rows = facts.withColumn("_best", F.max(F.struct(end.alias("end"), F.col("object").alias("object"))).over(before))
    rows = rows.withColumn("_lost", F.when(F.col("_best").isNotNull() & ~same, F.least(end, F.col("_best.end"))))
    rows = rows.withColumn("_other", F.when(~same, F.col("_best.end")).otherwise(F.max("_lost").over(before)))
    rows = rows.withColumn("_change", F.when(~F.lag("object").over(order).eqNullSafe(F.col("object")), F.col("valid_from")))
    hit = (F.col("_best").isNotNull() & (F.col("_other") >= F.col("valid_from"))) | (F.min("_change").over(after) <= end)
    return rows.withColumn("_hit", hit).where("_hit").select(facts.columns)


def conflicts_at(facts: DataFrame, at: int) -> DataFrame:
    """Owners, subjects and predicates with more than one fact at an instant."""
    return facts.where(valid_at(at)).groupBy(*keys(facts)).agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("object").alias("n_objects")).where("n_facts > 1")


def search(facts: DataFrame, part: str, field: str = "subject", limit: int | None = 100) -> DataFrame:
    rows = facts.where(like(field, part)).orderBy(F.desc("confidence"), F.desc("valid_from"), "id")
    return rows.limit(limit) if limit else rows


def related(edges: DataFrame, facts: DataFrame, at: int, user: str | None = None) -> DataFrame:
    """Targets of edges that hold at the instant, valid then themselves, with the edge's weight. Both ends have one owner;
    with a user only that one's are given."""
    own = facts.where(of_user(user))
    source = own.select(F.col("id").alias("source_id"), F.col("subject").alias("source_subject"), F.col("user_id").alias("_owner"))
    target = own.where(valid_at(at)).select(F.col("id").alias("target_id"), "user_id", "subject", "predicate", "object", "confidence")
    valid = edges.where((F.col("edge_from") <= at) & (F.col("edge_to").isNull() | (F.col("edge_to") >= at)))
    return valid.join(source, "source_id").join(target, "target_id").where(F.col("_owner").eqNullSafe(F.col("user_id"))).drop("_owner")


def timeline(facts: DataFrame) -> DataFrame:
    """A created event per fact and an invalidated one per closed fact."""
    made = F.struct(F.lit("created").alias("change"), F.col("valid_from").alias("at_ms"))
    ended = F.struct(F.lit("invalidated").alias("change"), F.col("valid_to").alias("at_ms"))
    events = F.when(F.col("valid_to").isNotNull(), F.array(made, ended)).otherwise(F.array(made))
    names = ["id", *keys(facts), "object", "confidence"]
    return facts.select(*names, F.explode(events).alias("e")).select(*names, "e.change", "e.at_ms")


def changes_between(facts: DataFrame, low: int, high: int) -> DataFrame:
    return timeline(facts.where((F.col("valid_from").between(low, high)) | F.col("valid_to").between(low, high))).where(F.col("at_ms").between(low, high))


def compare(facts: DataFrame, one: int, two: int) -> DataFrame:
    """Added, removed, changed and unchanged between two instants, by owner, subject and predicate; the latest row
    speaks."""
    by = keys(facts)

    def side(at: int, name: str) -> DataFrame:
        last = F.max_by("object", F.struct("valid_from", "id"))
        return facts.where(valid_at(at)).groupBy(*by).agg(last.alias(name))

    left, right = side(one, "before"), side(two, "after").select(*[F.col(c).alias(f"_{c}") for c in by], "after")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    both = left.join(right, same, "full_outer").select(*[F.coalesce(c, f"_{c}").alias(c) for c in by], "before", "after")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return both.withColumn("change", kind)


def change_frequency(facts: DataFrame, now: int, window_days: int) -> DataFrame:
    """Changes of each owner, subject and predicate in the window, mean days until closed, and changes a day."""
    own = facts.where(F.col("valid_from") >= now - window_days * DAY_MS)
    return own.groupBy(*keys(facts)).agg(F.count(F.lit(1)).alias("changes"), (F.avg(F.col("valid_to") - F.col("valid_from")) / DAY_MS).alias("mean_days"), (F.count(F.lit(1)) / window_days).alias("per_day"))


def volatile(facts: DataFrame, limit: int | None = 10) -> DataFrame:
    by = keys(facts)
    rows = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("changes"), F.avg("confidence").alias("confidence")).where("changes > 1").orderBy(F.desc("changes"), F.asc("confidence"), *by)
    return rows.limit(limit) if limit else rows


def counts(facts: DataFrame) -> DataFrame:
    n, active = F.count(F.lit(1)), F.count_if(F.col("valid_to").isNull())
    return facts.agg(n.alias("total"), active.alias("active"), (n - active).alias("historical"), F.when(n > 0, active * 100.0 / n).otherwise(0.0).alias("active_percent"))


def decay_confidence(facts: DataFrame, now: int, rate: float = 0.01) -> DataFrame:
    """Open facts above 0.1 lose confidence by their age in days, down to 0.1."""
    age = (F.lit(now) - F.col("valid_from")) / DAY_MS
    open_ = F.col("valid_to").isNull() & (F.col("confidence") > 0.1)
    return facts.withColumn("confidence", F.when(open_, confidence_decay(F.col("confidence"), rate, age)).otherwise(F.col("confidence")))
