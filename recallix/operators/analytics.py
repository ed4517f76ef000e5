"""Aggregates over memories, sessions and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_MS, SECTORS
from ..functions.dynamics import sector_rate


def sector_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.avg("salience").alias("mean_salience"))


def overview(rows: DataFrame, now: int) -> DataFrame:
    """Totals, the last day's, salience, and a count for each sector, in one pass."""
    by = [F.count_if(F.col("sector") == s).alias(f"n_{s}") for s in SECTORS]
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("created_at") >= now - DAY_MS).alias("last_day"), F.avg("salience").alias("mean_salience"), F.min("salience").alias("least_salience"), F.max("salience").alias("most_salience"), F.avg(sector_rate(F.col("sector"))).alias("mean_rate"), *by)


def sector_timeline(rows: DataFrame, pattern: str) -> DataFrame:
    label = F.date_format(F.timestamp_millis("created_at"), pattern)
    return rows.groupBy("sector", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def maintenance(operations: DataFrame, kinds: list[str]) -> DataFrame:
    """Operations by hour as columns, with the share of the first kind in percent."""
    hour = F.date_format(F.col("ts"), "yyyy-MM-dd HH:00")
    wide = operations.groupBy(hour.alias("hour")).pivot("type", kinds).agg(F.sum("n"))
    filled = wide.select("hour", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return filled.withColumn("share", F.when(total > 0, F.round(F.col(kinds[0]) * 100.0 / total, 4)).otherwise(0.0))


def rate_windows(events: DataFrame, width: str, history: int = 5) -> DataFrame:
    """Events of each tumbling window that has any, with the mean of the last few windows."""
    w = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    # a day is one range of the sort, so that the mean runs in many tasks; it begins anew each day
    day = Window.partitionBy(F.to_date("start")).orderBy("start").rowsBetween(-(history - 1), 0)
    return w.withColumn("mean_n", F.avg("n").over(day))


def session_statistics(events: DataFrame, kinds: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), *counts)


def user_summary(rows: DataFrame, recent: int = 100, by_name: bool = False) -> DataFrame:
    """Each user's last memories: number, distinct projects and languages in order of first appearance, or of their
    names; null where there is none."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    last = rows.withColumn("_r", rank).where(F.col("_r") <= recent)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "project_id", "language"))), lambda x: x)
    g = last.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("l"), F.max("created_at").alias("last_active"))

    def names(f: str) -> Column:
        found = F.array_distinct(F.filter(F.transform("l", lambda x: x[f]), lambda x: x.isNotNull()))
        return F.when(F.size(found) > 0, F.array_join(F.array_sort(found) if by_name else found, ", "))

    return g.select("user_id", "n", names("project_id").alias("projects"), names("language").alias("languages"), "last_active")


def sector_balance(rows: DataFrame) -> DataFrame:
    """Count and share by sector, whether it is the largest, and the balance of all: 1 less the mean distance of the
    shares from equal ones."""
    n = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row a sector
    share = F.col("n") / F.sum("n").over(every)
    out = n.select("sector", "n", share.alias("share"), (F.col("n") == F.max("n").over(every)).alias("dominant"))
    away = out.withColumn("_away", F.abs(F.col("share") - 1 / F.count(F.lit(1)).over(every)))
    return away.withColumn("balance", 1 - F.avg("_away").over(every)).drop("_away")


def fresh(age_days: F.Column) -> F.Column:
    """1 for what was just seen, falling to 0 in 180 days."""
    return F.greatest(F.lit(0.0), 1 - age_days / 180)


def freshness(rows: DataFrame, now: int) -> DataFrame:
    """By sector, and for all (sector null): freshness and memories not seen for 90 days. A sector's freshness is over all
    its rows, that of all over those with a time."""
    age = (F.lit(now) - F.col("last_seen_at")) / DAY_MS
    total, seen, stale = F.coalesce(F.sum(fresh(age)), F.lit(0.0)), F.count("last_seen_at"), F.count_if(age > 90).alias("stale")
    by = rows.groupBy("sector").agg((total / F.count(F.lit(1))).alias("freshness"), stale)
    return by.unionByName(rows.agg(F.when(seen > 0, total / seen).otherwise(0.0).alias("freshness"), stale).withColumn("sector", F.lit(None).cast("string")))


def temporal_patterns(rows: DataFrame, now: int) -> DataFrame:
    age = (F.lit(now) - F.col("created_at")) / DAY_MS
    return rows.agg(F.min(age).alias("newest"), F.max(age).alias("oldest"), F.avg(age).alias("mean_age"), (F.count_if(age <= 7) / F.count(F.lit(1))).alias("recent_share"))


def health(rows: DataFrame, now: int) -> DataFrame:
    """A score of 1, times a penalty for each thing that is wrong: few rows, imbalance, staleness, low activity, low
    salience; and its parts."""
    seen = (F.lit(now) - F.col("last_seen_at")) / DAY_MS
    born = (F.lit(now) - F.col("created_at")) / DAY_MS
    by = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum(fresh(seen)).alias("f"), F.count("last_seen_at").alias("s"), F.count_if(born <= 7).alias("r"), F.sum("salience").alias("v"))
    every = by.agg(F.collect_list("n").alias("ns"), F.sum("n").alias("total"), F.sum("f").alias("f"), F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("v").alias("v"))  # a number a sector
    balance = 1 - F.aggregate("ns", F.lit(0.0), lambda a, x: a + F.abs(x / F.col("total") - 1 / F.size("ns"))) / F.size("ns")
    parts = every.select(F.coalesce("total", F.lit(0)).alias("total"), balance.alias("balance"), (F.col("f") / F.col("s")).alias("fresh"), (F.col("r") / F.col("total")).alias("recent"), (F.col("v") / F.col("total")).alias("salience"))
    off = lambda bad, x: F.when(bad, x).otherwise(1.0)
    score = off(F.col("total") < 10, 0.7) * off(F.col("balance") < 0.5, 0.9) * off(F.coalesce("fresh", F.lit(0.0)) < 0.3, 0.8) * off(F.col("recent") < 0.2, 0.9) * off(F.col("salience") < 0.3, 0.85)
    return parts.select("total", "balance", "fresh", "recent", "salience", F.when(F.col("total") == 0, 0.0).otherwise(score).alias("score"))


def distinct_projects(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("project_id").isNotNull() & (F.col("project_id") != "system_global")).select("project_id").distinct()


def standardized(rows: DataFrame, by: str, value: str, epsilon: float = 1e-8) -> DataFrame:
    """Value less the group's mean over its population deviation."""
    own = rows.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    return rows.join(own, by).withColumn("z", (F.col(value) - F.col("_mean")) / (F.col("_dev") + epsilon)).drop("_mean", "_dev")


def budgeted(rows: DataFrame, by: str, order: list, size: str, most: int) -> DataFrame:
    """The rows of each group in order, as long as their sizes together stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= most)


def token_weights(rows: DataFrame, tokens: str = "tokens", key: str = "id") -> DataFrame:
    """(key, term, weight): term frequency times ln((N+1)/(df+1))."""
    n = rows.agg(F.count(F.lit(1)).alias("N"))
    terms = rows.select(key, F.size(tokens).alias("length"), F.explode(tokens).alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") / F.col("length") * F.log((F.col("N") + 1) / (F.col("df") + 1))).alias("weight"))  # one row of N


def reflections(rows: DataFrame, groups: DataFrame, now: int, least: int = 2) -> DataFrame:
    """Groups of similar memories: size, and salience from size and how lately they were made."""
    j = rows.join(groups, "id").groupBy("seed", "sector").agg(F.count(F.lit(1)).alias("n"), F.avg(F.exp(-(F.lit(now) - F.col("created_at")) / (DAY_MS / 2))).alias("recent")).where(F.col("n") >= least)
    return j.select("seed", "sector", "n", F.least(F.lit(1.0), 0.6 * F.col("n") / 10 + 0.3 * F.col("recent") + F.when(F.col("sector") == "emotional", 0.1).otherwise(0.0)).alias("salience"))


def reflected(memories: DataFrame, groups: DataFrame, now: int, least: int = 2, grow: float = 1.1) -> DataFrame:
    """Memories after a reflection job: members of groups (id, seed) of two or more are marked as consolidated, a tenth
    more salient, up to 1, and just updated."""
    size = groups.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    hit = memories.join(groups.join(size, "seed", "left_semi").select("id", F.lit(True).alias("_hit")), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    out = hit.withColumn("consolidated", F.col("_hit")).withColumn("salience", F.when(F.col("_hit"), F.least(F.lit(1.0), F.col("salience") * grow)).otherwise(F.col("salience")))
    return out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("created_at"))).drop("_hit")


def newest(memories: DataFrame, most: int = 100, least: int = 20) -> DataFrame:
    """What a reflection job of each owner looks at: the newest memories, none where there are fewer than `least`."""
    own = Window.partitionBy("user_id")
    place = F.row_number().over(own.orderBy(F.desc("created_at"), "id"))
    rows = memories.withColumn("_p", place).where(F.col("_p") <= most)
    return rows.withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") >= least).drop("_p", "_n")


def error_rates(events: DataFrame, width: str) -> DataFrame:
    """(hour, n, failed, error_rate in percent, one digit) of each window that has events; failed says which went wrong."""
    w = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    return w.select(F.col("w.start").alias("hour"), "n", "failed", F.round(100.0 * F.col("failed") / F.col("n"), 1).alias("error_rate"))
