"""Point reads, lists and writes of the state tables; every write is a function from state and change to state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import insert_missing, page, upsert
from .scope import GLOBAL, of_project, of_user


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the given ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def best_by(rows: DataFrame, wanted: DataFrame, name: str, order: str = "salience") -> DataFrame:
    """For each wanted value of a column the row that has most of `order`, the smallest id on ties."""
    own = rows.join(wanted.select(name).distinct(), name, "left_semi")
    best = F.max_by(F.struct(*[c for c in rows.columns if c != name]), F.struct(F.col(order), -F.col("id")))
    return own.groupBy(name).agg(best.alias("_b")).select(name, "_b.*")


def of_segments(rows: DataFrame, *segments: int) -> DataFrame:
    return rows.where(F.col("segment").isin(*segments)).orderBy("segment", F.desc("created_at"), "id")


def last_segment(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max("segment"), F.lit(0)).alias("segment"))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Out-edges of the given ids with their place by weight."""
    own = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")).cast("bigint"))


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def logs(log: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Entries of a status; with a limit the newest."""
    rows = log.where(F.col("status") == status)
    return rows.orderBy(F.desc("ts"), "id").limit(limit) if limit else rows


def vectors_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, sectors, dims): what vectors the given memories have, in order of sectors; five at most."""
    own = by_ids(vectors, ids)
    listed = F.array_sort(F.collect_list(F.struct("sector", F.size("v").alias("dim"), "v")))
    g = own.groupBy("id").agg(listed.alias("l"))
    return g.select("id", F.transform("l", lambda x: x["sector"]).alias("sectors"), F.transform("l", lambda x: x["dim"]).alias("dims"), F.transform("l", lambda x: x["v"]).alias("vectors"))


def listed(rows: DataFrame, limit: int, offset: int = 0, user: str | None = None, sector: str | None = None) -> DataFrame:
    """A page of a user's memories, of which the sector's are shown: the page is taken first."""
    got = page(rows.where(of_user(user)), limit, offset)
    return got if sector is None else got.where(F.col("sector") == sector)


def scoped_list(rows: DataFrame, limit: int, user: str | None = None, project: str | None = None) -> DataFrame:
    """The last seen of what a user has in a project's scope."""
    return page(rows.where(of_user(user) & of_project(project)), limit, order="last_seen_at")


def ensure_users(users: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Users that are not there yet, with an empty profile."""
    fresh = new.select("user_id").where("user_id IS NOT NULL").select("user_id", F.lit("User profile initializing...").alias("summary"), F.lit(0).alias("reflection_count"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return insert_missing(users, fresh.select(users.columns), "user_id")


def set_summaries(users: DataFrame, summaries: DataFrame, now: int) -> DataFrame:
    """New summaries (user_id, summary); each counts one reflection more."""
    s = summaries.select("user_id", F.col("summary").alias("_s"))
    j = users.join(s, "user_id", "left")
    hit = F.col("_s").isNotNull()
    return j.withColumn("summary", F.coalesce("_s", "summary")).withColumn("reflection_count", F.col("reflection_count") + hit.cast("int")).withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))).select(users.columns)


def log_started(log: DataFrame, ids: DataFrame, model: str, now: int) -> DataFrame:
    """Entries of the ids as pending, in place of older ones."""
    new = ids.select("id", F.lit(model).alias("model"), F.lit("pending").alias("status"), F.lit(now).alias("ts"), F.lit(None).cast("string").alias("err"))
    return upsert(log, new.select(log.columns), ("id",), "ts")


def log_ended(log: DataFrame, results: DataFrame) -> DataFrame:
    """Status and error of entries from results (id, status, err)."""
    r = results.select("id", F.col("status").alias("_s"), F.col("err").alias("_e"))
    j = log.join(r, "id", "left")
    return j.withColumn("err", F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col("err"))).withColumn("status", F.coalesce("_s", "status")).select(log.columns)


def wiped(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows."""
    return [t.where(F.lit(False)) for t in tables]


def logged(stats: DataFrame, counts: DataFrame, now: int) -> DataFrame:
    """Maintenance counts (type, count) added to the statistics; zeros are not."""
    new = counts.where("count > 0").select("type", F.col("count").cast("bigint").alias("count"), F.lit(now).alias("ts"))
    return stats.unionByName(new.select(stats.columns))


def stored(rows: DataFrame, project: str | None = None, everywhere: bool = False) -> DataFrame:
    """Rows bound to a project, or to all of them."""
    return rows.withColumn("project_id", F.lit(GLOBAL if everywhere else project).cast("string"))


def invalid(rows: DataFrame, required: tuple[str, ...] = (), lengths: dict[str, int] | None = None, ranges: dict[str, tuple[float, float]] | None = None, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with `errors`: the names of what is missing, too long, out of range or not of the kinds, in order of names."""
    found = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"{c}: required")) for c in required]
    found += [F.when(F.length(c) > n, F.lit(f"{c}: too long")) for c, n in (lengths or {}).items()]
    found += [F.when(~F.col(c).between(a, b), F.lit(f"{c}: out of range")) for c, (a, b) in (ranges or {}).items()]
    found += [F.when(~F.col(c).isin(*k), F.lit(f"{c}: unknown")) for c, k in (kinds or {}).items()]
    return rows.withColumn("errors", F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())))
