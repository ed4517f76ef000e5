"""Ranked retrieval for a batch of queries as one plan, and the feedback that its results give."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUSION, SCORING, SECTORS
from ..functions import dynamics, text, vectors
from .graph import expand
from .scope import created_between, of_project, of_user, salient
from .search import top_k


def fusion_weight(primary: Column, sector: Column) -> Column:
    """The weight of a sector's similarity, by whether it is the query's primary one."""
    return reduce(lambda c, s: c.when(sector == s, F.when(primary == s, FUSION[s][0]).otherwise(FUSION[s][1])), SECTORS[1:], F.when(sector == SECTORS[0], F.when(primary == SECTORS[0], FUSION[SECTORS[0]][0]).otherwise(FUSION[SECTORS[0]][1]))).otherwise(0.5)


def candidates(query_vectors: DataFrame, memory_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sector, similarity, rank): the 3k best memories of each query in each sector."""
    return top_k(memory_vectors, query_vectors, 3 * k)


def confidence(found: DataFrame) -> DataFrame:
    """Per query the mean of the eight best similarities of each sector, whether that is high, and how many rows to
    rank for k results."""
    top = found.where("rank <= 8").groupBy("query_id").agg(F.avg("similarity").alias("average"))
    return top.withColumn("confident", F.col("average") >= SCORING.confident)


def text_parts(pairs: DataFrame, queries: DataFrame, memories: DataFrame, keywords: bool, most: int = 1024) -> DataFrame:
    """(query_id, id, overlap, keyword) of pairs (query_id, id): what a query's text and a memory's share.

    A memory's whole text is taken apart once for all queries that ask for it, or once for each `most` of them.
    """
    asked = pairs.join(queries.select("query_id", F.col("text").alias("q_text")), "query_id")
    salted = asked.join(pairs.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / most).alias("_of")), "id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_of")))
    lists = salted.groupBy("id", "_part").agg(F.collect_list(F.struct("query_id", "q_text")).alias("asked"))

    @F.arrow_udf("array<struct<query_id:bigint,overlap:double,keyword:double>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, tuple] = {}
        for contents, all_asked in batches:
            out = []
            for content, who in zip(contents.to_pylist(), all_asked.to_pylist(), strict=True):
                tokens = text.canonical_list(content)
                own = ((content or "").lower(), Counter(tokens), len(tokens), text.keyword_set(tokens) if keywords else set())
                rows = []
                for w in who:
                    q = w["q_text"] or ""
                    if q not in known:
                        if len(known) > 10_000:
                            known.clear()
                        t = text.canonical_list(q)
                        known[q] = (q.strip(" ").lower(), t, text.keyword_set(t) if keywords else set())
                    overlap, keyword = text.text_scores(known[q], own)
                    rows.append({"query_id": w["query_id"], "overlap": overlap, "keyword": keyword if keywords else 0.0})
                out.append(rows)
            yield pa.array(out, pa.list_(pa.struct([("query_id", pa.int64()), ("overlap", pa.float64()), ("keyword", pa.float64())])))

    met = lists.join(memories.select("id", "content"), "id").select("id", F.explode(run.asNondeterministic()(F.col("content"), F.col("asked"))).alias("m"))
    return met.select("id", "m.query_id", "m.overlap", "m.keyword")


def scoped(memories: DataFrame, user: str | None = None, project: str | None = None, least_salience: float | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """What a query may see: the user's memories, in the project's scope, salient enough, made in the time given."""
    return memories.where(of_user(user) & of_project(project) & salient(least_salience) & created_between(since, until))


def retrieve(queries: DataFrame, query_vectors: DataFrame, memories: DataFrame, memory_vectors: DataFrame, now: int, k: int = 8, waypoints: DataFrame | None = None, project: str | None = None, keywords: bool = True, user: str | None = None, least_salience: float | None = None, since: int | None = None, until: int | None = None, sectors: list[str] | None = None) -> DataFrame:
    """The k best memories of each query with their scores, of those in scope.

    queries: query_id, text. query_vectors: query_id, sector, v. memories: id, content, sector, tags, user_id, project_id,
    salience, created_at, last_seen_at. memory_vectors: id, sector, v. waypoints: query_id, id, weight (from an expansion
    of the seeds of queries that are not confident), or none. The scope (user, project with global and unbound memories,
    least salience, time of creation) holds before anything is searched, the sectors are those searched. All queries see
    the same state. Ties go by id.
    """
    own = scoped(memories, user, project, least_salience, since, until)
    if any(x is not None for x in (user, project, least_salience, since, until)):
        memory_vectors = memory_vectors.join(own.select("id"), "id", "left_semi")
    if sectors:
        memory_vectors = memory_vectors.where(F.col("sector").isin(*sectors))
    c = text.classify(F.col("text"))
    q = queries.select("query_id", c.alias("c"), text.canonical_tokens(F.col("text")).alias("q_tokens")).select("query_id", "q_tokens", F.col("c.primary").alias("q_primary"), F.col("c.additional").alias("q_additional"))
    found = candidates(query_vectors, memory_vectors, k)
    sure = confidence(found)
    best = found.groupBy("query_id", "id").agg(F.max("similarity").alias("best"))
    if waypoints is not None:
        more = waypoints.join(sure.where("NOT confident").select("query_id"), "query_id").select("query_id", "id", "weight").join(own.select("id"), "id", "left_semi")
        best = best.join(more, ["query_id", "id"], "full_outer")
    else:
        best = best.withColumn("weight", F.lit(None).cast("double"))
    parts = text_parts(best.select("query_id", "id"), queries, own, keywords)
    # similarity over all sectors of a candidate
    pairs = best.select("query_id", "id").join(memory_vectors.select("id", F.col("sector").alias("s"), F.col("v").alias("mv")), "id")
    pairs = pairs.join(query_vectors.select("query_id", F.col("sector").alias("s"), F.col("v").alias("qv")), ["query_id", "s"]).join(q.select("query_id", "q_primary"), "query_id")
    w = fusion_weight(F.col("q_primary"), F.col("s"))
    fused = pairs.groupBy("query_id", "id").agg((F.sum(cosines(F.col("mv"), F.col("qv")) * w) / F.sum(w)).alias("fusion"))
    m = own.select("id", "sector", "tags", "project_id", "salience", "last_seen_at")
    rows = best.join(fused, ["query_id", "id"], "left").join(parts, ["query_id", "id"]).join(q, "query_id").join(m, "id").join(sure, "query_id", "left")
    resonant = F.coalesce("fusion", F.lit(0.0)) * vectors.resonance(F.col("sector"), F.col("q_primary"))
    similarity = F.greatest(resonant, F.coalesce("best", F.lit(0.0)))
    penalty = dynamics.sector_penalty(F.col("q_primary"), F.col("q_additional"), F.col("sector"))
    days = dynamics.days_between(F.col("last_seen_at"), F.lit(now))
    same = (F.col("project_id") == project) if project is not None else F.lit(False)
    expanded = waypoints is not None
    seed = F.when(F.col("best").isNotNull() & ~F.coalesce("confident", F.lit(False)), 1.0).otherwise(F.coalesce("weight", F.lit(0.0))) if expanded else F.lit(0.0)
    score = dynamics.hybrid_score(similarity * penalty, F.col("overlap"), seed, dynamics.recency(days), text.tag_score(F.col("tags"), F.col("q_tokens")), F.col("keyword"), F.coalesce(same, F.lit(False)))
    scored = rows.select("query_id", "id", "sector", "salience", days.alias("days"), F.coalesce("average", F.lit(0.0)).alias("average"), score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + F.ceil(SCORING.fanout * k * (1 - F.col("average"))))
    own_rows = Window.partitionBy("query_id")
    z = (F.col("score") - F.avg("score").over(own_rows)) / (F.stddev_pop("score").over(own_rows) + SCORING.epsilon)
    return kept.withColumn("z", z).where(F.col("rank") <= k).select("query_id", "id", "rank", "score", "z", dynamics.sector_decay(F.col("sector"), F.col("salience"), F.col("days")).alias("salience"))


def cosines(a: Column, b: Column) -> Column:
    """vectors.cosine() of many pairs, a batch at a time."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left))
        ln, rn = (np.array([x or 0 for x in c.value_lengths().to_pylist()], np.int64) for c in (left, right))
        x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (left, right))
        lo, ro = np.r_[0, np.cumsum(ln)], np.r_[0, np.cumsum(rn)]
        if len(ln) and (ln == ln[0]).all() and (rn == ln[0]).all():
            x, y = x.reshape(len(ln), -1), y.reshape(len(rn), -1)
            n = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            out = np.where(n > 0, (x * y).sum(1) / np.where(n > 0, n, 1), 0.0)
        else:
            for i in np.flatnonzero((ln == rn) & (ln > 0)):
                u, v = x[lo[i] : lo[i + 1]], y[ro[i] : ro[i + 1]]
                n = np.sqrt(u @ u) * np.sqrt(v @ v)
                out[i] = u @ v / n if n > 0 else 0.0
        return pa.array(out)

    return run(a, b)


def expand_seeds(seeds: DataFrame, edges: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """(query_id, id, weight, path): what each query's seeds (query_id, id) reach over the edges, seeds left out; at most
    `most` a query, in order of level, weight and id."""
    rows = expand(seeds, edges, rounds, by=("query_id",)).where(F.size("path") > 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.size("path"), F.desc("weight"), "id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def feedback(memories: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Memories after a batch of results: a moving mean of their z-scores, and salience by one trace per recall."""
    hit = results.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.avg("z").alias("_z"))
    j = memories.join(hit, "id", "left")
    left = F.pow(F.lit(1 - 0.18), F.coalesce("_n", F.lit(0)))
    grown = 1 - (1 - F.col("salience")) * left
    return j.withColumn("salience", F.when(F.col("_n") > 0, F.least(F.lit(1.0), grown)).otherwise(F.col("salience"))).withColumn("feedback_score", F.when(F.col("_n") > 0, 0.9 * F.coalesce("feedback_score", F.lit(0.0)) + 0.1 * F.col("_z")).otherwise(F.col("feedback_score"))).withColumn("last_seen_at", F.when(F.col("_n") > 0, F.lit(now)).otherwise(F.col("last_seen_at"))).drop("_n", "_z")


def coactivation_pairs(results: DataFrame, keep_query: bool = False) -> DataFrame:
    """Pairs of results of one query; at most k of them stand there, so pairs are bounded by k squared a query."""
    a, b = results.select("query_id", F.col("id").alias("src")), results.select("query_id", F.col("id").alias("dst"))
    pairs = a.join(b, "query_id").where("src < dst")
    return pairs if keep_query else pairs.select("src", "dst")


def unified(contextual: DataFrame, factual: DataFrame) -> DataFrame:
    """Both kinds of results in one table, scores with four digits."""
    left = contextual.select(F.lit("contextual").alias("kind"), "query_id", "id", F.round("score", 4).alias("score"))
    right = factual.select(F.lit("factual").alias("kind"), "subject", "predicate", "object", F.round("confidence", 4).alias("score"))
    return left.unionByName(right, allowMissingColumns=True)
