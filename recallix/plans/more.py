"""More named queries: reads and writes of the state tables, vectors, decay, nodes and the dashboard's text analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DAY_MS, RESONANCE, SECTORS
from ..functions import analysis, dynamics, passages, providers, reading, text, vectors
from ..operators import adding, analytics, graph, insight, memory, nodes, retrieval, scope, search, state
from ..operators.versions import Versions
from ..storage import fresh_dir
from . import derive
from .derive import CUES_SQL, GRAPH_SQL, MEMORIES_SQL, NOW_MS, VECTORS_SQL
from .queries import A0, AT, COSINE, LAMBDA, SEEN, _r, _round, _seen, query

# state: point reads and lists


@query("SELECT id, user_id, salience FROM memories WHERE id % 20 = 0", ctes=MEMORIES_SQL)
def mem_get(spark, d):
    m = derive.memories(spark, d)
    return state.by_ids(m, m.where("id % 20 = 0").select("id")).select("id", "user_id", "salience")


KEYED = "keyed AS (SELECT *, substring(md5(content), 1, 16) AS simhash FROM memories)"


@query("SELECT simhash, id, salience FROM keyed WHERE simhash IN (SELECT simhash FROM keyed WHERE id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY simhash ORDER BY salience DESC, id) = 1", ctes=f"{MEMORIES_SQL}, {KEYED}")
def mem_by_content_hash(spark, d):
    """The most salient memory of each asked hash."""
    m = derive.memories(spark, d).select("id", "salience", text.text_key(F.col("content")).alias("simhash"))
    return state.best_by(m, m.where("id % 20 = 0"), "simhash").select("simhash", "id", "salience")


@query("SELECT id, id // 100 AS segment, created_at FROM memories WHERE id // 100 IN (0, 1)", ctes=MEMORIES_SQL)
def mem_of_segments(spark, d):
    m = memory.with_segments(derive.memories(spark, d).drop("segment"), 100)
    return state.of_segments(m, 0, 1).select("id", F.col("segment").cast("bigint").alias("segment"), "created_at")


@query("SELECT coalesce(max(id // 100), 0) AS segment FROM memories", ctes=MEMORIES_SQL)
def mem_last_segment(spark, d):
    return state.last_segment(memory.with_segments(derive.memories(spark, d).select("id"), 100)).select(F.col("segment").cast("bigint").alias("segment"))


@query("SELECT src, dst, round(weight, 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM graph WHERE src % 20 = 0", ctes=GRAPH_SQL)
def waypoint_neighbours(spark, d):
    e = derive.graph_edges(spark, d)
    return state.neighbours(e, e.where("src % 20 = 0").select(F.col("src").alias("id"))).select("src", "dst", _r(F.col("weight")).alias("weight"), "place")


@query("SELECT src, dst, round(weight, 6) AS weight FROM graph WHERE dst = src + 1", ctes=GRAPH_SQL)
def waypoint_lookup(spark, d):
    e = derive.graph_edges(spark, d)
    return state.edges_between(e, e.select("src", (F.col("src") + 1).alias("dst"))).select("src", "dst", _r(F.col("weight")).alias("weight"))


def _log(spark, d):
    i = F.col("doc_id")
    status = F.when(i % 7 == 0, "failed").when(i % 3 == 0, "pending").otherwise("completed")
    return derive.table(spark, d, "documents").select(i.alias("id"), F.lit("multi-sector").alias("model"), status.alias("status"), (F.lit(AT) + i * 1000).alias("ts"), F.when(i % 7 == 0, "timeout").alias("err"))


LOG_SQL = f"log AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status, {AT} + doc_id * 1000 AS ts, CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS err FROM documents)"


@query("SELECT id, status, ts FROM log WHERE status = 'pending' UNION ALL (SELECT id, status, ts FROM log WHERE status = 'failed' ORDER BY ts DESC, id LIMIT 100)", ctes=LOG_SQL)
def logs_by_status(spark, d):
    log = _log(spark, d)
    return state.logs(log, "pending").unionByName(state.logs(log, "failed", 100)).select("id", "status", "ts")


@query(f"SELECT id, CASE WHEN id % 14 = 0 THEN 'pending' WHEN id % 5 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 14 = 0 THEN {NOW_MS} ELSE ts END AS ts, CASE WHEN id % 14 = 0 OR id % 5 = 0 THEN NULL ELSE err END AS err FROM log", ctes=LOG_SQL)
def log_writes(spark, d):
    """Every fifth entry ends well; of every fourteenth a new one begins."""
    log = _log(spark, d)
    ended = state.log_ended(log, log.where("id % 5 = 0").select("id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("err")))
    return state.log_started(ended, log.where("id % 14 = 0"), "multi-sector", NOW_MS).select("id", "status", "ts", "err")


def _users(spark, d):
    return spark.createDataFrame([(f"u{i}", "old", i, AT, AT) for i in range(5)], "user_id string, summary string, reflection_count int, created_at long, updated_at long")


@query(f"SELECT user_id, CASE WHEN n < 5 THEN 'old' ELSE 'User profile initializing...' END AS summary, CAST(CASE WHEN n < 5 THEN n ELSE 0 END AS INTEGER) AS reflection_count, CASE WHEN n < 5 THEN {AT} ELSE {NOW_MS} END AS created_at FROM (SELECT DISTINCT user_id, CAST(substring(user_id, 2) AS INTEGER) AS n FROM memories)", ctes=MEMORIES_SQL)
def users_ensure(spark, d):
    return state.ensure_users(_users(spark, d), derive.memories(spark, d), NOW_MS).select("user_id", "summary", "reflection_count", "created_at")


@query(f"SELECT 'u' || n AS user_id, CASE WHEN n < 3 THEN c || ' memories' ELSE 'old' END AS summary, CAST(n + CASE WHEN n < 3 THEN 1 ELSE 0 END AS INTEGER) AS reflection_count, CASE WHEN n < 3 THEN {NOW_MS} ELSE {AT} END AS updated_at FROM range(5) r(n) LEFT JOIN (SELECT user_id, count(*) AS c FROM memories GROUP BY 1) m ON m.user_id = 'u' || n", ctes=MEMORIES_SQL)
def users_summaries(spark, d):
    s = derive.memories(spark, d).where("user_id < 'u3'").groupBy("user_id").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" memories")).alias("summary"))
    return state.set_summaries(_users(spark, d), s, NOW_MS).select("user_id", "summary", "reflection_count", "updated_at")


@query("SELECT user_id, count(*) AS n, max(created_at) AS latest FROM memories WHERE user_id IN ('u1', 'u4') GROUP BY 1", ctes=MEMORIES_SQL)
def user_get(spark, d):
    return derive.memories(spark, d).where(scope.of_user("u1") | scope.of_user("u4")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))


@query("SELECT id, sector, vec_id FROM vectors WHERE id % 20 = 0 AND sector = 'semantic'", ctes=VECTORS_SQL)
def vec_get(spark, d):
    v = derive.vectors(spark, d)
    return state.by_ids(v, v.where("id % 20 = 0").select("id")).where("sector = 'semantic'").select("id", "sector", "vec_id")


@query("SELECT id, list(sector ORDER BY sector) AS sectors, list(CAST(len(v) AS INTEGER) ORDER BY sector) AS dims FROM vectors WHERE id % 20 = 0 GROUP BY id", ctes=VECTORS_SQL)
def vec_of_memories(spark, d):
    v = derive.vectors(spark, d)
    return state.vectors_of(v, v.where("id % 20 = 0").select("id")).select("id", "sectors", "dims")


@query("SELECT id, vec_id, len(v) AS dim FROM vectors WHERE sector = 'emotional'", ctes=VECTORS_SQL)
def vec_of_sector(spark, d):
    return derive.vectors(spark, d).where("sector = 'emotional'").select("id", "vec_id", F.size("v").cast("bigint").alias("dim"))


@query("SELECT id, sector FROM (SELECT * FROM memories WHERE user_id = 'u3' ORDER BY created_at DESC, id LIMIT 60 OFFSET 5) WHERE sector = 'emotional'", ctes=MEMORIES_SQL)
def mem_list_filtered(spark, d):
    """The page is taken before the sector counts."""
    return state.listed(derive.memories(spark, d), 60, 5, "u3", "emotional").select("id", "sector")


@query("SELECT id, last_seen_at FROM memories WHERE user_id = 'u3' AND (project_id = 'src3' OR project_id = 'system_global' OR project_id IS NULL) ORDER BY last_seen_at DESC, id LIMIT 25", ctes=MEMORIES_SQL)
def mem_scoped_list(spark, d):
    return state.scoped_list(derive.memories(spark, d), 25, "u3", "src3").select("id", "last_seen_at")


@query("SELECT id, created_at FROM memories ORDER BY created_at DESC, id LIMIT 40 OFFSET 20", ctes=MEMORIES_SQL)
def mem_page(spark, d):
    return memory.page(derive.memories(spark, d), 40, 20).select("id", "created_at")


@query("SELECT 'memories' AS name, 0 AS after, count(*) AS before FROM memories UNION ALL SELECT 'vectors', 0, count(*) FROM vectors UNION ALL SELECT 'edges', 0, count(*) FROM graph UNION ALL SELECT 'users', 0, count(DISTINCT user_id) FROM memories", ctes=f"{MEMORIES_SQL}, {VECTORS_SQL}, {GRAPH_SQL}")
def wipe(spark, d):
    """Four tables written as a version and emptied in the next one, in one step; the version before still has them."""
    m = derive.memories(spark, d)
    tables = {"memories": m, "vectors": derive.vectors(spark, d), "edges": derive.graph_edges(spark, d), "users": m.select("user_id").distinct()}
    kept = Versions(spark, fresh_dir(spark, "wipe"))
    kept.commit(tables, 0)
    last = kept.transact(lambda read: dict(zip(tables, state.wiped(*map(read, tables)), strict=True)))
    rows = [kept.read(name, version).select(F.lit(name).alias("name"), F.lit(version == last).alias("now")) for name in tables for version in (last - 1, last)]
    counts = reduce(lambda x, y: x.unionAll(y), rows).groupBy("name")
    return counts.agg(F.count_if("now").cast("int").alias("after"), F.count_if(~F.col("now")).alias("before"))


@query(f"SELECT event_type AS type, count(*) AS count, {NOW_MS} AS ts FROM events GROUP BY 1 UNION ALL SELECT 'decay', 3, {AT}")
def maintenance_log(spark, d):
    old = spark.createDataFrame([("decay", 3, AT)], "type string, count long, ts long")
    counts = derive.table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    return state.logged(old, counts.unionByName(spark.createDataFrame([("none", 0)], "type string, count long")), NOW_MS)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'system_global' ELSE 'alpha' END AS project_id FROM memories WHERE id % 4 < 3", ctes=MEMORIES_SQL)
def store_scoped(spark, d):
    """Contextual rows go to a project, factual ones to all projects; one read sees both kinds."""
    m = derive.memories(spark, d)
    both = state.stored(m.where("id % 2 = 1"), "alpha").unionByName(state.stored(m.where("id % 2 = 0"), everywhere=True)).unionByName(state.stored(m.where("id % 4 = 3"), "beta"))
    return both.where(scope.of_project("alpha") & (F.col("id") % 4 < 3)).select("id", "project_id")


@query("SELECT doc_id AS id, CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END + CASE WHEN lang NOT IN ('en', 'fr') THEN 1 ELSE 0 END + CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END + CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END AS faults FROM documents")
def requests_invalid(spark, d):
    rows = derive.table(spark, d, "documents")
    bad = state.invalid(rows, ("text",), {"text": 2000}, {"n_chars": (0, 3000)}, {"lang": ["en", "fr"]})
    return bad.select(F.col("doc_id").alias("id"), F.size("errors").alias("faults"))


# metadata, JSON and text scalars

META_SQL = "meta AS (SELECT doc_id AS id, 'ns' || (doc_id % 3) AS namespace, 'g' || (doc_id % 2) AS graph_id, source || '/' || lang || '/f' || (doc_id % 50) || '.py' AS path, 's' || (doc_id % 11) AS session FROM documents)"


def _meta(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/f"), i % 50, F.lit(".py"))
    m = derive.table(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("ns"), i % 3).alias("namespace"), F.concat(F.lit("g"), i % 2).alias("graph_id"), path.alias("path"), F.concat(F.lit("s"), i % 11).alias("session"))
    return m.withColumn("meta", F.to_json(F.struct(F.struct("namespace", "graph_id").alias("lgm"), F.col("session").alias("ide_session_id"), F.col("path").alias("ide_file_path"))))


@query("SELECT id FROM meta WHERE namespace = 'ns1' AND graph_id = 'g0'", ctes=META_SQL)
def meta_scope(spark, d):
    return _meta(spark, d).where(nodes.in_namespace(F.col("meta"), "ns1", "g0")).select("id")


@query("SELECT m.id, m.path FROM meta m JOIN memories USING (id) WHERE session = 's3' AND sector = 'procedural' AND contains(path, 'f1')", ctes=f"{MEMORIES_SQL}, {META_SQL}")
def session_patterns(spark, d):
    """Procedural memories of a session whose path holds a part."""
    m = _meta(spark, d).join(derive.memories(spark, d).select("id", "sector"), "id")
    return m.where(scope.meta_equals("meta", "$.ide_session_id", "s3") & (F.col("sector") == "procedural") & F.contains("path", F.lit("f1"))).select("id", "path")


@query("SELECT id, regexp_extract(path, '([^/]*)$', 1) AS name FROM meta", ctes=META_SQL)
def basenames(spark, d):
    return _meta(spark, d).select("id", text.basename(F.get_json_object("meta", "$.ide_file_path")).alias("name"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 160 THEN regexp_replace(substring(text, 1, 160), '\\s+$', '') || '...' ELSE text END AS line, substring(text, 1, 100) || '...' AS snippet FROM documents")
def text_lines(spark, d):
    t = F.col("text")
    return derive.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.truncated(t, 160).alias("line"), F.concat(F.substring(t, 1, 100), F.lit("...")).alias("snippet"))


@query("SELECT event_id AS id, CAST(CASE WHEN event_id % 3 = 0 THEN -1 ELSE coalesce(json_extract(props, '$.k')::BIGINT, -1) END AS BIGINT) AS k FROM events")
def json_safe(spark, d):
    """A broken text gives the fallback."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    parsed = text.parsed_or(broken, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return derive.table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query(f"SELECT id, round(1 / (1 + exp(-(0.7 * salience + 0.3 * coactivations / 10.0))), 6) AS strength, round(greatest(0, salience / (1 + {SEEN})), 6) AS weight, round(greatest(0.1, least(0.9, 0.4 * (1 + ln(coactivations + 1)))), 6) AS threshold, round(0.6 * salience + 0.2 * exp(-0.02 * {SEEN} * 24) + 0.2 * least(salience, 1), 6) AS score, round(least(1, salience + 0.5), 6) AS hit FROM memories", ctes=MEMORIES_SQL)
def score_parts(spark, d):
    s, c, e = F.col("salience"), F.col("coactivations"), _seen()
    parts = {"strength": dynamics.link_strength(s, c / 10.0), "weight": dynamics.link_weight(s, e), "threshold": dynamics.energy_threshold(c.cast("double")), "score": dynamics.plain_score(s, e * 24, s), "hit": dynamics.hit(s)}
    return derive.memories(spark, d).select("id", *[_r(x).alias(n) for n, x in parts.items()])


@query("SELECT a.scope, m.id, round(CASE a.scope WHEN 'past' THEN greatest(0.3, 1 - x / 30) WHEN 'present' THEN CASE WHEN x < 7 THEN 1 ELSE greatest(0.5, 1 - x / 30) END WHEN 'future' THEN 0.7 ELSE 1 END, 6) AS relevance FROM (SELECT id, %s AS x FROM memories) m, (VALUES ('past'), ('present'), ('future'), ('general')) a(scope)" % SEEN, ctes=MEMORIES_SQL)
def temporal_relevance(spark, d):
    m = derive.memories(spark, d).select("id", _seen().alias("x"), F.explode(F.array(*map(F.lit, ("past", "present", "future", "general")))).alias("scope"))
    return m.select("scope", "id", _r(dynamics.temporal_relevance(F.col("scope"), F.col("x"))).alias("relevance"))


# vectors


@query(f"SELECT query_id, vec_id, rank, round(s, 6) AS resonance FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, {COSINE} * [{', '.join(map(str, RESONANCE))}][list_position({SECTORS}, m.sector)][list_position({SECTORS}, q.sector)] AS s FROM vectors r JOIN memories m ON m.id = r.id, vectors q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10", ctes=f"{MEMORIES_SQL}, {VECTORS_SQL}")
def vec_resonance(spark, d):
    """The ten best of each query by similarity times how its sector and the memory's go together. The factor is one for
    all memories of a sector, so that the ten nearest of each sector are enough."""
    v = derive.vectors(spark, d)
    rows = v.select("vec_id", "id", "v").join(derive.memories(spark, d).select("id", F.col("sector").alias("own")), "id")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v", F.col("sector").alias("asked"))
    every = asked.select("query_id", "v", F.explode(F.array(*map(F.lit, SECTORS))).alias("own"))
    near = search.top_k(rows, every, 10, key="vec_id", by="own").join(asked.select("query_id", "asked"), "query_id")
    scored = near.select("query_id", "vec_id", (F.col("similarity") * vectors.resonance(F.col("own"), F.col("asked"))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "vec_id"))
    return scored.withColumn("rank", rank.cast("bigint")).where("rank <= 10").select("query_id", "vec_id", "rank", _r(F.col("s")).alias("resonance"))


@query("SELECT id, i, round(avg(x), 6) AS x FROM (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors) GROUP BY 1, 2", ctes=VECTORS_SQL)
def vec_chunk_pool(spark, d):
    """The plain mean of a memory's vectors, not of length one."""
    m = search.pooled(derive.vectors(spark, d)).select("id", F.posexplode("mean").alias("i", "x"))
    return m.select("id", F.col("i").cast("bigint").alias("i"), _r(F.col("x")).alias("x"))


@query("""SELECT vec_id, i, round(m / n, 6) AS x FROM (SELECT vec_id, i, m, sqrt(sum(m * m) OVER (PARTITION BY vec_id)) AS n FROM (SELECT vec_id, i, list_avg(v[i * 3 + 1 : least((i + 1) * 3, 64)]) AS m FROM (SELECT vec_id, v, unnest(range(22)) AS i FROM vectors)))""", ctes=VECTORS_SQL)
def vec_decay_pool(spark, d):
    v = derive.vectors(spark, d).select("vec_id", F.posexplode(vectors.pooled(F.col("v"), 0.4, 16)).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("bigint").alias("i"), _r(F.col("x")).alias("x"))


@query("SELECT vec_id, i, round(x / n, 6) AS x FROM (SELECT vec_id, i, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM (SELECT vec_id, unnest(f) AS x, unnest(range(len(f))) AS i FROM (SELECT a.vec_id, list_concat(list_transform(a.v, lambda x: x * 0.6), list_transform(b.v[1:16], lambda x: x * 0.4)) AS f FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)))", ctes=VECTORS_SQL)
def vec_fused(spark, d):
    """Each vector beside the first part of the next one."""
    v = derive.vectors(spark, d).select("vec_id", "v")
    semantic = v.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("v", 1, 16).alias("s"))
    f = v.join(semantic, "vec_id").select("vec_id", F.posexplode(vectors.fused(F.col("v"), F.col("s"))).alias("i", "x"))
    return f.select("vec_id", F.col("i").cast("bigint").alias("i"), _r(F.col("x")).alias("x"))


@query("SELECT vec_id, CAST(len(v) * 4 AS BIGINT) AS bytes, round(list_sum(v), 4) AS total FROM vectors", ctes=VECTORS_SQL)
def vec_blobs(spark, d):
    """Vectors written as bytes and read back."""
    v = derive.vectors(spark, d).select("vec_id", vectors.to_bytes(F.col("v")).alias("b"))
    return v.select("vec_id", F.octet_length("b").cast("bigint").alias("bytes"), F.round(F.aggregate(vectors.from_bytes(F.col("b")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


SOFT = "exp(2.0 * (CASE sector WHEN 'episodic' THEN 1.2 WHEN 'semantic' THEN 1.0 WHEN 'procedural' THEN 1.1 WHEN 'emotional' THEN 1.3 ELSE 0.8 END))"


@query("SELECT query_id, id, rank, round(s, 6) AS similarity FROM (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.m, b.m) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.m, b.m), 9) DESC, b.id) AS rank FROM means a, means b WHERE a.id % 20 = 0) WHERE rank <= 5", ctes=f"{VECTORS_SQL}, means AS (SELECT id, list(x ORDER BY i) AS m FROM (SELECT id, i, sum(e * x) / sum(e) AS x FROM (SELECT id, {SOFT} AS e, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors) GROUP BY 1, 2) GROUP BY id)")
def vec_mean_topk(spark, d):
    """Search by the memories' mean vectors, as a sector of its own."""
    m = search.mean_vectors(derive.vectors(spark, d)).select("id", F.lit("_mean").alias("sector"), F.col("mean").alias("v"))
    q = m.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return search.top_k(m, q, 5).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), _r(F.col("similarity")).alias("similarity"))


FIRST = "a0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS a FROM (SELECT id FROM scored ORDER BY id LIMIT 5))"
SCORED = f"scored AS (SELECT m.id, {COSINE} * [{', '.join(map(str, RESONANCE))}][list_position({SECTORS}, m.sector)][2] * m.salience AS s FROM vectors r JOIN memories m ON m.id = r.id, (SELECT v FROM vectors WHERE vec_id = 6) q WHERE r.sector = 'semantic' AND m.salience > 0.01)"
COMBINED = "combined AS (SELECT s.id, s.s + 0.3 * coalesce(a.a, 0) AS e FROM scored s LEFT JOIN a3 a USING (id))"


@query("SELECT id, round(e, 6) AS energy FROM combined WHERE e > (SELECT greatest(0.1, least(0.9, 0.03 * (1 + ln(sum(e) + 1)))) FROM combined)", ctes=f"{MEMORIES_SQL}, {VECTORS_SQL}, {GRAPH_SQL}, {SCORED}, {FIRST}, {_round(0)}, {_round(1)}, {_round(2)}, {COMBINED}")
def retrieve_by_energy(spark, d):
    v = derive.vectors(spark, d).where("sector = 'semantic'")
    m = derive.memories(spark, d).join(v.select("id", F.col("v").alias("mean")), "id")
    q = v.where("vec_id = 6").select(F.col("v").alias("qv"))
    return insight.by_energy(m, q, "semantic", derive.graph_edges(spark, d), tau=0.03).select("id", _r(F.col("energy")).alias("energy"))


# decay


@query(f"SELECT count(*) AS processed, count(*) FILTER (abs(least(1, greatest(0, salience * exp(-{LAMBDA} * {SEEN}) + 0.08 * (1 - exp(-{LAMBDA} * {SEEN})))) - salience) > 1e-12) AS decayed FROM memories", ctes=MEMORIES_SQL)
def decay_counts(spark, d):
    new = dynamics.sector_decay(F.col("sector"), F.col("salience"), _seen())
    return derive.memories(spark, d).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.abs(new - F.col("salience")) > 1e-12).alias("decayed"))


SLICED = "sliced AS (SELECT id, segment, n, greatest(1, CAST(floor(n * 0.03) AS BIGINT)) AS size, pos FROM (SELECT id, id // 100 AS segment, count(*) OVER (PARTITION BY id // 100) AS n, row_number() OVER (PARTITION BY id // 100 ORDER BY id) - 1 AS pos FROM memories))"


@query("SELECT segment, id FROM sliced WHERE pos >= (7 + segment * 7919) % greatest(1, n - size + 1) AND pos < (7 + segment * 7919) % greatest(1, n - size + 1) + size", ctes=f"{MEMORIES_SQL}, {SLICED}")
def decay_sample(spark, d):
    m = memory.with_segments(derive.memories(spark, d).drop("segment"), 100)
    return insight.segment_slices(m, 0.03, 7).select(F.col("segment").cast("bigint").alias("segment"), "id")


LEFT = f"(SELECT *, CASE tier WHEN 'hot' THEN 0.005 WHEN 'warm' THEN 0.02 ELSE 0.05 END AS lam FROM (SELECT *, least(1, salience * (1 + ln(1 + coactivations))) AS a, CASE WHEN {SEEN} < 6 AND (coactivations > 5 OR salience > 0.7) THEN 'hot' WHEN {SEEN} < 6 OR salience > 0.4 THEN 'warm' ELSE 'cold' END AS tier FROM memories))"


KEPT_SQL = f"kept AS (SELECT id, exp(-lam * {SEEN} / (a + 0.1)) AS f FROM {LEFT})"


@query("""SELECT vec_id, round(f, 6) AS kept, CAST(CASE WHEN f < 0.3 THEN 32 WHEN f < 0.7 THEN ceil(64 / w) ELSE 64 END AS INTEGER) AS dim,
  CASE WHEN f >= 0.3 THEN round(CASE WHEN f < 0.7 THEN p[1] / sqrt(list_sum(list_transform(p, lambda x: x * x))) ELSE v[1] END, 6) END AS first,
  CASE WHEN f >= 0.3 THEN round(CASE WHEN f < 0.7 THEN p[len(p)] / sqrt(list_sum(list_transform(p, lambda x: x * x))) ELSE v[64] END, 6) END AS last
FROM (SELECT *, [list_avg(v[i * w + 1 : (i + 1) * w]) for i in range(CAST(ceil(64 / w) AS INTEGER))] AS p FROM (SELECT vec_id, v, f, CAST(ceil(64 / least(64, greatest(16, floor(64 * least(1, f))))) AS INTEGER) AS w FROM vectors JOIN kept USING (id)))""", ctes=f"{MEMORIES_SQL}, {VECTORS_SQL}, {KEPT_SQL}")
def decay_compression(spark, d):
    """What decay does to the memories' vectors: means over buckets below 0.7, a fingerprint in their place below 0.3."""
    m = insight.decayed(derive.memories(spark, d), NOW_MS).select("id", "content", "kept")
    rows = derive.vectors(spark, d).select("vec_id", "id", "v").join(m, "id")
    out = insight.compressed(rows, least=16)
    end = lambda i: F.when(F.col("kept") >= 0.3, _r(F.element_at("v", i)))
    return out.select("vec_id", _r(F.col("kept")).alias("kept"), F.size("v").alias("dim"), end(1).alias("first"), end(-1).alias("last"))


@query(None)
def decay_summaries(spark, d):
    """Texts as decay leaves them."""
    m = insight.decayed(derive.memories(spark, d), NOW_MS).where("kept < 0.7")
    kept = F.when(F.col("kept") < 0.3, passages.words_of_text(F.col("content"), 3)).otherwise(passages.reduced_of(F.col("content"), F.col("kept")))
    return m.select("id", _r(F.col("kept")).alias("kept"), kept.alias("summary"))


@query("SELECT id, CAST(CASE WHEN id % 20 = 0 AND dim <= 64 THEN 256 ELSE dim END AS INTEGER) AS dim, round(CASE WHEN id % 20 = 0 THEN least(1, salience + 0.5) ELSE salience END, 6) AS salience FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 32 ELSE 128 END AS dim FROM memories)", ctes=MEMORIES_SQL)
def query_hits(spark, d):
    """Memories that were met: small vectors are made anew, and salience grows."""
    m = derive.memories(spark, d).withColumn("v", F.array_repeat(F.lit(0.5).cast("float"), F.when(F.col("id") % 3 == 0, 32).otherwise(128)))
    hit = insight.on_hit(m, m.where("id % 20 = 0").select("id"), NOW_MS, 256)
    return hit.select("id", F.size("v").alias("dim"), _r(F.col("salience")).alias("salience"))


# graph


@query("SELECT src AS id, round(sum(weight * a * exp(-0.35)), 6) AS energy FROM graph JOIN a0 ON dst = a0.id GROUP BY 1", ctes=f"{GRAPH_SQL}, {A0}")
def graph_node_energy(spark, d):
    active = derive.table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("activation"))
    return graph.node_energy(derive.graph_edges(spark, d), active).select(F.col("src").alias("id"), _r(F.col("energy")).alias("energy"))


@query(f"SELECT CAST(id AS VARCHAR) AS src, id || ':' || s AS dst, CAST(0.5 AS DOUBLE) AS weight FROM memories, (SELECT unnest({SECTORS}) AS s) WHERE s <> sector UNION ALL SELECT id || ':' || s, CAST(id AS VARCHAR), CAST(0.5 AS DOUBLE) FROM memories, (SELECT unnest({SECTORS}) AS s) WHERE s <> sector", ctes=MEMORIES_SQL)
def graph_cross_sector(spark, d):
    m = derive.memories(spark, d).select("id", F.filter(F.array(*map(F.lit, SECTORS)), lambda s: s != F.col("sector")).alias("additional"))
    return graph.cross_sector(m)


@query(f"SELECT q.vec_id AS src, r.vec_id AS dst, CAST(0.5 AS DOUBLE) AS weight FROM vectors q JOIN vectors r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE (q.vec_id % 20 = 0 OR r.vec_id % 20 = 0) AND {COSINE} >= 0.3", ctes=VECTORS_SQL)
def graph_inter_memory(spark, d):
    """Edges both ways between new vectors (ids divisible by 20) and similar ones of their sector."""
    v = derive.vectors(spark, d).withColumn("sector", F.col("label").cast("string")).drop("id").withColumnRenamed("vec_id", "id")
    return graph.inter_memory(v, v.where("id % 20 = 0"), 0.3)


@query("SELECT src, dst, round(CASE WHEN o IS NULL THEN 0.3 WHEN p IS NULL THEN o ELSE least(1, o + 0.1) END, 6) AS weight FROM (SELECT coalesce(g.src, x.src) AS src, coalesce(g.dst, x.dst) AS dst, g.weight AS o, x.src AS p FROM (SELECT src, dst, max(weight) AS weight FROM graph GROUP BY 1, 2) g FULL JOIN (SELECT doc_id AS src, doc_id + 1 AS dst FROM documents WHERE doc_id % 2 = 0) x ON g.src = x.src AND g.dst = x.dst)", ctes=GRAPH_SQL)
def graph_contextual(spark, d):
    e = derive.graph_edges(spark, d).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    pairs = derive.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return graph.contextual(e, pairs).select("src", "dst", _r(F.col("weight")).alias("weight"))


STOPS = "['" + "', '".join(analysis.STOP_WORDS) + "']"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w))"


def _marked(kind: str) -> str:
    return " OR ".join(f"contains(t, {m!r})" for m in analysis.MARKERS[kind])


BENCH = f"items AS (SELECT item_id AS id, text, {_words('text')} AS w, CAST(0.1 AS DOUBLE) + (item_id % 9) / CAST(10.0 AS DOUBLE) AS salience, {NOW_MS} - (item_id % 40) * {3 * DAY_MS} AS last_seen_at FROM benchmark)"


def _items(spark, d):
    i = F.col("item_id")
    return derive.table(spark, d, "benchmark").select(i.alias("id"), "text", analysis.words(F.col("text")).alias("w"), (F.lit(0.1) + (i % 9) / 10.0).alias("salience"), (F.lit(NOW_MS) - (i % 40) * (3 * DAY_MS)).alias("last_seen_at"))


@query(f"SELECT a, b, round(s, 6) AS weight, CASE WHEN {_marked('contrastive')} THEN 'contrasting' WHEN {_marked('causal')} THEN 'causal' WHEN {_marked('temporal')} THEN 'temporal' ELSE 'associative' END AS kind FROM (SELECT a.id AS a, b.id AS b, lower(a.text || ' ' || b.text) AS t, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS s FROM items a JOIN items b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0) WHERE s > 0.02", ctes=BENCH)
def graph_semantic(spark, d):
    """Similar items (here from a similarity of 0.02, as they share little) with the kind of their relation."""
    return insight.semantic_edges(_items(spark, d), 0.02).withColumn("weight", _r(F.col("weight")))


@query(f"SELECT id, round(0.35 * salience + 0.25 * coalesce(k, 0) / n + 0.2 * coalesce(u, 0) + 0.2 * greatest(0, 1 - ({NOW_MS} - last_seen_at) / CAST(86400000 AS DOUBLE) / 90), 6) AS importance FROM items LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT a AS id FROM near UNION ALL SELECT b FROM near) GROUP BY 1) USING (id) LEFT JOIN (SELECT id, avg(CASE WHEN df = 1 THEN 1.0 ELSE 0.0 END) AS u FROM (SELECT id, unnest(w) AS t FROM items) JOIN (SELECT t, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS t FROM items) GROUP BY 1) USING (t) GROUP BY 1) USING (id), (SELECT count(*) AS n FROM items)", ctes=f"{BENCH}, near AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.02)")
def memory_importance(spark, d):
    return insight.importance(_items(spark, d), NOW_MS, 0.02).select("id", _r(F.col("importance")).alias("importance"))


# nodes


def _nodes(spark, d):
    return derive.memories(spark, d).join(_meta(spark, d).select("id", "meta"), "id")


RETRIEVED = """recent AS (SELECT m.*, x.namespace, x.graph_id, row_number() OVER (PARTITION BY sector ORDER BY created_at DESC, id) AS newest FROM memories m JOIN meta x USING (id)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY newest) AS k FROM recent WHERE newest <= %d AND namespace = 'ns1' AND graph_id = 'g0') WHERE k <= %d),
node AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY last_seen_at DESC, newest) AS place, CASE sector WHEN 'episodic' THEN 'observe' WHEN 'semantic' THEN 'plan' WHEN 'reflective' THEN 'reflect' WHEN 'procedural' THEN 'act' ELSE 'emotion' END AS node FROM firsts)"""
LINES = "string_agg(%s, chr(10) ORDER BY list_position(['observe', 'plan', 'reflect', 'act', 'emotion'], node), place)"
CUT = "CASE WHEN length(content) > 160 THEN regexp_replace(substring(content, 1, 160), '\\s+$', '') || '...' ELSE content END"


@query("SELECT node, place, id FROM node", ctes=f"{MEMORIES_SQL}, {META_SQL}, {RETRIEVED % (80, 20)}")
def node_retrieve(spark, d):
    return nodes.retrieve(_nodes(spark, d), "ns1", "g0", 20).select("node", "place", "id")


@query(f"SELECT count(*) AS n, {LINES % ('''concat('- [', node, '] ', ''' + CUT + ')')} AS summary FROM node", ctes=f"{MEMORIES_SQL}, {META_SQL}, {RETRIEVED % (40, 10)}")
def node_context(spark, d):
    return nodes.context(_nodes(spark, d), "ns1", "g0", 50)


@query(f"SELECT 'Reflection synthesized from LangGraph context (namespace=ns1, graph=g0)' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM (SELECT i, concat(i, '. [', node, '] ', {CUT}) AS line FROM (SELECT *, row_number() OVER (ORDER BY list_position(['observe', 'plan', 'reflect', 'act', 'emotion'], node), place) AS i FROM node))", ctes=f"{MEMORIES_SQL}, {META_SQL}, {RETRIEVED % (40, 10)}")
def node_reflection(spark, d):
    return nodes.reflection(_nodes(spark, d), "ns1", "g0", 50)


@query("""SELECT id AS source_id, node, CASE node WHEN 'observe' THEN 'episodic' WHEN 'act' THEN 'procedural' WHEN 'reflect' THEN 'reflective' ELSE 'semantic' END AS sector, false AS reflection, length(text) AS length, 3 AS tags FROM n
UNION ALL SELECT id, 'reflect', 'reflective', true, length('LangGraph reflection for node "' || node || '" | namespace=' || namespace || ' | graph=' || graph_id) + 2 + length(CASE WHEN length(text) > 480 THEN regexp_replace(substring(text, 1, 480), '\\s+$', '') || '...' ELSE text END), 5 FROM n WHERE node <> 'reflect'""", ctes=f"{META_SQL}, n AS (SELECT m.id, ['observe', 'act', 'reflect', 'other'][m.id % 4 + 1] AS node, namespace, graph_id, text FROM meta m JOIN documents ON doc_id = m.id)")
def node_store(spark, d):
    rows = _meta(spark, d).join(derive.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    rows = rows.withColumn("node", F.get(F.array(*map(F.lit, ("Observe", "act", "reflect", "other"))), (F.col("id") % 4).cast("int"))).withColumn("tags", F.lit(None).cast("array<string>"))
    return nodes.store(rows, NOW_MS).select("source_id", "node", "sector", "reflection", F.length("content").cast("bigint").alias("length"), F.size("tags").alias("tags"))


# the dashboard's text analysis


@query(f"SELECT id, CAST(len(w) AS INTEGER) AS words, CAST(greatest(0, len(w) - 1) AS INTEGER) AS pairs, array_to_string(w[1:3], ' ') AS first FROM (SELECT id, {_words('text')} AS w FROM cues)", ctes=CUES_SQL)
def text_ngrams(spark, d):
    w = derive.cue_texts(spark, d).select("id", analysis.words(F.col("text")).alias("w"))
    return w.select("id", F.size("w").alias("words"), F.size(analysis.ngrams(F.col("w"), 2)).alias("pairs"), F.coalesce(F.get(analysis.ngrams(F.col("w"), 3), F.lit(0)), F.array_join(F.slice("w", 1, 3), " ")).alias("first"))


@query(f"""SELECT id, list(g ORDER BY s DESC, kind, num, first) AS terms FROM (SELECT id, g, sum(s) AS s, CASE WHEN regexp_matches(g, '^(0|[1-9][0-9]*)$') AND coalesce(TRY_CAST(g AS BIGINT), 9e18) < 4294967295 THEN 0 ELSE 1 END AS kind, CASE WHEN regexp_matches(g, '^(0|[1-9][0-9]*)$') AND coalesce(TRY_CAST(g AS BIGINT), 9e18) < 4294967295 THEN TRY_CAST(g AS BIGINT) ELSE 0 END AS num, min(p) AS first
FROM (SELECT id, unnest(w) AS g, 1.0 AS s, unnest(range(len(w))) AS p FROM c UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))), 1.5, unnest(list_transform(range(1, len(w)), lambda i: 1000000 + i)) FROM c UNION ALL SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))), 2.0, unnest(list_transform(range(1, len(w) - 1), lambda i: 2000000 + i)) FROM c) GROUP BY id, g
QUALIFY row_number() OVER (PARTITION BY id ORDER BY sum(s) DESC, kind, num, min(p)) <= 10) GROUP BY id""", ctes=f"{CUES_SQL}, c AS (SELECT id, {_words('text')} AS w FROM cues)")
def text_key_terms(spark, d):
    return derive.cue_texts(spark, d).select("id", reading.key_terms_of(F.col("text"), 10).alias("terms"))


def _asked(spark, d, rows, of=None):
    """Each row with the words of one benchmark text, by turns, of all of them or so many."""
    b = derive.table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("asked"), analysis.words(F.col("text")).alias("q"))
    return rows.withColumn("asked", F.col("id") % (of or b.count())).join(q, "asked")


@query(f"SELECT id, round(list_sum(list_transform(q, lambda x: CASE WHEN len(list_filter(w, lambda y: y = x)) = 0 THEN 0.0 ELSE ln(1 + 1 / (len(list_filter(w, lambda y: y = x)) + 1.0)) * len(list_filter(w, lambda y: y = x)) * 2.5 / (len(list_filter(w, lambda y: y = x)) + 1.5 * (0.25 + 0.75 * len(w) / 100.0)) END)), 6) AS score FROM (SELECT id, {_words('c.text')} AS w, {_words('b.text')} AS q FROM cues c JOIN (SELECT text, item_id, count(*) OVER () AS n FROM benchmark) b ON b.item_id = c.id % b.n)", ctes=CUES_SQL)
def bm25_dashboard(spark, d):
    """Every text under one of the benchmark's texts as a query."""
    w = _asked(spark, d, derive.cue_texts(spark, d).select("id", analysis.words(F.col("text")).alias("w")))
    return w.select("id", _r(analysis.bm25(F.col("q"), F.col("w"))).alias("score"))


@query(f"SELECT id, asked, place, round(j * pow(0.95, place - 1) * salience, 6) AS attention FROM (SELECT id, asked, salience, row_number() OVER (PARTITION BY asked ORDER BY salience DESC, id) AS place, CASE WHEN len(list_distinct(list_concat(w, q))) = 0 THEN 0 ELSE len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))) END AS j FROM (SELECT i.*, b.item_id AS asked, {_words('b.text')} AS q FROM items i JOIN benchmark b ON b.item_id = i.id % 10))", ctes=BENCH)
def context_attention(spark, d):
    """How far each item counts in the window of its query, by its place and what it shares with the query."""
    rows = _asked(spark, d, _items(spark, d).withColumnRenamed("salience", "priority"), 10)
    return insight.attention(rows, F.col("q"), "asked").select("id", "asked", "place", _r(F.col("attention")).alias("attention"))


@query(f"SELECT id, round(0.25 * greatest(0, 1 - ({NOW_MS} - last_seen_at) / CAST(86400000 AS DOUBLE) / 30) + 0.35 * salience + 0.3 * 0.5 + 0.1 * CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END, 6) AS score FROM items", ctes=BENCH)
def rank_memories(spark, d):
    return insight.ranked(_items(spark, d).withColumn("score", F.lit(0.5)), NOW_MS).select("id", _r(F.col("rank_score")).alias("score"))


@query(None)
def relevance_scores(spark, d):
    """Relevance of every memory to one of the benchmark's texts as an analysed query, and its priority with time."""
    m = derive.memories(spark, d).select("id", F.coalesce("content", F.lit("")).alias("text"), "sector", "salience", "last_seen_at")
    b = derive.table(spark, d, "benchmark")
    asked = m.withColumn("asked", F.col("id") % b.count()).join(b.select(F.col("item_id").alias("asked"), F.col("text").alias("query")), "asked")
    rows = insight.relevance(asked.withColumn("w", analysis.words(F.col("text"))), NOW_MS)
    return rows.select("id", "asked", _r(F.col("relevance")).alias("relevance"), _r(F.col("priority")).alias("priority"))


@query("""SELECT id, CASE WHEN timed THEN 'temporal' WHEN complexity = 'complex' THEN 'deep' WHEN complexity = 'simple' THEN 'focused' ELSE 'broad' END AS strategy, CAST(CASE complexity WHEN 'complex' THEN 15 WHEN 'simple' THEN 5 ELSE 10 END AS INTEGER) AS wanted FROM (SELECT id, CASE WHEN %s THEN 'complex' WHEN %s THEN 'moderate' ELSE 'simple' END AS complexity, %s AS timed FROM cues)""" % tuple("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")" for ws in (analysis.COMPLEX, analysis.MODERATE, analysis.TIME_WORDS)), ctes=CUES_SQL)
def retrieval_strategy(spark, d):
    s = insight.strategy(F.col("text"))
    return derive.cue_texts(spark, d).select("id", s.alias("s")).select("id", "s.strategy", "s.wanted")


@query(None)
def retrieval_sectors(spark, d):
    s = insight.strategy(F.col("text"))
    return derive.cue_texts(spark, d).select("id", s.alias("s")).select("id", F.array_join("s.sectors", ",").alias("sectors"), "s.explanation")


@query(None)
def text_key_phrases(spark, d):
    return derive.cue_texts(spark, d).select("id", reading.key_phrases_of(F.col("text")).alias("phrases"))


@query(None)
def text_informative(spark, d):
    return derive.cue_texts(spark, d).select("id", reading.informative_of(F.col("text"), 2).alias("sentences"))


@query(None)
def text_density(spark, d):
    return derive.cue_texts(spark, d).select("id", _r(reading.density_of(F.col("text"))).alias("density"), _r(reading.coherence_of(F.col("text"))).alias("coherence"))


@query(None)
def text_spans(spark, d):
    c = derive.cue_texts(spark, d).select("id", F.posexplode(reading.spans_of(F.col("text"))).alias("number", "s"))
    return c.select("id", "number", "s.start", "s.end")


@query(None)
def memory_quality(spark, d):
    m = derive.whole_memories(spark, d).select("id", reading.quality_of(F.col("content"), F.col("salience")).alias("q"))
    return m.select("id", "q.valid", F.array_join("q.issues", "; ").alias("issues"), _r(F.col("q.score")).alias("score"))


def _results(spark, d):
    """Each benchmark item's eight nearest memories by their semantic vectors: bounded groups."""
    v = derive.memory_vectors(spark, d).where("sector = 'semantic'")
    q = v.join(derive.table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    best = search.top_k(v, q, 8).select("query_id", "id", "rank", "similarity")
    return best.join(derive.memories(spark, d), "id")


@query(None)
def memory_clusters(spark, d):
    return insight.clustered(_results(spark, d), 3).select("query_id", "cluster", "id", "sector", _r(F.col("coherence")).alias("coherence"), _r(F.col("importance")).alias("importance"))


@query(None)
def memory_insights(spark, d):
    return insight.insights(_results(spark, d), 3).select("query_id", "place", "insight", _r(F.col("confidence")).alias("confidence"), "sources")


@query(None)
def memory_answer(spark, d):
    """What an answer to each benchmark text is made of."""
    return insight.selected(_results(spark, d), 4).select("query_id", "place", "id", _r(F.col("gain")).alias("gain"), "said")


@query(None)
def memory_gaps(spark, d):
    q = derive.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return insight.gaps(q, _results(spark, d)).select("query_id", "topic", _r(F.col("confidence")).alias("confidence"))


@query(None)
def memory_expanded(spark, d):
    return insight.expanded(_results(spark, d), 0.05, 3).select("query_id", "id", "related")


@query("SELECT a.query_id, a.vec_id AS src, b.vec_id AS dst FROM top a JOIN top b ON a.query_id = b.query_id AND a.vec_id < b.vec_id", ctes=f"{VECTORS_SQL}, top AS (SELECT * FROM (SELECT q.vec_id AS query_id, r.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 9) DESC, r.vec_id) AS rank FROM vectors q JOIN vectors r ON q.sector = r.sector WHERE q.vec_id % 20 = 0) WHERE rank <= 4)")
def coactivation_pairs(spark, d):
    v = derive.vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "sector", "v")
    return retrieval.coactivation_pairs(search.top_k(v, q, 4, key="vec_id").withColumn("id", F.col("vec_id")), keep_query=True)


@query("SELECT hour, n, failed, round(100.0 * failed / n, 1) AS error_rate FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error' OR value < 10) AS failed FROM events GROUP BY 1)")
def error_rates(spark, d):
    e = derive.table(spark, d, "events").withColumn("failed", (F.col("event_type") == "error") | (F.col("value") < 10))
    return analytics.error_rates(e, "1 hour")


# writing memories


@query(None)
def memory_add(spark, d):
    """New memories from conversation turns: duplicates strengthen, others are classified, cut to their essence and
    embedded in each of their sectors."""
    t = derive.table(spark, d, "conversations")
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"), F.lit(None).cast("string").alias("project_id"))
    out = adding.add(rows, NOW_MS)
    m = out.memories.select("id", "sector", "segment", "arrivals", F.length("content").alias("length"), _r(F.col("salience")).alias("salience"))
    return m.join(out.waypoints.select(F.col("src").alias("id"), "dst"), "id", "left").join(out.vectors.groupBy("id").agg(F.count(F.lit(1)).alias("vectors")), "id", "left")


@query(None)
def memory_update(spark, d):
    """Changed contents are classified and embedded anew; others only get their tags."""
    m = derive.memories(spark, d).withColumn("version", F.lit(1))
    changes = m.select("id", F.when(F.col("id") % 4 == 0, F.lit("How to deploy: first install the tool, then run it.")).alias("content"), F.when(F.col("id") % 2 == 0, F.array(F.lit("new"))).alias("tags"))
    out = adding.update(m, derive.vectors(spark, d).select("id", "sector", "v"), changes, NOW_MS, dim=64)
    n = out.vectors.groupBy("id").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("v")).alias("dim"))
    return out.memories.select("id", "sector", "version", F.array_join("tags", ",").alias("tags")).join(n, "id", "left")


@query(None)
def embed_variants(spark, d):
    """The plain variant and the one from digests, in eight components."""
    m = derive.whole_memories(spark, d).select("id", F.col("content").alias("t"), "sector")
    return m.select("id", providers.embed_text(F.col("t"), F.col("sector"), "deep", ("plain",), 8).alias("plain"), providers.embed_text(F.col("t"), F.col("sector"), "deep", ("missing", "local"), 8).alias("digest"))


@query(None)
def search_documents(spark, d):
    return derive.cue_texts(spark, d).select("id", F.md5(text.search_document(F.col("text")).cast("binary")).alias("doc"), F.md5(text.fts_query(F.col("text")).cast("binary")).alias("fts"))


@query(None)
def chunk_round_trip(spark, d):
    """Chunks joined again, with how many there are."""
    c = derive.cue_texts(spark, d).select("id", passages.chunks(F.col("text")).alias("c"))
    return c.select("id", F.size("c").alias("chunks"), F.length(F.array_join(F.transform("c", lambda x: x["text"]), " ")).alias("length"))
