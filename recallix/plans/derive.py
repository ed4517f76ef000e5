"""The memory model's tables, derived from the given ones without randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import short_batches, spread
from ..config import DAY_MS, SECTORS, SEGMENT_SIZE
from ..operators.facts import close_intervals as closed

#: The clock of all queries: 2024-02-01T00:00Z.
NOW_MS = 1_706_745_600_000

#: Sentences that together touch every rule of the text operators; one goes before each text.
CUES = [
    "Yesterday I went to the meeting at 10:30 and felt great!!",
    "The capital of France is a fact that research and data represent; I learn best when I read.",
    "How to deploy: first install the tool, then run the build and press enter, finally click select.",
    "I love this amazing style, but I was angry and stressed, wow, sigh.",
    "After review I realize the lesson: the pattern and the connection improve my thinking.",
    "In order to plan the project, it is really due to the fact that prior to 2024-01-15 the tasks were just a number of bugs.",
    "See https://www.example.org/docs/page for the JavaScript function and the database configuration (draft) ; do not return.",
    "On monday we were at an event; the moment happened on January 12 and what did we do.",
    "Users and people prefer dark mode at night. Users and people prefer dark mode at night. They cannot schedule calls.",
    "The theory means a principle; the history of science and physics is a study of evidence.",
    "I think that in the near future the documents and questions will not be basically a problem.",
    "Step by step tutorial: type the method, drag the class, and scroll; there is feedback and evaluation.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread for work on their whole texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories from documents: owners, projects, times, salience and sectors by the id; tags from language and source."""
    return as_memories(table(spark, sf_dir, "documents"))


def whole_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories(), spread for work on their whole texts."""
    return as_memories(documents(spark, sf_dir))


def as_memories(d: DataFrame) -> DataFrame:
    """memories() of documents that may also come as a stream."""
    i = F.col("doc_id")
    sectors = F.array(*map(F.lit, SECTORS))
    rows = d.select(
        i.alias("id"),
        F.col("text").alias("content"),
        F.concat(F.lit("u"), i % 10).alias("user_id"),
        F.when(i % 4 == 0, "system_global").when(i % 4 != 1, F.col("source")).alias("project_id"),
        F.get(sectors, (i % 5).cast("int")).alias("sector"),
        F.array("lang", "source").alias("tags"),
        (F.lit(NOW_MS) - (i % 2000 + 1) * 7_200_000).alias("created_at"),
        (F.lit(0.1) + (i % 9) / 10.0).alias("salience"),
        (i % 8).alias("coactivations"),
        F.floor(i / SEGMENT_SIZE).cast("int").alias("segment"),
    )
    return rows.withColumn("last_seen_at", F.col("created_at") + F.floor((F.lit(NOW_MS) - F.col("created_at")) / 5) * (i_of("id") % 5))


def i_of(name: str) -> F.Column:
    return F.col(name)


#: The same as SQL, for the reference engine.
MEMORIES_SQL = f"""
m0 AS (SELECT doc_id AS id, text AS content, 'u' || CAST(doc_id % 10 AS VARCHAR) AS user_id,
  CASE WHEN doc_id % 4 = 0 THEN 'system_global' WHEN doc_id % 4 = 1 THEN NULL ELSE source END AS project_id,
  ['episodic','semantic','procedural','emotional','reflective'][doc_id % 5 + 1] AS sector, [lang, source] AS tags, lang, source,
  {NOW_MS} - (doc_id % 2000 + 1) * 7200000 AS created_at, CAST(0.1 AS DOUBLE) + (doc_id % 9) / CAST(10.0 AS DOUBLE) AS salience, doc_id % 8 AS coactivations,
  CAST(doc_id // {SEGMENT_SIZE} AS INTEGER) AS segment FROM documents),
memories AS (SELECT *, created_at + ({NOW_MS} - created_at) // 5 * (id % 5) AS last_seen_at FROM m0)"""


def cue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text has a cue before it."""
    cues = F.array(*map(F.lit, CUES))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.get(cues, (F.col("doc_id") % len(CUES)).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"), "lang", "source")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CUES_SQL = f"cues AS (SELECT doc_id AS id, [{', '.join(map(_quoted, CUES))}][doc_id % {len(CUES)} + 1] || ' ' || coalesce(text, '') AS text, lang, source FROM documents)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from events: user, type and value, of three owners; each is closed just before the next later one of its
    owner, subject and predicate."""
    return closed(as_facts(table(spark, sf_dir, "events")))


def as_facts(e: DataFrame) -> DataFrame:
    """The facts of events that may also come as a stream, without ends."""
    i = F.col("event_id")
    return e.select(
        i.alias("id"),
        F.concat(F.lit("t"), i % 3).alias("user_id"),
        F.when(i % 4 == 0, "system_global").when(i % 4 != 1, F.concat(F.lit("p"), i % 4)).alias("project_id"),
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.get_json_object("props", "$.k").alias("object"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("valid_from"),
        (F.lit(0.05) + (i % 20) / 20.0).alias("confidence"),
    )


FACTS_SQL = """
f0 AS (SELECT event_id AS id, 't' || CAST(event_id % 3 AS VARCHAR) AS user_id, CASE event_id % 4 WHEN 0 THEN 'system_global' WHEN 1 THEN NULL ELSE 'p' || CAST(event_id % 4 AS VARCHAR) END AS project_id,
  CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object,
  epoch_us(ts) // 1000 AS valid_from, CAST(0.05 AS DOUBLE) + (event_id % 20) / CAST(20.0 AS DOUBLE) AS confidence FROM events),
facts AS (SELECT *, min(valid_from) OVER (PARTITION BY user_id, subject, predicate ORDER BY valid_from RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS valid_to FROM f0)"""


def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each fact of an owner's subject to its next one, which ends with it; its weight falls with the days
    between."""
    f = facts(spark, sf_dir)
    w = Window.partitionBy("user_id", "subject").orderBy("valid_from", "id")
    n = f.withColumn("target_id", F.lead("id").over(w)).withColumn("until", F.lead("valid_from").over(w)).withColumn("edge_to", F.lead("valid_to").over(w)).where("target_id IS NOT NULL")
    return n.select(F.col("id").alias("source_id"), "target_id", F.col("predicate").alias("relation"), F.col("valid_from").alias("edge_from"), "edge_to", (1 / (1 + (F.col("until") - F.col("valid_from")) / DAY_MS)).alias("weight"))


EDGES_SQL = """
e0 AS (SELECT *, lead(id) OVER w AS target_id, lead(valid_from) OVER w AS until, lead(valid_to) OVER w AS edge_to FROM facts WINDOW w AS (PARTITION BY user_id, subject ORDER BY valid_from, id)),
edges AS (SELECT id AS source_id, target_id, predicate AS relation, valid_from AS edge_from, edge_to, 1 / (1 + (until - valid_from) / CAST(86400000 AS DOUBLE)) AS weight FROM e0 WHERE target_id IS NOT NULL)"""


def memory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors, one a sector, for every memory: those of the embeddings of the numbers that follow from its own, as
    often as there are embeddings."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    sectors = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("sector")) for i, s in enumerate(SECTORS)]))
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sectors.alias("s"))
    m = m.select("id", "s.sector", ((F.col("id") * 5 + F.col("s.i")) % n).alias("vec_id"))
    return m.join(e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "vec_id").select("id", "sector", "v")


MEMORY_VECTORS_SQL = """mv AS (SELECT d.doc_id AS id, s.sector, CAST(e.embedding AS DOUBLE[]) AS v FROM documents d, (VALUES (0, 'episodic'), (1, 'semantic'), (2, 'procedural'), (3, 'emotional'), (4, 'reflective')) s(i, sector)
  JOIN embeddings e ON e.vec_id = (d.doc_id * 5 + s.i) % (SELECT count(*) FROM embeddings))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by memory and sector: five follow-up embeddings belong to one memory."""
    sectors = F.array(*map(F.lit, SECTORS))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("id"), F.get(sectors, (F.col("vec_id") % 5).cast("int")).alias("sector"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "vec_id", "label")


VECTORS_SQL = "vectors AS (SELECT vec_id // 5 AS id, ['episodic','semantic','procedural','emotional','reflective'][vec_id % 5 + 1] AS sector, CAST(embedding AS DOUBLE[]) AS v, vec_id, label FROM embeddings)"


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An association graph over memories: each points at one or two others, by the id alone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    one = d.select(F.col("id").alias("src"), (F.col("id") * 7 % 997 + F.floor(F.col("id") / 997) * 997).alias("dst"), (0.3 + (F.col("id") % 7) / 10.0).alias("weight"))
    two = d.where("id % 3 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (0.25 + (F.col("id") % 5) / 8.0).alias("weight"))
    return one.unionByName(two).where("src <> dst")


GRAPH_SQL = """graph AS (SELECT * FROM (SELECT doc_id AS src, doc_id * 7 % 997 + doc_id // 997 * 997 AS dst, CAST(0.3 AS DOUBLE) + (doc_id % 7) / CAST(10.0 AS DOUBLE) AS weight FROM documents
  UNION ALL SELECT doc_id, doc_id + 1, CAST(0.25 AS DOUBLE) + (doc_id % 5) / CAST(8.0 AS DOUBLE) FROM documents WHERE doc_id % 3 = 0) WHERE src <> dst)"""
