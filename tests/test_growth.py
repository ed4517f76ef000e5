"""What a task holds and does grows no faster than its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallix.plans import derive
from recallix.ship import ship

SF = "/root/testdata/sf0.001"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.fixture
def long_batches(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    yield
    spark.conf.set(ROWS, before)


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, t string")


def test_batches_of_given_tables_are_short(spark, long_batches):
    @F.arrow_udf("int")
    def size(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    rows = derive.table(spark, SF, "documents").coalesce(1).crossJoin(spark.range(5)).select("doc_id")
    assert rows.count() >= 1000 and rows.select(size("doc_id").alias("n")).agg(F.max("n")).first()[0] <= 256


def test_a_single_file_is_many_tasks(spark):
    assert derive.cue_texts(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_blocks_meet_in_short_batches(spark, long_batches):
    from recallix.operators import search

    rows = spark.createDataFrame([(i, "s", [float(i), 1.0]) for i in range(20)], "id long, sector string, v array<double>")
    met = search.similarities(rows, rows.where("id < 2").withColumnRenamed("id", "query_id"))
    assert met.count() == 40 and int(spark.conf.get(ROWS)) <= 256


@pytest.mark.parametrize("name", ["synthetic_embedding", "fingerprint_vector", "embed_variants", "memory_quality"])
def test_work_on_whole_memories_is_spread(spark, name):
    from recallix.plans import more, queries  # noqa: F401 - the other registers its queries

    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_plain_embedder_takes_many():
    from recallix.functions import embedding, providers

    rows = [("dark mode preferred by users 日本語の文章", "semantic"), ("", "episodic"), ("meeting meeting at noon", "emotional"), ("ab", "procedural")]
    many = list(providers.embedded_many(rows, "deep", ("missing", "plain"), 8))
    assert embedding.plain_many in providers.MANY.values()
    for (text, sector), v in zip(rows, many, strict=True):
        assert np.array_equal(v, providers.embedded(text, sector, "deep", ("plain",), 8))
    # one token: itself, and its position
    v, w = np.zeros(8, np.float32), float(embedding.EMBED_WEIGHT["procedural"])
    h, g = embedding.fnv1a("procedural|tok|ab"), embedding.mixed("procedural|tok|ab")
    value = (np.log(2) + 1) * w * (-1 if h & 1 else 1)
    v[h % 8] += value
    v[g % 8] += value / 2
    v[1] += 0.5 * w / np.log(2)
    assert np.allclose(many[3], v / np.linalg.norm(v), atol=1e-6)


ODD = [None, "", "ſaw it; ſtep by ſtep", "Kelvin Know", "I\x0bwas\x0bmet at\x0b10:30 on\x0bmonday", "我\r去了 我们abc\n去了 我们ab看到", "foo_yesterday yesterday_ éyesterday", "我\u0085去了!! 2024年1月2日", "Yesterday I learned THE fact. How to run it, step by step!", "JANUARY 12 what did we do 20240131"]


def test_classifier_reads_texts_by_arrow(spark):
    from recallix.config import SECTOR_WEIGHT, SECTORS
    from recallix.functions import text

    df = texts(spark, ODD)
    scores = df.select("id", text.sector_scores(F.col("t")).alias("s"), text.has_temporal_marker(F.col("t")).alias("m"))
    assert "RLIKE" not in scores._jdf.queryExecution().optimizedPlan().toString().upper()
    one = lambda r: F.when(F.col("t").rlike(text.pattern(*r[1:])), float(r[0])).otherwise(0.0)
    want = df.select("id", F.array(*[sum(map(one, text.RULES[s]), F.lit(0.0)) * SECTOR_WEIGHT[s] for s in SECTORS]).alias("s"))
    got = {r.id: r for r in scores.collect()}
    assert {r.id: r.s for r in want.collect()} == {i: r.s for i, r in got.items()}
    assert [got[i].m for i in (0, 1, 6, 8, 9)] == [None, False, True, True, True]


def test_compression_reads_texts_by_arrow(spark):
    from recallix.functions import compression

    long = "We met. we MET. We really do not know ( it ) ; the cat,  the dog. " + "It is fine. " * 4000
    rows = [None, "short", long, "See https://www.a.org/x\x0by for the JavaScript function.\n\n\n  end  \n It is just\x0bso  long that it counts"]
    c = F.col("t")
    df = texts(spark, rows).select("id", compression.chosen(c).alias("n"), compression.semantic(c).alias("s"), compression.compressed(c, compression.chosen(c)).alias("c"), compression.metrics(c, compression.semantic(c)).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    none, short, got, code = df.orderBy("id").collect()
    assert (none.n, none.s, none.c) == ("syntactic", None, None) and (short.n, short.s, short.c) == ("semantic", "short", "short")
    assert got.n == "semantic" and got.s == got.c == "We met. We do not know ( it ) ; the cat, the dog. It is fine."
    assert code.n == "aggressive" and code.c == "See a.org y for the JS fn. end it's so long that it counts"
    assert got.m.before == -(-(len(long) + 2 * len(long.split())) // 4) and got.m.saved == got.m.before - got.m.after


def plainly_ranked(text, n):
    """Key phrases by a search of the whole text for each."""
    from recallix.functions import reading

    scores = {}
    for s in reading.sentences(text):
        for p in reading.phrases(s):
            at = text.lower().find(p)
            capital = any("A" <= c <= "Z" for c in text[max(0, at - 1) : max(0, at + len(p) + 1)])
            scores[p] = scores.get(p, 0.0) + (1 + p.count(" ")) * (1.5 if capital else 1.0)
    return sorted(scores, key=lambda k: -scores[k])[:n]


def test_key_phrases_search_a_text_once():
    import random

    from recallix.functions import reading

    rng = random.Random(4)
    some = ["art", "smart", "art_", "good", "goodness", "Good", "the", "day", "days", "ARTday"]
    for size in [3, 30, 400] * 30:
        text = "".join(rng.choice(some) + rng.choice([" ", " ", "  ", ". ", ", "]) for _ in range(size))
        assert reading.key_phrases(text, 5) == plainly_ranked(text, 5)
        few = list(dict.fromkeys(p for s in reading.sentences(text) for p in reading.phrases(s)))
        assert reading.first_places(text.lower(), few) == {p: at for p in few if (at := text.lower().find(p)) >= 0}

    class Counted(str):
        searched = 0

        def find(self, *a):
            Counted.searched += 1
            return super().find(*a)

        def lower(self):
            return Counted(super().lower())

    reading.key_phrases(Counted(" ".join(f"word{i}" for i in range(2000)) + " End"), 5)
    assert Counted.searched <= 64


def test_density_counts_three_phrases(monkeypatch):
    from recallix.functions import reading

    monkeypatch.delattr(reading, "key_phrases")
    t = "Big cats sleep. Big cats sleep well here."
    assert reading.density(t) == min(1.0, reading.diversity(t) * (1 + len(reading.entities(t)) * 0.1) * 1.15)
    assert reading.density("word") == 1.0 and reading.density("") == 0.0
    assert reading.quality("Big cats sleep well here tonight.", 0.5) == (True, [], 1.0)


def test_summary_does_not_rank_words(monkeypatch):
    from recallix.functions import passages

    monkeypatch.delattr(passages, "frequent_words")
    t = "One two. Red green blue; black, white. The of and. Ten ten ten. A long sentence with many different words, here. Six. End."
    assert passages.summary(t) == "One two. Red green blue; black, white. A long sentence with many different words, here."


def test_strategy_reads_a_text_once(spark):
    from recallix.functions import analysis
    from recallix.operators import insight

    rows = ["", "How do I analyze the plan tomorrow?", "Explain why it feels sad", "HOW\x0bTO guide", "just a list", "Kelvin weeK: last weeK", "ſteps remember"]
    df = texts(spark, rows).select("id", insight.strategy(F.col("t")).alias("s"), analysis.intent(F.col("t")).alias("k"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("contains(") == 0
    got = {r.id: (r.s.strategy, r.s.wanted, r.k, r.s.sectors[0]) for r in df.collect()}
    assert got == {0: ("focused", 5, "factual", "semantic"), 1: ("temporal", 15, "procedural", "procedural"), 2: ("broad", 10, "factual", "semantic"), 3: ("broad", 10, "procedural", "procedural"), 4: ("focused", 5, "factual", "semantic"), 5: ("temporal", 5, "factual", "episodic"), 6: ("focused", 5, "episodic", "episodic")}


def test_sentiment_reads_a_text_once(spark):
    from recallix.functions import analysis

    rows = [None, "", "happy day at home with great joy", "bad bad good news", 'Alice Smith met "the\nteam" at NASA 1/2/2024 and NASA', "New\x0bYork City_ éParis"]
    df = texts(spark, rows).select("id", analysis.sentiment(F.col("t")).alias("s"), analysis.entities(F.col("t")).alias("e"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan
    got = df.orderBy("id").collect()
    assert got[0].s is None and got[0].e is None and tuple(got[1].s) == ("neutral", 0.0)
    assert tuple(got[2].s) == ("positive", 1.0) and tuple(got[3].s) == ("negative", 1.0)
    assert got[4].e == ["Alice Smith", "the\nteam", "NASA", "1/2/2024"] and got[5].e == ["New\x0bYork", "Paris"]


def test_facts_of_a_lane_leave_a_batch_once(spark, tmp_path):
    """Many keys share a lane, whose rows come in several Arrow batches."""
    from recallix.operators import facts
    from recallix.streaming import stateful

    kind = "id long, user_id string, subject string, predicate string, object string, valid_from long"
    rows = [(i, None if i % 5 == 0 else f"u{i % 3}", f"s{i % 4}", "p", None if i % 7 == 0 else "o", i * 37 % 101 * 86_400_000) for i in range(300)]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path))
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "16")
    try:
        stream = stateful.fact_history(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)), lanes=2)
        columns = ["id", "user_id", "subject", "predicate", "object", "valid_from", "valid_to"]
        got = stateful.latest(stream, ["id"]).select(columns).collect()
    finally:
        spark.conf.set(ROWS, before)
    want = facts.close_intervals(spark.createDataFrame(rows, kind)).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_text_sentiment_hands_a_text_to_python_once(spark):
    """One step of Python for both results, whose values are those of each alone; other characters part words."""
    from recallix.functions import analysis, reading
    from recallix.plans import queries

    plan = queries.text_sentiment(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1
    rows = [None, "", "goodK good\x1cgoodé bad_ GOOD İgood", "happinesſ sad\xa0SAD ABCd NASA Abc Def1 Ab CD", 'x/y "a"b" 1/2/2024 11/2/20245 éNASA _NASA A1']
    t = F.col("t")
    got = texts(spark, rows).select("id", analysis.tone(t).alias("t"), analysis.sentiment(t).alias("s"), F.size(analysis.entities(t)).alias("n")).orderBy("id").collect()
    assert got[0].t is None and all((r.t.polarity, r.t.intensity, r.t.entities) == (*r.s, r.n) for r in got[1:])
    assert [(r.s.polarity, r.n) for r in got[1:]] == [("neutral", 0), ("positive", 1), ("negative", 5), ("neutral", 3)]
    assert reading.words(rows[2]) == ["goodk", "good", "good", "bad_", "good", "good"] and reading.named(rows[3]) == ["Abc", "Ab", "SAD", "NASA", "CD"]
