"""Scopes, facts of several owners, the write path, decay and the text analysis against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallix.functions import passages, providers, reading
from recallix.operators import adding, facts, insight, retrieval, state
from recallix.storage import shared_dir

FACT = "id long, user_id string, project_id string, subject string, predicate string, object string, valid_from long, confidence double"


def test_facts_of_one_owner_do_not_close_anothers(spark):
    rows = [(1, "alice", None, "s", "p", "A", 10, 0.9), (2, "bob", None, "s", "p", "B", 20, 0.9)]
    df = spark.createDataFrame(rows, FACT)
    assert {r.id: r.valid_to for r in facts.close_intervals(df).collect()} == {1: None, 2: None}
    old = facts.close_intervals(df)
    new = spark.createDataFrame([(3, "alice", None, "s", "p", "C", 30, 0.5), (4, None, None, "s", "p", "D", 40, 0.5), (5, None, None, "s", "p", "E", 40, 0.5)], FACT)
    got = facts.insert_facts(old, new)
    assert {r.id: r.valid_to for r in got.collect()} == {1: 29, 2: None, 3: None, 4: None, 5: None}
    assert {(r.user_id, r.object) for r in facts.current(got).collect()} == {("alice", "C"), ("bob", "B"), (None, "E")}
    assert [r.id for r in facts.by_id(got, got, "bob").collect()] == [2]
    assert {(r.user_id, r.change) for r in facts.compare(got, 15, 35).collect()} == {("alice", "changed"), ("bob", "added")}


def test_project_scope_of_facts(spark):
    rows = [(1, "u", "alpha", "s", "p1", "OA", 1, 0.9), (2, "u", "beta", "s", "p2", "OB", 1, 0.9), (3, "u", "system_global", "s", "p3", "OG", 1, 0.9), (4, "u", None, "s", "p4", "ON", 1, 0.9)]
    df = spark.createDataFrame(rows, FACT)
    assert {r.object for r in facts.by_id(df, df, "u", "alpha").collect()} == {"OA", "OG", "ON"}
    assert facts.by_id(df, df, "u").count() == 4 and facts.by_id(df, df, "v").count() == 0


def test_conflicts_are_all_overlaps(spark):
    rng = random.Random(3)
    rows = [(1, "s", "p", "A", 1, 100), (2, "s", "p", "B", 2, 90), (3, "s", "p", "A", 3, 50), (4, "s", "p", "A", 200, None)]
    for i in range(10, 400):
        start = rng.randint(1, 300)
        rows.append((i, f"s{rng.randint(0, 25)}", "p", rng.choice(["A", "B", "C", None]), start, rng.choice([None, start + rng.randint(0, 25), start + rng.randint(0, 25)])))
    df = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, valid_from long, valid_to long")
    end = lambda r: 10**9 if r[5] is None else r[5]
    want = {a[0] for a in rows for b in rows if a[1] == b[1] and a[3] != b[3] and a[4] <= end(b) and b[4] <= end(a)}
    assert {1, 2, 3} <= want and 4 not in want and {r.id for r in facts.conflicts(df).collect()} == want


def test_retrieval_stays_in_scope(spark):
    rng = np.random.default_rng(5)
    kind = "id long, content string, sector string, tags array<string>, user_id string, project_id string, salience double, created_at long, last_seen_at long"
    projects = ["alpha", "beta", "system_global", None]
    rows = [(i, f"the project meeting number {i}", "semantic", ["a"], f"u{i % 2}", projects[i % 4], 0.1 + (i % 9) / 10, i, i) for i in range(200)]
    m = spark.createDataFrame(rows, kind)
    v = spark.createDataFrame([(i, "semantic", rng.normal(size=8).tolist()) for i in range(200)], "id long, sector string, v array<double>")
    q = spark.createDataFrame([(1000, "project meeting"), (1001, "other")], "query_id long, text string")
    qv = spark.createDataFrame([(1000, "semantic", rng.normal(size=8).tolist()), (1001, "semantic", rng.normal(size=8).tolist())], "query_id long, sector string, v array<double>")
    got = retrieval.retrieve(q, qv, m, v, 1000, 5, project="alpha", user="u0", least_salience=0.4, since=20, until=180).collect()
    assert len(got) == 10
    for r in got:
        _, _, _, _, user, project, salience, made, _ = rows[r.id]
        assert user == "u0" and project in ("alpha", "system_global", None) and salience >= 0.4 and 20 <= made <= 180
    assert {rows[r.id][5] for r in retrieval.retrieve(q, qv, m, v, 1000, 50, project="alpha").collect()} == {"alpha", "system_global", None}


def test_text_parts_equal_the_column_functions(spark):
    from recallix.functions import text

    pairs = [("Dark mode at night", "Users prefer dark mode at night. They plan a meeting."), ("", "x"), ("schedule meetings", "We scheduled a meeting, meetings!"), ("我喜欢普洱茶", "他喜欢普洱茶吗")]
    q = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "query_id long, text string")
    m = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "id long, content string")
    both = q.join(m, F.col("query_id") == F.col("id"))
    got = {r.id: (r.overlap, r.keyword) for r in retrieval.text_parts(both.select("query_id", "id"), q, m, True).collect()}
    a, b = F.col("text"), F.col("content")
    keyword = text.keyword_score(text.phrase_match(a, b), text.keyword_overlap(text.keywords(a), text.keywords(b)), text.bm25(text.canonical_tokens(a), text.canonical_tokens(b)))
    for r in both.select("id", text.token_overlap(text.canonical_tokens(a), text.canonical_tokens(b)).alias("o"), keyword.alias("k")).collect():
        assert got[r.id] == (pytest.approx(r.o), pytest.approx(r.k))


def test_summaries_and_what_decay_leaves():
    t = "Plain words stand here. First, one; two: three, four. Short. The last sentence has many different words inside it. End"
    assert passages.summary(t) == "First, one; two: three, four. The last sentence has many different words inside it."
    assert passages.reduced(t, 0.9) == t and passages.reduced("x" * 300, 0.9) == "x" * 199 + "…" and passages.reduced(" ", 0.1) == ""
    assert len(passages.reduced(t, 0.5)) <= 80 and passages.reduced(t, 0.1) == "words different end first four"


def test_adding_memories(spark):
    rows = [(1, "How to deploy: first install the tool, then run the build.", "u1", None), (2, "How to deploy: first install the tool, then run the build.", "u1", None), (3, "I love this amazing style!! Wow.", "u1", "p"), (4, None, "u1", None), (5, "The capital of France is Paris.", None, None)]
    df = spark.createDataFrame(rows, "id long, content string, user_id string, project_id string")
    out = adding.add(df, 99, dim=32, segment=2)
    m = {r.id: r for r in out.memories.collect()}
    assert set(m) == {1, 3, 5} and m[1].arrivals == 2 and m[1].sector == "procedural" and m[3].sector == "emotional" and m[5].user_id == "anonymous"
    assert [m[i].segment for i in (1, 3, 5)] == [0, 0, 1] and m[1].salience == pytest.approx(min(1, 0.55 + 0.1 * (out.vectors.where("id = 1").count() - 1)))
    w = {r.src: r.dst for r in out.waypoints.collect()}
    assert w == {1: 3, 3: 1, 5: 5} and all(len(r.v) == 32 for r in out.vectors.collect())
    again = adding.strengthened(out.memories, df.where("id = 1"), 100)
    assert again.where("id = 1").first().salience == pytest.approx(m[1].salience + 0.15) and again.where("id = 3").first().last_seen_at == 99
    assert adding.add(df, 100, state=out.memories, dim=32).memories.count() == 0
    changes = spark.createDataFrame([(1, "The capital of France is Paris.", None), (3, None, ["t"])], "id long, content string, tags array<string>")
    new = adding.update(out.memories.withColumn("tags", F.array().cast("array<string>")), out.vectors, changes, 100, dim=16)
    n = {r.id: r for r in new.memories.collect()}
    assert (n[1].sector, n[1].version, n[3].version, n[5].version) == ("semantic", 2, 2, 1) and n[3].tags == ["t"]
    assert {len(r.v) for r in new.vectors.where("id = 1").collect()} == {16}


def test_embedders():
    v = providers.embedded("hello there", "semantic", "deep", ("missing", "local"), 40)
    assert np.allclose(v, providers.by_digest("hello there", "semantic", 40)) and np.linalg.norm(v) == pytest.approx(1)
    assert np.allclose(providers.embedded("hello", "semantic", "deep", ("missing",), 16), providers.by_features("hello", "semantic", 16))
    smart = providers.embedded("hello", "semantic", "smart", ("local",), 256)
    assert len(smart) == 384 and np.linalg.norm(smart) == pytest.approx(1)
    assert np.allclose(providers.by_plain_features("", "semantic", 4), 0.5)
    assert np.allclose(providers.pooled([np.array([1.0, 2.0]), np.array([3.0, 4.0])]), [2, 3])
    with pytest.raises(ValueError):
        providers.embedded("x", "nowhere")
    models = {"semantic": {"a": "m1"}, "emotional": {"b": "m2"}}
    assert [providers.model_of(models, "emotional", x) for x in "abc"] == ["m1", "m2", "nomic-embed-text"] and providers.model_of(models, "semantic", "a", {"a": "own"}) == "own"


def test_reading():
    t = "Alice Smith met Bob. The quick brown fox runs fast. The quick brown fox sleeps now! On 1/2/2024 NASA said \"hello world\"."
    assert reading.key_terms("alpha beta alpha 200 100", 4) == ["alpha", "alpha beta alpha", "beta alpha 200", "alpha 200 100"]
    assert reading.key_terms("beta 300 200", 10)[:1] == ["beta 300 200"] and reading.key_terms("beta 300 200", 6)[-3:] == ["200", "300", "beta"]
    assert reading.sentences(t)[1] == "The quick brown fox runs fast." and len(reading.sentences(t)) == 4
    assert [t[a:b] for a, b in reading.spans(t)] == reading.sentences(t)
    assert {"Alice Smith", "hello world", "NASA", "1/2/2024"} <= set(reading.entities(t))
    assert reading.key_phrases(t, 1)[0] in ("quick brown fox", "alice smith met") and reading.informative("Hi there you.", 3) == ["Hi there you."]
    assert reading.segment_coherence(["alpha beta", "alpha gamma"]) == pytest.approx(1 / 3) and reading.coherence("One.") == 1.0
    assert reading.quality("  ", 0.5) == (False, ["Empty content"], 0.0)
    valid, issues, score = reading.quality("short", 0.05)
    assert not valid and score == pytest.approx(0.3) and "Very low salience score" in issues
    assert reading.gaps("deploy kubernetes", {"deploy", "kubernetes cluster"})[0][0] == "deploy kubernetes"
    assert reading.completeness("deploy it", "deploy", 0) == pytest.approx(0.75)


def test_clusters_by_a_plain_search():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(6)) for _ in range(12)]
    groups = reading.clusters(texts, 4)
    every = [i for g in groups for i in g]
    assert len(groups) == 4 and len(set(every)) == len(every) and groups[0][0] == reading.clusters(texts, 4)[0][0]
    assert reading.clusters(texts[:3], 4) == [[0], [1], [2]]
    merged = insight.merged([{"members": [0], "terms": ["a", "b"]}, {"members": [1], "terms": ["c"]}, {"members": [2], "terms": ["a", "b"]}])
    assert [g["members"] for g in merged] == [[0, 2], [1]]


def test_validation(spark):
    df = spark.createDataFrame([("", "x" * 5, 5, "b"), ("ok", "x", 1, "a"), (None, None, None, None)], "a string, b string, n int, k string")
    got = [r.errors for r in state.invalid(df, ("a",), {"b": 3}, {"n": (0, 2)}, {"k": ["a"]}).collect()]
    assert got == [["a: required", "b: too long", "k: unknown", "n: out of range"], [], ["a: required"]]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_answers_are_chosen_for_what_is_new(spark):
    import itertools

    from recallix.operators import insight

    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "epsilon zeta alpha beta", "theta", None, "the of", "iota kappa lambda theta"]
    salience = [0.9, 0.95, 0.6, 0.3, 1.0, 1.0, 0.5]
    rows = spark.createDataFrame([(q, i, i + 1, t, "semantic", s) for q in (1, 2) for i, (t, s) in enumerate(zip(texts, salience, strict=True)) if q == 1 or i < 3], "query_id long, id long, rank int, content string, sector string, salience double")
    got = {q: [(r.id, round(r.gain, 9)) for r in g] for q, g in itertools.groupby(sorted(insight.selected(rows, 4).collect(), key=lambda r: (r.query_id, r.place)), key=lambda r: r.query_id)}
    assert got == {1: [(1, 0.95), (6, 0.5), (2, 0.3)], 2: [(1, 0.95), (2, 0.3)]}
    assert insight.selected(rows.limit(0), 4).count() == 0


def test_reflection_job(spark):
    from recallix.operators import analytics

    rows = spark.createDataFrame([(i, "u" if i < 30 else "v", 1000 + i, 0.95 if i == 4 else 0.5) for i in range(45)], "id long, user_id string, created_at long, salience double")
    seen = analytics.newest(rows, 25, 20)
    assert sorted(r.id for r in seen.collect()) == list(range(5, 30))  # the other owner has too few
    groups = spark.createDataFrame([(4, 4), (7, 4), (8, 8)], "id long, seed long")
    got = {r.id: (r.consolidated, round(r.salience, 3), r.updated_at) for r in analytics.reflected(rows, groups, 9).collect()}
    assert got[4] == (True, 1.0, 9) and got[7] == (True, 0.55, 9) and got[8] == (False, 0.5, 1008) and len(got) == 45


def test_unavailable_embedders_are_asked_again(monkeypatch):
    asked, waited = [], []

    def slow(text, sector, dim):
        asked.append(text)
        if len(asked) < 3:
            raise providers.Unavailable
        return np.ones(dim)

    monkeypatch.setitem(providers.REGISTRY, "slow", slow)
    assert providers.answered("slow", "x", "semantic", 4, sleep=waited.append).tolist() == [1, 1, 1, 1] and waited == [1, 2]
    monkeypatch.setitem(providers.REGISTRY, "never", lambda *a: (_ for _ in ()).throw(providers.Unavailable))
    assert providers.answered("never", "x", "semantic", 4, sleep=waited.append) is None
    monkeypatch.setitem(providers.REGISTRY, "faulty", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        providers.embedded("x", "semantic", "deep", ("faulty",), 4)


def test_long_texts_are_the_means_of_their_chunks(spark):
    rows = [("word and tasks. " * 600, "semantic"), ("short", "emotional"), (None, "semantic")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [r[0] for r in df.select(providers.embed_text(F.col("t"), F.col("s"), dim=48)).collect()]
    for (t, s), v in zip(rows, got, strict=True):
        parts = [x for x, _ in providers.chunked(t or "")] or [""]
        assert np.array_equal(np.array(v, np.float32), np.mean([providers.by_features(x, s, 48) for x in parts], axis=0).astype(np.float32))
