"""Operators against plain models on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from recallix.functions import dynamics, vectors
from recallix.operators import facts, graph, ingest, memory, scope, search, sets
from recallix.sources import connectors, files, html
from recallix.streaming import windows


def test_project_scope(spark):
    df = spark.createDataFrame([("OA", "alpha"), ("OB", "beta"), ("OG", "system_global"), ("ON", None)], "o string, project_id string")
    assert {r.o for r in df.where(scope.of_project("alpha")).collect()} == {"OA", "OG", "ON"}
    assert df.where(scope.of_project(None)).count() == 4


def test_insert_keeps_one_open_fact(spark):
    kind = "id long, subject string, predicate string, object string, valid_from long, confidence double"
    old = facts.close_intervals(spark.createDataFrame([(1, "s", "p", "a", 10, 0.9), (2, "s", "p", "b", 20, 0.9)], kind))
    got = {r.id: r.valid_to for r in facts.insert_facts(old, spark.createDataFrame([(3, "s", "p", "c", 30, 0.5), (4, "s", "p", "d", 40, 0.5)], kind)).collect()}
    assert got == {1: 19, 2: 29, 3: 39, 4: None}


def test_conflicts(spark):
    kind = "id long, subject string, predicate string, object string, valid_from long, valid_to long"
    df = spark.createDataFrame([(1, "s", "p", "a", 10, 30), (2, "s", "p", "b", 20, None), (3, "s", "q", "a", 1, 5), (4, "s", "q", "b", 6, 9)], kind)
    assert sorted(r.id for r in facts.conflicts(df).collect()) == [1, 2]


def test_expand_is_a_search_by_levels(spark):
    edges = [(0, 1, 1.0), (0, 2, 0.5), (1, 3, 0.9), (2, 3, 1.0), (3, 0, 1.0), (3, 4, 0.05), (5, 6, 1.0)]
    got = {r.id: (round(r.weight, 6), r.path) for r in graph.expand(spark.createDataFrame([(0,)], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert got == {0: (1.0, [0]), 1: (0.8, [0, 1]), 2: (0.4, [0, 2]), 3: (0.576, [0, 1, 3])}


def test_path_reinforcement(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.99), (2, 3, 0.5)], "src long, dst long, weight double")
    got = {(r.src, r.dst): round(r.weight, 6) for r in graph.path_reinforced(e, spark.createDataFrame([([0, 1, 2],), ([0, 1],)], "path array<long>")).collect()}
    assert got == {(0, 1): 0.6, (1, 2): 1.0, (2, 3): 0.5}


def test_top_k_over_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "BLOCK", 7)
    x = np.random.default_rng(1).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, "s", v.tolist()) for i, v in enumerate(x)], "id long, sector string, v array<double>")
    got = search.top_k(rows, rows.where("id < 9").withColumnRenamed("id", "query_id"), 4).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(9):
        want = np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_similar_sets(spark):
    import itertools
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(12)] for _ in range(6)]
    rows = [(i, "s", (b := base[i % 6])[: rng.randint(9, 12)]) for i in range(40)] + [(40, "s", []), (41, "s", [])]
    got = {(r.a, r.b): r.similarity for r in sets.similar_sets(spark.createDataFrame(rows, "id long, sector string, tokens array<string>"), 0.7).collect()}
    t = {i: frozenset(x) for i, _, x in rows if x}
    first = {}
    for i in sorted(t):
        first.setdefault(t[i], i)
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if len(t[a] & t[b]) / len(t[a] | t[b]) >= 0.7} | {(first[t[i]], i) for i in t if first[t[i]] != i}
    assert set(got) == want


def test_memory_writes(spark):
    s = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 1)], "id long, salience double, version int")
    n = spark.createDataFrame([(2, 0.9, 1), (3, 0.1, 1)], "id long, salience double, version int")
    assert {r.id: r.salience for r in memory.upsert(s, n, ("id",), "version").collect()} == {1: 0.5, 2: 0.9, 3: 0.1}
    assert memory.insert_missing(s, n, "id").count() == 3
    got = memory.with_segments(spark.range(25).select("id"), 10)
    assert {r.id: r.segment for r in got.collect()} == {i: i // 10 for i in range(25)}


def test_recalled_memory_outlives(spark):
    a = b = 0.5
    for day in range(10):
        df = spark.createDataFrame([(a, b)], "a double, b double").select(*[dynamics.sector_decay(F.lit("episodic"), F.col(c), F.lit(1.0)).alias(c) for c in "ab"]).first()
        a, b = df.a, df.b
        if day % 2:
            a += 0.18 * (1 - a)
    assert a > b and 0 <= b <= 1


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.96, 0.0, 0.0]
    v = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "a array<double>").select(vectors.bucket_means(F.col("a"), 2).alias("m"), vectors.resized(F.col("a"), 6).alias("r")).first()
    assert v.m == pytest.approx([1.5 / math.hypot(1.5, 3.5), 3.5 / math.hypot(1.5, 3.5)]) and v.r == [1, 2, 3, 4, 0, 0]


def test_html_and_crawl(spark):
    page = "<html><body><nav><a href='/x'>no</a></nav><main><h1>Title</h1><p>Body &amp; more</p><script>bad()</script><a href='/b?q=1#f'>b</a></main></body></html>"
    assert html.read(page)[0] == "# Title\nBody & more\nb"
    assert html.read(None)[0] == ""
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", "<a href='/c'>c</a><a href='http://else/z'>z</a>")], "page_id long, url string, html string")
    got = {r.url: r.depth for r in html.crawl(pages, pages.where("url like '%a'").withColumn("crawl", F.lit(1)), 3).collect()}
    assert got == {"http://h/a": 0, "http://h/b": 1}


def test_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "1", "content": "x"}\nnot json\n{"id": "2"}\n')
    rows, counts = files.import_jsonl(spark, str(p))
    assert rows.count() == 1 and counts.first().asDict() == {"total": 3, "imported": 1, "failed": 2}
    files.backup(rows.select("id", "content"), str(tmp_path / "b"))
    assert files.restore(spark, str(tmp_path / "b"), rows.select("id", "content").schema).collect() == rows.select("id", "content").collect()
    m = files.migrated(rows, {"project_id": "string", "id": "string"})
    assert m.columns[-1] == "project_id" and files.migrated(m, {"project_id": "string"}).columns == m.columns
    assert files.verify(rows, rows).first().count_ok
    calls = []
    with pytest.raises(ValueError):
        files.retried(lambda: calls.append(1) or (_ for _ in ()).throw(ValueError()), 3, sleep=lambda s: None)
    assert len(calls) == 3


def test_signature(spark):
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "sha256=0"), ("body", None)], "b string, s string")
    assert [r.ok for r in df.select(files.signed(F.col("b"), F.col("s"), "k").alias("ok")).collect()] == [True, False, False]


def test_connectors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"sha": 1, "path": "p", "content": "text", "extra": {"x": [2]}}) + "\n\nnot json\n")
    (tmp_path / "in/b.json").write_text(json.dumps([{"sha": "2", "content": None}, {"sha": "3", "content": ["a"]}]))
    (tmp_path / "in/c.json").write_text(json.dumps({"sha": "4"}, indent=1))
    got = connectors.exports(spark, str(tmp_path / "in"), "github").collect()
    assert [(r.id, r.name, r.text, json.loads(r.meta)["extra"], r._corrupt) for r in got if r.id] == [("1", "p", "text", '{"x":[2]}', None)]
    assert [r._corrupt for r in got if not r.id] == ["not json"]
    whole = connectors.exports(spark, str(tmp_path / "in"), "github", lines=False).collect()
    assert sorted((r.id, r.text) for r in whole) == [("2", None), ("3", '["a"]'), ("4", None)]
    with pytest.raises(ValueError, match="no such connector"):
        connectors.exports(spark, str(tmp_path), "other")

    def run():
        rows = connectors.exports(spark, str(tmp_path / "in"), "github", stream=True, files=1)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).where("id IS NOT NULL").collect())

    assert run() == ["1"]
    (tmp_path / "in/d.jsonl").write_text(json.dumps({"sha": 5}) + "\n")
    assert run() == run() == ["1", "5"]


def test_ingest(spark):
    big = "\n\n".join(["para " * 50] * 5)
    df = spark.createDataFrame([("a", "small", "txt"), ("b", big, "txt"), ("c", None, "txt")], "id string, text string, kind string")
    got = ingest.ingest(df, large=100, section=300).collect()
    assert [r.strategy for r in got if r.id == "a"] == ["single"] and sum(r.strategy == "child" for r in got) == 5 and not any(r.id == "c" for r in got)
    assert ingest.links(ingest.ingest(df, large=100, section=300)).count() == 5


def test_rate_limit(spark, tmp_path):
    rows = [("x", 0), ("x", 10), ("x", 20), ("x", 100), ("y", 5)]
    spark.createDataFrame(rows, "client string, at long").coalesce(1).write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("client string, at long").parquet(str(tmp_path / "r"))
    got = {(r.client, r.at): r.allowed for r in windows.drained(windows.rate_limited(s, 2, 100)).collect()}
    assert got == {("x", 0): True, ("x", 10): True, ("x", 20): False, ("x", 100): True, ("y", 5): True}


def test_greedy_groups(spark):
    import random

    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(14)] for _ in range(4)]
    rows = [(i, "s", rng.sample(base[i % 4], rng.randint(8, 14))) for i in range(60)] + [(60, "s", []), (61, "s", rng.sample(base[0], 14))]
    got = {r.id: r.seed for r in sets.greedy_groups(spark.createDataFrame(rows, "id long, sector string, tokens array<string>"), 0.7).collect()}
    t, want = {i: set(x) for i, _, x in rows}, {}
    for i in sorted(t):
        if i not in want:
            want[i] = i
            want |= {o: i for o in t if o > i and o not in want and t[i] and len(t[i] & t[o]) / len(t[i] | t[o]) >= 0.7}
    assert got == want


def test_fusion_scores_all_queries(spark):
    from recallix.plans import queries

    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["vec_fusion_scores"](spark, d)
    one = {(r.id, r.fusion) for r in got.where("query_id = 0").collect()}
    assert got.select("query_id").distinct().count() > 1 and got.where("query_id % 20 <> 0").count() == 0
    assert one == {(r.id, r.fusion) for r in queries.QUERIES["vec_fusion_score"](spark, d).collect()}
