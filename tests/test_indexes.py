"""Index structures, versions, stateful streams, deliveries and crawls against plain versions."""

import collections
import hashlib
import hmac
import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallix.functions import embedding
from recallix.functions.text import canonical_counts, canonical_list
from recallix.operators import cells, facts, fulltext, hamming, memory, search
from recallix.operators.versions import Conflict, Versions
from recallix.ship import ship
from recallix.sources import html, webhooks
from recallix.streaming import stateful


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def vectors(spark, n=600, dim=12):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + 0.6 * rng.normal(size=(n, dim))
    x[50:120] = x[50]
    rows = [(i, v, i % 4) for i, v in enumerate(x.tolist())] + [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [1.0], 0), (n + 3, [float("nan")] * dim, 0)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)


def nearest(x, q, k, keep=lambda i: True):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted((-round(float(u[q] @ u[i]), 9), i) for i in range(len(x)) if keep(i))
    return [i for _, i in order[:k]]


def test_probed_cells(spark):
    x, rows = vectors(spark)
    index = cells.measured(cells.build(rows, cells=20), rows, 5, 0.9)
    assert index.rows.sum() == 600 and 1 <= index.probes <= 20
    q = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    found = cells.probed(index, q, 5)
    exact = search.top_k(rows.where("id < 600").withColumn("one", F.lit(1)), q.where("query_id < 600").withColumn("one", F.lit(1)), 5, by="one")
    r = cells.recall_of(found, exact, "id").first()
    assert r.queries == 30 and r.recall >= 0.9
    every = collections.defaultdict(list)
    for r in sorted(cells.probed(index, q, 5, probes=20).collect(), key=lambda r: r.rank):
        every[r.query_id].append(r.id)
    assert dict(every) == {i: nearest(x, i, 5) for i in range(0, 600, 20)}


def test_only_probed_cells_are_read(spark):
    _, rows = vectors(spark)
    index = cells.build(rows, cells=20)
    one = int(np.flatnonzero(index.rows)[0])
    part = cells.read(spark, index, [one])
    assert part.count() == index.rows[one] < 600
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+", plan)


@pytest.mark.parametrize("label", [2, 9])
def test_widened_search_is_exact(spark, label):
    x, rows = vectors(spark)
    index = cells.build(rows, cells=16)
    q = rows.where("id % 50 = 7").select(F.col("id").alias("query_id"), "v")
    got = collections.defaultdict(list)
    for r in sorted(cells.widened(index, q, 6, F.col("label") == label).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.id)
    assert dict(got) == ({i: nearest(x, i, 6, lambda j: j % 4 == 2) for i in range(7, 600, 50)} if label == 2 else {})
    few = cells.widened(index, q, 6, F.col("id") < 4, exact=False).groupBy("query_id").count().collect()
    assert len(few) == 12 and all(r["count"] == 4 for r in few)  # all there are


def test_cells_of_nothing(spark):
    _, rows = vectors(spark)
    index = cells.build(rows.limit(0))
    assert len(index.centres) == 0 and cells.measured(index, rows.limit(0), 3) is index


def test_fulltext_equals_scoring_all(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(40)] + ["tasks", "meeting", "日本語"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([4, 43])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)] + [(300, None), (301, ""), (302, "word1 " * 5000)]
    asked = [(i, text(rng.randint(1, 6))) for i in range(25)] + [(25, None), (26, "unseen"), (27, "word1 word1")]
    counts = {i: canonical_counts(t) for i, t in docs}
    assert all(c == collections.Counter(canonical_list(t)) for (_, t), c in zip(docs, counts.values(), strict=True))
    mean, n = sum(c.total() for c in counts.values()) / len(docs), len(docs)
    df = collections.Counter(t for c in counts.values() for t in c)
    want = {}
    for q, t in asked:
        scores = []
        for i, c in counts.items():
            s = sum(max(1e-6, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in canonical_counts(t) if c[w])
            scores += [(-round(s, 9), i)] if s > 0 else []
        if scores:
            want[q] = [i for _, i in sorted(scores)[:5]]
    rows = spark.createDataFrame(docs, "id long, content string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = fulltext.build(rows, page=16)
    got = collections.defaultdict(list)
    for r in sorted(fulltext.search(index, queries, 5).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.id)
    assert dict(got) == want
    asked_terms, pages = fulltext.bounds(index, queries)
    floor = fulltext.search(index, queries, 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    assert fulltext.reaching(pages, floor, 5, 0).count() < pages.count()  # some pages are never scored
    assert fulltext.search(fulltext.build(rows.limit(0)), queries).count() == 0


@pytest.mark.parametrize(("most", "parts", "meet"), [(3, 1, 2048), (3, 2, 3), (3, 3, 2048), (2, None, 2), (0, 1, 2048)])
def test_hamming_pairs(spark, monkeypatch, most, parts, meet):
    monkeypatch.setattr(hamming, "MEET", meet)
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(14)] + [0, 2**64 - 1, 7]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    want = {(a, b, (a ^ b).bit_count() if a >= 0 and b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count()) for a in set(signed) for b in set(signed) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= most}
    got = hamming.near_pairs(spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "value long"), most, parts).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_near_counts(spark):
    rows = [(1, "0000000000000000"), (2, "0000000000000001"), (3, "0000000000000001"), (4, "000000000000000f"), (5, "ffffffffffffffff"), (6, None), (7, "8000000000000003")]
    got = {r.id: (r.same, r.near, r.first) for r in hamming.near_counts(spark.createDataFrame(rows, "id long, simhash string")).collect()}
    assert got == {1: (0, 3, 1), 2: (1, 3, 1), 3: (1, 3, 1), 4: (0, 3, 2), 5: (0, 0, 5), 7: (0, 4, 1)}


def arriving(spark, rows, schema, folder, batches):
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


FACTS = "id long, user_id string, subject string, predicate string, object string, valid_from long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_facts_in_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    day = 86_400_000
    rows = [(i, rng.choice(["u", None]), f"s{rng.randrange(2)}", "p", rng.choice(["a", "b", None]), rng.randrange(-20, 20) * day * rng.choice([1, 17])) for i in range(70)]
    stream = stateful.fact_history(arriving(spark, rows, FACTS, str(tmp_path), 4))
    columns = ["id", "user_id", "subject", "predicate", "object", "valid_from", "valid_to"]
    got = stateful.latest(stream, ["id"]).select(columns).collect()
    want = facts.close_intervals(spark.createDataFrame(rows, FACTS)).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_late_fact_keeps_intervals_in_order(spark, tmp_path):
    rows = [(i, "u", "s", "p", o, at) for i, (o, at) in enumerate([("a", 10), ("late", 5), ("b", 20), ("c", 30)])]
    for part in ([rows[0], rows[2]], [rows[1]], [rows[3]]):
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = stateful.fact_history(spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)))
    assert {r.object: (r.valid_from, r.valid_to) for r in stateful.latest(stream, ["id"]).collect()} == {"late": (5, 9), "a": (10, 19), "b": (20, 29), "c": (30, None)}


def test_forgotten_parts_of_a_history(spark, tmp_path):
    day = 86_400_000
    rows = [(i, "u", "s", "p", "o", (i + 1) * 40 * day) for i in range(6)]
    for r in rows:
        spark.createDataFrame([r], FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path))
    s = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).withColumn("ts", F.timestamp_millis("valid_from")).withWatermark("ts", "1 day")
    got = stateful.latest(stateful.fact_history(s, late=5 * day), ["id"]).collect()
    assert sorted((r.id, r.valid_to) for r in got if r.valid_to) == [(i, (i + 2) * 40 * day - 1) for i in range(5)]


def test_arrivals_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"memory number {rng.randrange(25)} of project {rng.choice('abc')}" if i % 9 else None, rng.randrange(50), 0.1 + i % 8 / 10) for i in range(160)]
    rng.shuffle(rows)
    kind = "id long, content string, created_at long, salience double"
    columns = ["id", "simhash", "arrivals", "last_seen_at", "salience"]
    got = stateful.latest(stateful.arrivals(arriving(spark, rows, kind, str(tmp_path), 3)), ["simhash"]).select(columns)
    want = memory.deduplicated(spark.createDataFrame(rows, kind).where("content IS NOT NULL")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_queue_lets_fifty_go_at_a_tick(spark, tmp_path):
    rows = [(i % 7, i % 7 + 1, float(i % 3)) for i in range(230)]
    stream = stateful.coactivation_queue(arriving(spark, rows, "src long, dst long, hours double", str(tmp_path), 2), lanes=1, tick_ms=10)
    left = stateful.drained_queue(stream, 230, 120).withColumn("file", F.input_file_name())
    assert sorted((r.src, r.dst, r.hours) for r in left.collect()) == sorted(rows)
    assert max(r["count"] for r in left.groupBy("file").count().collect()) <= 50


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/tables")
    one = spark.createDataFrame([(1, "a")], "id long, x string")
    assert v.current() == 0 and v.commit({"m": one, "n": one}, 0) == 1
    assert v.transact(lambda read: {"m": read("m").unionByName(one)}) == 2
    assert v.read("m").count() == 2 and v.read("n").count() == 1 and v.read("m", 1).count() == 1
    with pytest.raises(Conflict):
        v.commit({"m": one}, 1)  # another writer was first
    assert v.current() == 2 and len(os.listdir(tmp_path / "tables/data")) == 2

    calls = []

    def change(read):
        if not calls:
            calls.append(v.commit({"n": one.unionByName(one)}, v.current()))
        return {"m": read("m").unionByName(one)}

    assert v.transact(change) == 4 and v.read("n").count() == 2 and v.read("m").count() == 3
    v.expire(1)
    assert v.numbers() == [4] and v.read("m").count() == 3 and len(os.listdir(tmp_path / "tables/data")) == 2


def test_a_killed_task_changes_nothing(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/tables")
    rows = spark.range(100).repartition(4)
    v.commit({"m": rows}, 0)

    def die(batches):
        for b in batches:
            if 99 in b.column(0).to_pylist():
                os._exit(1)
            yield b

    with pytest.raises(Exception, match="(?i)worker|abort|crash"):
        v.transact(lambda read: {"m": read("m").mapInArrow(die, "id long"), "other": rows})
    assert v.current() == 1 and v.read("m").count() == 100 and len(os.listdir(tmp_path / "tables/data")) == 1
    assert [n for n in os.listdir(tmp_path / "tables/versions") if not n.endswith(".crc")] == ["000000000001.json"]


def test_batches_of_facts_are_atomic(spark, tmp_path):
    kind = "id long, user_id string, subject string, predicate string, object string, valid_from long, valid_to long, confidence double"
    v = Versions(spark, f"file://{tmp_path}/tables")
    v.commit({"facts": spark.createDataFrame([(1, None, "s", "p", "a", 10, None, 1.0), (2, "u", "s", "p", "a", 10, None, 1.0)], kind)}, 0)
    good = [(3, "u", "s", "p", "b", 20, None, 0.5), (4, "u", "s", "p", "late", 5, None, 0.5)]
    for bad in [(5, "u", None, "p", "c", 30, None, 0.5), (5, "u", "s", "p", "c", None, None, 0.5), (5, "u", "s", "p", "c", 30, None, 1.5), (5, "u", "s", "p", "c", 30, None, None)]:
        with pytest.raises(Exception, match="bad fact"):
            facts.insert_batch(v, spark.createDataFrame([*good, bad], kind))
    assert v.current() == 1
    assert facts.insert_batch(v, spark.createDataFrame(good, kind)) == 2
    assert {r.id: r.valid_to for r in v.read("facts").collect()} == {1: None, 2: 19, 3: None, 4: 19}


def test_signatures_and_documents(spark):
    key, bodies = "k" * 64, ["", "é日", '{"commits": [{"message": "m", "url": "u"}, {"message": null, "url": "v"}]}', "x" * 5000]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for secret in (key, "short"):
        assert [r[0] for r in df.select(webhooks.hmac_sha256(F.col("b"), secret)).collect()] == [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
    sign = lambda body, secret: hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    push, issue, ping = bodies[2], json.dumps({"action": "opened", "issue": {"title": "t", "number": 3}}), '{"zen": [1]}'
    rows = [("1", "github", "push", "sha256=" + sign(push, "a"), push), ("2", "github", "issues", "sha256=" + sign(issue, "a").upper(), issue), ("3", "github", "ping", sign(ping, "a"), ping), ("4", "github", "ping", "sha256=" + sign(ping, "b"), ping), ("5", "notion", None, sign(ping, "b"), ping), ("6", "notion", None, None, ping), ("7", "other", None, "x", ping), ("8", "github", "push", "sha256=00", None), ("9", "github", "push", "sha256=" + sign("{}", "a"), "{}")]
    got = {r.id: (r.content, r.refused) for r in webhooks.documents(spark.createDataFrame(rows, webhooks.DELIVERY), {"github": "a", "notion": "b"}).collect()}
    assert got == {"1": ("m\nu\n\nv", None), "2": ("[opened] t\n", None), "3": (None, "bad_format"), "4": (None, "mismatch"), "5": (json.dumps({"zen": [1]}, indent=2), None), "6": (None, "header_missing"), "7": (None, "secret_missing"), "8": (None, "raw_body_missing"), "9": (None, "no content")}


def test_a_restart_reads_no_delivery_twice(spark, tmp_path):
    def deliver(name, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "source": "notion", "signature": hmac.new(b"b", b"{1}", hashlib.sha256).hexdigest(), "body": "{1}"}) + "\n" for i in ids))

    def run():
        q = webhooks.documents(webhooks.deliveries(spark, str(tmp_path / "in"), 1), {"notion": "b"}).writeStream
        q.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver("a.json", ["1", "2"])
    deliver("b.json", ["3"])
    assert run() == ["1", "2", "3"]
    deliver("c.json", ["4"])
    assert run() == run() == ["1", "2", "3", "4"]


def test_crawls_go_breadth_first_to_their_cap(spark):
    rng = random.Random(8)
    addresses = [f"http://{h}/{i}" for h in "ab" for i in range(40)]
    pages = {}
    for n, u in enumerate(addresses):
        links = [rng.choice([f"/{rng.randrange(50)}", f"http://{rng.choice('ab')}/{rng.randrange(40)}?q=1#x", "mailto:x", f"{rng.randrange(40)}#y"]) for _ in range(rng.randint(0, 6))]
        pages[u] = (n, links)
    rows = [(n, u + ("?s=2" if n % 3 else ""), f"<title> T{n} </title>" + "".join(f'<a href="{x}">x</a>' for x in links)) for u, (n, links) in pages.items()] + [(999, addresses[0], "<a href='/1'>other page of one address</a>"), (1000, None, "x"), (1001, "http://c/", None)]
    want = []
    for crawl, start in (("one", addresses[0]), ("two", addresses[45]), ("three", "http://nowhere/")):
        todo, visited, taken = collections.deque([(start, 0)]), set(), 0
        while todo and taken < 15:
            u, depth = todo.popleft()
            if u in visited or depth > 3:
                continue
            visited.add(u)
            if u in pages:
                taken += 1
                want.append((crawl, u, f"T{pages[u][0]}", depth, taken))
                todo += [(x, depth + 1) for x in html.own_links(pages[u][1], u)] if depth < 3 else []
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("one", addresses[0]), ("two", addresses[45] + "?z"), ("three", "http://nowhere/")], "crawl string, url string")
    assert sorted(map(tuple, html.crawl(df, seeds, 3, 15).collect())) == sorted(want)
    assert html.crawl(df, seeds.limit(0)).count() == 0


def test_embeddings_side_by_side_are_those_of_one(spark):
    texts = ["Users and people prefer dark mode at night", None, "", "é日本語 a1b2 🙂 tasks", "q" * 3000 + " w w", "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee"]
    rows = [(t, s) for t in texts for s in ("semantic", "emotional", "odd")]
    many = list(embedding.vectors_of(rows, 100, most=40))
    for (t, s), v in zip(rows, many, strict=True):
        tokens, got = canonical_list(t), np.zeros(100, np.float32)
        assert np.array_equal(v, embedding.synthetic(tokens, s, 100)) and abs(float(np.linalg.norm(v.astype(float))) - 1) < 1e-5
        distinct = list(dict.fromkeys(tokens))
        sw, n = embedding.EMBED_WEIGHT.get(s, 1.0), len(distinct)
        features = [(f"tok|{x}", 1) for x in distinct] + [(f"c{k}|{x[i : i + k]}", share) for k, share in ((3, 0.4), (4, 0.3)) for x in distinct for i in range(len(x) - k + 1)] if t and "🙂" not in t and n else []
        for f, share in features:
            h, g = embedding.fnv1a(f"{s}|{f}"), embedding.mixed(f"{s}|{f}")
            value = (math.log(1 + n) / n + 1) * sw * share * (-1 if h & 1 else 1)
            got[h % 100] += value
            got[g % 100] += value / 2
        if n == 1 and features:
            assert float(v @ got) > 0.8 * float(np.linalg.norm(got))
