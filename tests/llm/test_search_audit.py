"""Ranked search, the filter audit and the graph search against plain versions, on odd rows too."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallix.llm import filter_audit, graph_search, lexical
from recallix.ship import ship

LONG = "the cat sat on the mat & dog\n" * 60_000


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """The contract, word for word."""
    held = [(d, collections.Counter(words(t))) for d, t in docs if d is not None and words(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(list)
    for item, t in items:
        if item is not None:
            asked[item] += words(t)
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            scores += [(-s, d)] if s > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_bytes", [1, 4000, 1 << 24])
def test_ranked_search(spark, shard_bytes):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "a1", "İ"]
    text = lambda n: "".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary[: rng.choice([3, 65])]) + rng.choice([" ", "-", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(i * 7 % 101, text(rng.randint(0, 60))) for i in range(100)]
    docs += [(500, docs[3][1]), (499, docs[3][1]), (1000, None), (1001, ""), (1002, "!! \n"), (None, "w1 w2"), (-5, LONG), (2**40, "x" * 3_000_000 + " w5")]
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(20, None), (21, "%"), (22, "nothing here"), (None, "w1"), (23, "w1 w1 W1"), (23, "w2"), (24, "cat x" + "x" * 2_999_999)]
    d = spark.createDataFrame([(a, b, 1, "s") for a, b in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, score int")
    got = lexical.search(lexical.build_index(d, shard_bytes=shard_bytes), q, 10)
    assert rows_of(got) == ranked(docs, items, 10)


def test_ranked_search_of_repeated_rows_and_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "c c")], "item_id long, text string")
    assert [x[:3] for x in rows_of(lexical.search(lexical.build_index(d), q))] == [(1, 1, 1), (1, 2, 1), (2, 1, 2)]
    assert lexical.search(lexical.build_index(d.limit(0)), q).count() == 0
    assert lexical.search(lexical.build_index(d), q.limit(0)).count() == 0


def test_variable_length_bytes():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in range(1, 60)])
    data, ends = lexical.to_bytes(values)
    assert (lexical.from_bytes(data.tobytes()) == values).all() and len(ends) == len(values)
    assert len(lexical.from_bytes(b"")) == 0


def test_merge_equals_plain_sums():
    rng = random.Random(3)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 8)):
            places = sorted(rng.sample(range(60), rng.randint(1, 40)))
            impacts = [rng.randint(1, 5) for _ in places]
            lists.append((rng.choice([1, 1, 7, 30]), places, impacts, max(impacts)))
        total = collections.Counter()
        for w, places, impacts, _ in lists:
            for p, x in zip(places, impacts, strict=True):
                total[p] += w * x
        want = [(s, p) for s, p in sorted(((s, p) for p, s in total.items()), key=lambda e: (-e[0], e[1]))[:5]]
        assert lexical.merge(lists, 5) == want


def audited(docs, labels):
    """The contract by simulation, a document at a time."""
    good, toxic = collections.Counter(), collections.Counter()
    for d, q, t in labels:
        good[d], toxic[d] = max(good[d], int(q == 1)), max(toxic[d], int(t == 1))
    good[None] = toxic[None] = 0
    rows = []
    for d, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and any(e is not None and e < d and (x or "") == t for e, x, _ in docs)
        rows.append((part or "", fails, good[d], toxic[d]))
    out, removed_by = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed, kept = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                alone = [r for r in rows if r[0] == part and [x for x in r[1] if r[1][x]] == [f]]
                out[part, order, step] = [len(kept), len(removed), sum(r[1][f] for r in gone), len(alone), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                removed_by[part, f] += len(removed)
                left, gone = kept, gone + removed
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = [None, "", " \x0b ", "A B", "x " * 60, "word" + " w".join(map(str, range(70))), LONG[:4000], "É \x85 " * 55, "a$", *(" ".join(rng.choice(["AA", "b", "c%", f"n{i}"]) for i in range(rng.choice([10, 60]))) for _ in range(12))]
    docs = [(i, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(150)] + [(3, "A B", "s1"), (3, "A B", "s1"), (None, "A B", "s2"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, mask int, n int").repartition(4)
    found = filter_audit.cells(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(filter_audit.audit(found)) == audited(docs, labels)
    assert filter_audit.audit(filter_audit.cells(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0
    three = filter_audit.audit(filter_audit.cells(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"X": lambda x: x["text"] == "", "Y": lambda x: F.size(x["words"]) > 5}), "XYZ")
    assert three.count() == 3 * 6 * 3 and three.agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.audit(found, "AAB")


def exact(rows, asked, k):
    out = []
    for q, v in asked:
        near = sorted({(-float(np.dot(v, x)), i) for i, x in rows if i != q and len(x) == len(v)})
        seen, r = set(), 0
        for s, i in near:
            if i not in seen and r < k:
                seen.add(i)
                r += 1
                out.append((q, r, i, -s))
    return out


def test_graph_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24)) * 2
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))
    x[::50] *= 6  # lengths differ
    x[100:400] = x[100]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = graph_search.nearest(df, df.where("vec_id % 20 = 0"), 20, g=graph_search.Graph(shard=700, queries=64)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    want = collections.defaultdict(list)
    for q, _, i, s in exact(rows, asked, 20):
        want[q].append((i, s))
    hits = 0
    for q, v in asked:
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - np.dot(v, rows[r.vec_id][1])) < 1e-9 and r.vec_id != q for r in mine)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in itertools.pairwise(mine))
        hits += len({r.vec_id for r in mine} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 20 * len(asked)


def test_graph_search_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1e200, 1e200]), (9, [3.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (11, [-0.0, 5.0]), (12, [0.0, 5.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, rank string")
    got = graph_search.nearest(df, df, 20)
    by = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert by[0] == [(7, 1.0), (11, 0.0), (12, 0.0), (8, -1e200)]
    assert by[7] == [(0, 1.0), (11, 0.0), (12, 0.0), (8, -1e200)]
    assert by[11] == [(8, 1e200 * 5), (12, 25.0), (0, 0.0), (7, 0.0)]
    assert set(by) == {0, 7, 8, 11, 12}
    assert graph_search.nearest(df.limit(0), df, 5).count() == 0 and graph_search.nearest(df, df.limit(0), 5).count() == 0


def test_pruned_edges_are_diverse():
    rng = np.random.default_rng(4)
    p = graph_search.on_sphere(rng.normal(size=(300, 8)))
    edges, starts = graph_search.build_graph(p, graph_search.Graph(degree=12, batch=32))
    apart = lambda a, b: max(0.0, 2 - 2 * float(p[a] @ p[b]))
    found = np.arange(1, 300)[None, :]
    kept = [int(x) for x in graph_search.pruned(p, np.array([0]), found, 12, 1.2)[0] if x >= 0]
    want = []
    for c in sorted(range(1, 300), key=lambda c: apart(0, c)):
        if len(want) < 12 and all(1.44 * apart(c, w) > apart(0, c) for w in want):
            want.append(c)
    assert kept == want
    seen, todo = set(starts.tolist()), starts.tolist()
    while todo:
        new = {int(x) for x in edges[todo].ravel() if x >= 0} - seen
        seen |= new
        todo = list(new)
    assert len(seen) == 300 and (edges != np.arange(300)[:, None]).all()


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "all rights reserved"), (2, None)], "doc_id long, `a.b` string")
    import public_tokenizers

    from recallix.llm import bpe, licenses

    got = bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.json"), text="a.b").collect()
    assert sorted(r.n_tokens for r in got)[0] == 0 and len(got) == 2
    assert {r.doc_id: r.n_base for r in licenses.scan_licenses(df, text="a.b").collect()} == {1: 1, 2: 0}
