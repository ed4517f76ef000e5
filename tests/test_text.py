"""Golden cases and plain models of the text functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recallix.functions import compression, embedding, passages, text

GOLDEN = [
    ("昨天我参加了项目复盘会。", "episodic"),
    ("北京是中国的首都。", "semantic"),
    ("部署流程：第一步安装依赖，然后运行测试。", "procedural"),
    ("我最近很焦虑，也有点烦躁。", "emotional"),
    ("复盘后我意识到，沟通前应该先明确目标。", "reflective"),
    ("Yesterday I went to the park at 4:00 PM and saw a dog.", "episodic"),
    ("I am genuinely thrilled about how this project is shaping up.", "semantic"),
    ("To deploy: run npm run build, then npm start, then health-check.", "procedural"),
    ("I learn best when I write things down and revisit them later.", "episodic"),
    ("The capital of France is Paris.", "semantic"),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.c.primary for r in df.select("i", text.classify(F.col("t")).alias("c")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(GOLDEN)}


def test_classify_mixed_and_given(spark):
    df = spark.createDataFrame([("今天我被老板表扬了，感觉特别开心。", None), ("whatever", "procedural")], "t string, s string")
    a, b = [r.c for r in df.select(text.classify(F.col("t"), F.col("s")).alias("c")).collect()]
    assert a.primary == "emotional" and "episodic" in a.additional
    assert (b.primary, b.additional, b.confidence) == ("procedural", [], 1.0)


def test_tokens(spark):
    df = spark.createDataFrame([("我喜欢普洱茶",), ("The Running users' dogs, flies; 好",), ("",)], "t string")
    a, b, c = [r.x for r in df.select(text.tokens(F.col("t")).alias("x")).collect()]
    assert a == ["我喜", "喜欢", "欢普", "普洱", "洱茶"]
    assert b == ["the", "running", "users", "dogs", "flies", "好"] and c == []
    assert [r.x for r in df.select(text.canonical_tokens(F.col("t")).alias("x")).collect()][1] == ["the", "runn", "user", "dog", "fly"]


def test_python_tokens_are_the_same(spark):
    rows = ["我喜欢普洱茶 好", "The Running users' dogs, flies; liked prefer days 0x1s aing", "", None, "bees ingers passed"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.canonical_tokens(F.col("t")).alias("x")).collect()}
    assert {i: got[i] or [] for i in got} == {i: text.canonical_list(t) for i, t in enumerate(rows)}


def test_simhash(spark):
    df = spark.createDataFrame([("我喜欢健身",), ("我喜欢普洱茶",), ("!!!",), ("!!!",), ("???",)], "t string")
    a, b, c, c2, d = [r.h for r in df.select(embedding.simhash(F.col("t")).alias("h")).collect()]
    assert a != b and c == c2 and c != d and a[:8] == a[8:] and len({len(x) for x in (a, b, c, d)}) == 1
    h = spark.createDataFrame([(a, b)], "a string, b string").select(text.hamming(F.col("a"), F.col("b")).alias("n")).first().n
    assert h == 2 * bin(int(a[:8], 16) ^ int(b[:8], 16)).count("1")


def test_keywords_and_overlap(spark):
    df = spark.createDataFrame([("plans for cats", "the cats plan"), ("", "x y")], "a string, b string")
    r = df.select(text.keywords(F.col("a")).alias("k"), text.keyword_overlap(text.keywords(F.col("a")), text.keywords(F.col("b"))).alias("o")).collect()
    want = {"project", "pro", "roj", "oje", "jec", "ect", "for", "cat", "project_for", "for_cat", "project_for_cat"}
    assert set(r[0].k) == want and r[1].k == [] and r[1].o == 0
    assert r[0].o == pytest.approx(7 / (len(want) + 3))


def test_bm25(spark):
    q, c = ["a", "b", "a", "z"], ["a", "a", "c", "b"] * 10
    got = spark.createDataFrame([(q, c)], "q array<string>, c array<string>").select(text.bm25(F.col("q"), F.col("c")).alias("s")).first().s

    def one(tf):
        return math.log(10001 / (tf + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 0.4)) if tf else 0

    assert got == pytest.approx(sum(one(c.count(t)) for t in q))


def test_top_keywords(spark):
    df = spark.createDataFrame([("b x the b c x the the d",), ("",)], "t string")
    assert [r.k for r in df.select(text.top_keywords(F.col("t"), 3).alias("k")).collect()] == [["b", "x", "c"], []]


def test_compression(spark):
    t = "It is due to the fact that we really cannot stop. We cannot stop. we cannot stop. It is ( fine ) ; ok then."
    df = spark.createDataFrame([(t,), ("short",)], "t string")
    r = df.select(compression.semantic(F.col("t")).alias("a"), compression.syntactic(F.col("t")).alias("b"), compression.chosen(F.col("t")).alias("c")).collect()
    assert "because we" in r[0].a and r[0].a.count("cannot stop") == 2 and "really" not in r[0].a
    assert "can't stop" in r[0].b and "(fine);ok" in r[0].b
    assert r[1].a == r[1].b == "short" and r[1].c == "semantic"


def test_passages():
    rng = random.Random(3)
    body = "\n\n".join(" ".join("Word%d is here." % rng.randint(0, 99) for _ in range(rng.randint(1, 80))) for _ in range(12))
    got = passages.chunked(body, 100, 0.1)
    assert len(got) > 3 and all(len(t) <= 400 + 60 for t, _ in got) and got[0][1] == 0
    assert passages.chunked("small") == [("small", 0)]
    parts = passages.sections(body, 500)
    assert "".join(parts).replace("\n", "") == body.replace("\n", "")
    short = passages.essence(body, 200)
    assert len(short) <= 200 and passages.essence("x" * 300, 200) == "" and passages.essence("ab. " * 100, 50) == ("ab. " * 100)[:50]
    assert passages.summary("One cat sat. Two cats ran. A dog.").count(".") == 1


def test_embedding(spark):
    v = embedding.synthetic(["alpha", "beta", "gamma"], "semantic", 64)
    assert math.isclose(float((v.astype(float) ** 2).sum()), 1, rel_tol=1e-5)
    assert (embedding.synthetic([], "semantic", 16) == 0.25).all()
    assert embedding.fnv1a("a") == 0xE40C292C
    df = spark.createDataFrame([("dark mode", "semantic"), (None, None)], "t string, s string")
    a, b = [r.v for r in df.select(embedding.synthetic_embedding(F.col("t"), F.col("s"), 32).alias("v")).collect()]
    assert len(a) == len(b) == 32 and b[0] == pytest.approx(1 / math.sqrt(32))
