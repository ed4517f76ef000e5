"""N-gram Jaccard join: an LSH forest over MinHash signatures, then exact verification.

Texts become sets of five-word shingles. Copies (equal words in equal order) form a class, and one signature stands
for it. A signature is cut into trees of `depth` values each; a tree's sorted signatures are a prefix trie, in which
neighbours share their longest prefix. The sort is distributed and by range, so that no node of the trie has to lie in
one task. Links between neighbours that share a prefix of a length d are candidates; d is the longest at which a pair
just at the threshold is met with the recall aimed at, whatever other rows there are. Candidates form components, whose
members are compared with one another exactly, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, quoted, short_batches, strings
from .components import components


@dataclass(frozen=True)
class Forest:
    """Trees and values of each, the shingle's words, the similarity asked for and the recall aimed at."""

    trees: int = 20
    depth: int = 8
    start: int = 6
    floor: int = 4
    words: int = 5
    least: float = 0.8
    recall: float = 0.9999
    block: int = 400
    block_shingles: int = 1_500_000


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NAMES: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_NAMES) > 150_000:
        _NAMES.clear()
    known = _NAMES
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array([known[w] for w in words], np.uint64)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle of all its words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = (out ^ h[i : i + n]) * _MIX1
            out ^= out >> np.uint64(29)
        out *= _MIX2
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash: the least product per factor, of which 16 bits are kept."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            np.minimum(low, (x[None, i : i + 256] * factors[:, None]).min(1), out=low)
    return (low >> np.uint64(24)).astype(">u2")


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def signatures(df: DataFrame, key: str, text: str, forest: Forest) -> DataFrame:
    """(id, node, n, sig): node is a 128-bit digest of the words, n the number of shingles; without words node is null."""
    short_batches(df.sparkSession)
    factors = _factors(forest.trees * forest.depth)

    @F.arrow_udf("struct<node:binary,n:int,sig:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            node, n, sig = [], [], []
            for t in strings(batch):
                ws = words_of(t)
                x = shingles(ws, forest.words)
                node.append(digest(ws) if len(x) else None)
                n.append(len(x))
                sig.append(signature(x, factors).tobytes() if len(x) else None)
            yield pa.StructArray.from_arrays([pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["node", "n", "sig"])

    r = df.select(F.col(quoted(key)).alias("id"), run(F.col(quoted(text))).alias("_r"))
    return r.select("id", F.col("_r.node").alias("node"), F.col("_r.n").alias("n"), F.col("_r.sig").alias("sig"))


def trie_neighbours(classes: DataFrame, forest: Forest, n: int) -> DataFrame:
    """(a, b, shared): neighbours in the sorted tries and the length of the prefix that they share, floor at least."""
    wide = 2 * forest.depth
    # node last in the sort: equal prefixes may lie over several tasks
    trees = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * wide + 1, wide).alias("part")))
    rows = classes.select("node", F.explode(trees).alias("_t")).select(F.col("_t.tree").cast("int").alias("tree"), F.col("_t.part").alias("part"), "node")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "part", "node").sortWithinPartitions("tree", "part", "node")
    schema = "end int, tree int, part binary, a binary, b binary, shared int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, True

        def out(end, tree, part, a, b, shared):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array([end] * n, pa.int32()), pa.array(tree, pa.int32()), pa.array(part, pa.binary()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(shared, pa.int32())], ["end", "tree", "part", "a", "b", "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            parts_, node = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if first:
                yield out(0, tree[:1], parts_[:1], node[:1], [None], [None])
                first = False
            if last:
                tree, parts_, node = np.r_[last[0], tree], [last[1], *parts_], [last[2], *node]
            m = np.frombuffer(b"".join(parts_), ">u2").reshape(-1, forest.depth)
            same = np.cumprod(m[1:] == m[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
            hit = [i for i in np.flatnonzero(same >= forest.floor).tolist() if node[i] != node[i + 1]]
            if hit:
                yield out(None, [None] * len(hit), [None] * len(hit), [node[i] for i in hit], [node[i + 1] for i in hit], same[hit])
            last = (tree[-1], parts_[-1], node[-1])
        if last:
            yield out(1, [last[0]], [last[1]], [last[2]], [None], [None])

    found = cut_lineage(ordered.mapInArrow(scan, schema), forest.trees * n)
    # what meets where one range ends and the next begins: two rows a range, themselves in the tries' order
    ends = found.where("end IS NOT NULL").withColumn("_next", F.lead(F.struct("tree", "part", "a")).over(Window.orderBy("tree", "part", "a", "end")))
    # positions in bytes of two: equal values up to the first that differs
    equal = [F.substring("part", 1, 2 * d) == F.substring(F.col("_next.part"), 1, 2 * d) for d in range(1, forest.depth + 1)]
    shared = sum((F.when(e, 1).otherwise(0) for e in equal[1:]), F.when(equal[0], 1).otherwise(0))
    met = ends.where("tree = _next.tree").select("a", F.col("_next.a").alias("b"), shared.alias("shared")).where((F.col("shared") >= forest.floor) & (F.col("a") != F.col("b")))
    return found.where("end IS NULL").select("a", "b", "shared").unionByName(met)


def chance(s: float, d: int, trees: int) -> float:
    """That a pair of similarity s shares a prefix of length d in one tree at least."""
    return 1 - (1 - s**d) ** trees


def prefix_length(forest: Forest) -> int:
    """The longest prefix, from start down to floor, by which a pair of similarity least is met with the recall aimed
    at; the floor, with a warning, where none is. It depends on the trees alone, so no row decides whether others are
    found."""
    for d in range(forest.start, forest.floor - 1, -1):
        if chance(forest.least, d, forest.trees) >= forest.recall:
            return d
    warnings.warn(f"prefixes of {forest.floor} meet pairs at {forest.least} with a chance of {chance(forest.least, forest.floor, forest.trees):.6f} only", stacklevel=2)
    return forest.floor


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the incidence matrix in slices of columns."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    number = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(values)]))
    many = np.diff(np.r_[start, len(values)]) > 1
    keep = many[number]
    number, owner = (np.cumsum(many) - 1)[number[keep]], owner[keep]
    total = np.zeros((m, m), np.float64)
    columns = int(many.sum())
    step = max(256, 4_000_000 // max(m, 1))
    for lo in range(0, columns, step):
        i, j = np.searchsorted(number, [lo, lo + step])
        a = np.zeros((m, min(step, columns - lo)), np.float32)
        a[owner[i:j], number[i:j] - lo] = 1
        total += a @ a.T
    return total


def _verify(node: list[bytes], cross: bool, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], forest: Forest):
    """Links of one block pair, between its blocks (cross) or in one: per-node sums of linked copies, and a spanning forest."""
    n = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        inter = np.zeros((2, 2))
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        inter = overlaps(sets)
    # integers on both sides, so that a similarity of just the threshold counts
    num = round(forest.least * 1000)
    hit = 1000 * inter >= num * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(hit, False)
    if cross:
        hit &= side[:, None] != side[None, :]
    links = hit @ copies
    root = np.arange(len(node))
    a, b = np.nonzero(np.triu(hit))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
    top = [find(i) for i in range(len(node))]
    edges = [(node[i], node[t]) for i, t in enumerate(top) if i != t]
    return links, edges


def verified(df: DataFrame, key: str, text: str, members: DataFrame, forest: Forest, n: int) -> DataFrame:
    """Exact links inside the candidate components: rows (kind, a, b, value) of links ('n') and edges ('e')."""
    spark = df.sparkSession
    short_batches(spark)
    size = members.groupBy("label").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_m") / forest.block), F.ceil(F.col("_s") / forest.block_shingles)).cast("int")
    dealt = members.join(size.select("label", blocks.alias("_nb")), "label").withColumn("_h", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))

    @F.arrow_udf("struct<node:binary,set:binary>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ws = [words_of(t) for t in strings(batch)]
            yield pa.StructArray.from_arrays([pa.array([digest(w) for w in ws], pa.binary()), pa.array([shingles(w, forest.words).tobytes() for w in ws], pa.binary())], ["node", "set"])

    texts = df.select(F.col(quoted(key)).alias("rep"), F.col(quoted(text)).alias("_text"))
    got = dealt.join(texts, "rep").withColumn("_r", sets.asNondeterministic()(F.col("_text"))).where("_r.node = node")
    pair = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: F.struct(F.least(F.col("_h"), o).alias("i"), F.greatest(F.col("_h"), o).alias("j")))
    spread = got.select("label", "node", "copies", "_h", F.col("_r.set").alias("set"), F.explode(pair).alias("_p"))
    spread = spread.select("label", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "node", "copies", F.col("_h").alias("h"), "set")
    ordered = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done(rows):
            rows = list({r[4]: r for r in rows}.values())  # a repeated document gives its class twice
            if len(rows) < 2:
                return None
            node = [r[4] for r in rows]
            side = np.array([int(r[6] != r[1]) for r in rows])
            links, edges = _verify(node, at[1] != at[2], side, np.array([r[5] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows], forest)
            has = np.flatnonzero(links)
            a = [node[i] for i in has] + [e[0] for e in edges]
            if not a:
                return None
            b = [None] * len(has) + [e[1] for e in edges]
            v = [float(links[i]) for i in has] + [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(["n"] * len(has) + ["e"] * len(edges)), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(v, pa.float64())], ["kind", "a", "b", "value"])

        for batch in batches:
            for label, i, j, node, copies, h, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, i, j) != at:
                    if held and (out := done(held)):
                        yield out
                    held, at = [], (label, i, j)
                held.append((label, i, j, s, node, copies, h))
        if held and (out := done(held)):
            yield out

    return cut_lineage(ordered.mapInArrow(work, "kind string, a binary, b binary, value double"), n)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """(key, class_id, n_links, kept) for every row of df.

    Two documents are linked if their sets of five-word shingles (lower case, split at white space; a shorter text is
    one shingle) have a Jaccard similarity of forest.least or more. class_id is the smallest key that links reach,
    n_links the number of other documents linked directly (copies count each), kept says that key is class_id.
    Texts that are null or without words link with nothing, and rows with a null key have no class of their own: they
    are kept with no links. A link of similarity s is never compared with a chance of (1 - s^d)^trees at most, d being
    prefix_length(forest): 0.00003 at 0.8 with the default trees. Rows with one key and one text are each other's copies
    and both kept. An empty table gives an empty one; further columns are left out.
    """
    docs = cut_lineage(signatures(df, key, text, forest))
    n = docs.count()
    some = docs.where("node IS NOT NULL AND id IS NOT NULL")
    classes = cut_lineage(some.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), 4 * n)  # wide rows
    near = trie_neighbours(classes, forest, n)
    labels = components(near.where(F.col("shared") >= prefix_length(forest)).select("a", "b"), rows=n)
    members = classes.drop("sig").join(labels, classes["node"] == labels["id"]).select("node", "rep", "copies", "n", "label")
    found = verified(df, key, text, members, forest, n)
    groups = components(found.where("kind = 'e'").select("a", "b"), rows=n)
    links = found.where("kind = 'n'").groupBy("a").agg(F.sum("value").cast("bigint").alias("_links"))
    own = classes.select("node", "rep", "copies").join(groups, classes["node"] == groups["id"], "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("rep").alias("class_id"))
    table = own.join(least, "label").join(links, own["node"] == links["a"], "left").select("node", "class_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = docs.select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(table, "node", "left")
    linked = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(key), linked.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("id") == linked, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """df's rows, one document of each group of near duplicates (that with the smallest key); columns stay. Of rows
    with one key and one text, one stays (null counts as one text). Rows of one key with several texts are judged each by
    its own text: in one group the smallest hash stays, in several each group keeps its own. Rows with a null key all
    stay."""
    row = free_name(df, "row")
    k, t = F.col(quoted(key)), F.col(quoted(text))
    marked = df.withColumn(row, F.when(k.isNotNull(), F.struct(k.alias("key"), F.xxhash64(t).alias("hash"))))
    gone = near_duplicates(marked, row, text, forest).where("NOT kept").select(row).distinct()
    left = marked.join(gone, row, "left_anti").select(*[F.col(quoted(c)) for c in df.columns])
    again = df.where(k.isNotNull()).groupBy(k.alias("k"), F.xxhash64(t).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return left.where(k.isNotNull()).dropDuplicates([key, text]).union(df.where(k.isNull())) if again else left
