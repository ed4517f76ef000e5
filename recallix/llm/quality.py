"""Quality rules: exact rule statistics of a text, and an isolation forest over them.

The forest's path lengths tell how soon random splits set a document's statistics apart; short paths mean an anomalous
document. It grows on one half of a bounded sample of labelled rows: on the good ones, within the range of both kinds.
The path length below which a document goes is calibrated on the other half, which it has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, quoted, short_batches, strings, with_struct

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the forest sees; shares and a mean, none of which grows with the text.
FEATURES = ["symbol_share", "upper_share", "bang_share", "digit_share", "dup_line_share", "repeat_share", "word_length", "distinct_share"]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and the number of distinct words."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(ids) < 3:
        return 0, len(names)
    k = len(names)
    pair = ids[:-1] * k + ids[1:]
    if k < 2_000_000:
        triple = pair[:-1] * k + ids[2:]
    else:
        triple = np.unique(pair[:-1], return_inverse=True)[1].astype(np.int64) * k + ids[2:]
    order = np.sort(triple)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, k
    again = np.isin(triple, np.unique(twice))
    inside = np.zeros(len(ids), bool)
    for i in range(3):
        inside[i : len(ids) - 2 + i] |= again
    return int(inside.sum()), k


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = repeated_words(words)
    upper = len(_UPPER.findall(text))
    digits = sum(map(text.count, "0123456789"))
    some, c = max(n, 1), max(chars, 1)
    return [n, chars, symbols, dup, repeat], [symbols / some, upper / c, text.count("!") / some, digits / c, dup / max(lines, 1), repeat / some, chars / some, distinct / some]


@dataclass(frozen=True)
class Forest:
    """Isolation trees as arrays (tree, node): feature or -1 at a leaf, value, and a leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    cut: float

    def depth(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, v, p in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                k = f[node]
                inner = k >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(k, 0)] >= v[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += p[node]
        return total / max(len(self.feature), 1)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, every: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """An isolation forest over rows x. Any feature that varies in `every` is split, anywhere in its range there that
    the splits above leave, whether or not a node's own rows vary: what only other rows have lies in leaves of its own."""
    rng = np.random.default_rng(seed)
    height = int(np.ceil(np.log2(max(2, min(sample, len(x))))))
    size = 2 ** (height + 1) - 1
    feature, value, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), min(sample, len(x)), replace=False)], every.min(0), every.max(0))]
        while todo:
            node, d, rows, low, high = todo.pop()
            wide = np.flatnonzero(high > low)
            if d == height or len(rows) < 2 or not len(wide):
                path[t, node] = d + expected_path(len(rows))
                continue
            k = rng.choice(wide)
            cut = rng.uniform(low[k], high[k])
            feature[t, node], value[t, node] = k, cut
            right, below, above = rows[:, k] >= cut, high.copy(), low.copy()
            below[k] = above[k] = cut
            todo += [(2 * node + 1, d + 1, rows[~right], low, below), (2 * node + 2, d + 1, rows[right], above, high)]
    return Forest(feature, value, path, 0.0)


def calibrated(forest: Forest, x: np.ndarray, good: np.ndarray) -> Forest:
    """Set the path length below which a document goes: the one that separates labelled rows best, by the share of bad
    rows less five times the share of good ones; none goes where no cut gains anything."""
    d = forest.depth(x)
    bad, fine = np.sort(d[~good]), np.sort(d[good])
    if not len(bad) or not len(fine):
        return forest
    cuts = np.unique(d)
    cuts = np.r_[cuts, cuts[-1] + 1]
    lost = np.searchsorted(fine, cuts, "left") / len(fine)
    caught = np.searchsorted(bad, cuts, "left") / len(bad)
    gain = caught - 5 * lost
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return forest
    below = d[d < cuts[i]]
    cut = (below.max() + cuts[i]) / 2 if len(below) else cuts[i]
    return Forest(forest.feature, forest.value, forest.path, float(cut))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_statistics(df: DataFrame, text: str = "text", forest: Forest | None = None) -> DataFrame:
    """Add COUNTS, features (array of double, as FEATURES) and path_length (null without a forest) of whole texts."""
    short_batches(df.sparkSession)

    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,features:array<double>,path_length:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            both = [statistics(x) for x in strings(batch)]
            x = np.array([b[1] for b in both], float).reshape(-1, len(FEATURES))
            cols = [pa.array([b[0][i] for b in both], pa.int64()) for i in range(5)]
            depth = pa.array(forest.depth(x), pa.float64()) if forest else pa.nulls(len(both), pa.float64())
            yield pa.StructArray.from_arrays([*cols, pa.array([b[1] for b in both], pa.list_(pa.float64())), depth], [*COUNTS, "features", "path_length"])

    return with_struct(df, run.asNondeterministic()(F.col(quoted(text))), [*COUNTS, "features", "path_length"])


def train(df: DataFrame, labels: DataFrame, rows: int = 20_000, key: str = "doc_id", label: str = "quality", text: str = "text") -> Forest:
    """Grow on labelled good rows that pass the base rules and whose crc32(key as text) is even, and calibrate on rows of
    both kinds with odd ones (on all, where a half lacks a kind). At most about `rows` labelled rows, chosen by hash,
    have their statistics collected to the driver. Without good rows nothing is rejected."""
    k = F.col(quoted(key))
    own = labels.where(F.col(quoted(label)).isin(0, 1)).groupBy(k.alias("key")).agg(F.min(quoted(label)).alias("y"), F.max(quoted(label)).alias("z")).where("y = z").select("key", "y")
    own = bounded_sample(own, "key", rows)  # small enough to broadcast
    some = df.select(k.alias("key"), F.col(quoted(text)).alias("text")).join(F.broadcast(own), "key")
    half = F.crc32(F.col("key").cast("string").cast("binary")) % 2
    got = rule_statistics(some).where(~base_failed()).select("key", "features", "y", half.alias("half")).toPandas().sort_values(["key", "y"], kind="stable")
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES))
    good, odd = got["y"].to_numpy(dtype=float) == 1, got["half"].to_numpy(dtype=float) == 1
    if not good.any():
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), -1.0)
    if not (good & ~odd).any() or not (good & odd).any() or not (~good & odd).any():
        return calibrated(grow(x[good], x), x, good)
    return calibrated(grow(x[good & ~odd], x[~odd]), x[odd], good[odd])


def quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 20_000) -> DataFrame:
    """Add COUNTS, base_failed, path_length and kept to every row of df.

    kept is false where the base rules fail, else the forest's verdict. Null text counts as empty: no words,
    base_failed. Repeated rows are judged alike; extra columns stay, columns of df with the new names are replaced. An
    empty table gives an empty one; without labelled good rows only the base rules reject.
    """
    forest = train(df, labels, rows, key, text=text)
    out = rule_statistics(df.drop("base_failed", "kept"), text, forest).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("path_length") >= F.lit(forest.cut))).drop("features")
