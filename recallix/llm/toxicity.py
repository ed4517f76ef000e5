"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and what each saves on the
windows of a text.

The ordinary dictionary is trained on windows of ordinary text. Toxic dictionaries are trained on those spans of toxic
text whose byte strings toxic documents have far more often than ordinary ones; each lies before the ordinary
dictionary's content, so that what all texts have in common compresses alike and the difference of two lengths comes
from the toxic part. A second one is trained on the toxic documents that the first leaves unseen. A window's lengths
under the dictionaries, where it holds a string that only a toxic one has, are compared with calibrated thresholds, and a document's score is a logistic curve over the
numbers and shares of windows beyond them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, logistic, predict, quoted, short_batches, strings, with_struct

#: Bytes of a half window; a window is two neighbouring halves, so that each byte but the first and last is in two.
HALF = 48
_CUT = re.compile(rb".{1,%d}(?: |$)|.{%d}" % (HALF, HALF), re.S)
_SPACE = re.compile(rb"\s+")
#: Bytes of the shortest match that is taken from a dictionary, and windows that are looked at together.
MATCH, RUN = 4, 1 << 14
#: Bytes of the strings that toxic and ordinary text are contrasted by.
GRAM = 6
#: Gains in bytes that are counted, and the pairs of them that calibration chooses from.
GAINS = (1, 2, 3, 4, 5)
PAIRS = ((1, 3), (2, 3), (2, 4), (3, 5))


@dataclass(frozen=True)
class ToxicityModel:
    """What a fit leaves: the ordinary dictionary's content, the toxic ones', the calibrated gains, the score's curve."""

    ordinary: bytes
    toxic: tuple[bytes, ...]
    gains: tuple[int, int]
    curve: tuple


def folded(text: str) -> bytes:
    """Lower case, white space as single spaces, one at either end."""
    return b" " + _SPACE.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip(b" ") + b" "


def windows(data: bytes) -> Iterator[bytes]:
    """Overlapping windows of at most 2 * HALF + 2 bytes over folded text, cut after spaces where there are any."""
    start = middle = 0
    for m in _CUT.finditer(data):
        if middle:
            yield data[start : m.end()]
        start, middle = middle, m.end()
    if not start and middle:
        yield data[:middle]


def own_strings(toxic: bytes, ordinary: bytes) -> set[bytes]:
    """The shortest strings, of MATCH bytes or more, that begin in a toxic dictionary and are not in the ordinary one that
    follows it. A window without any gains nothing: its matches are as long in the ordinary part, which is nearer."""
    whole, out = toxic + ordinary[: 2 * HALF + 2], set()
    for i in range(len(toxic)):
        n = MATCH
        while n <= len(whole) - i and whole[i : i + n] in ordinary:
            n += 1
        if n <= len(whole) - i:
            out.add(whole[i : i + n])
    return out


def pattern(strings: set[bytes]) -> str:
    return "|".join("".join(f"\\x{b:02x}" for b in x) for x in sorted(strings))


class Lengths:
    """Compressed lengths of windows: under the ordinary dictionary, and under each toxic one with it."""

    def __init__(self, ordinary: bytes, toxic: tuple[bytes, ...]):
        self.params = params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=6, min_match=MATCH, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.held = [zstandard.ZstdCompressionDict(x + ordinary or b" " * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (b"", *toxic)]
        for d in self.held:
            d.precompute_compress(compression_params=params)
        self.own = [pattern(own_strings(x, ordinary)) for x in toxic]
        self.by = [zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress for d in self.held]

    def of(self, window: bytes) -> list[int]:
        return [len(c(window)) for c in self.by]

    def counts(self, text: str) -> np.ndarray:
        return self.all_counts([text])[0]

    def all_counts(self, texts: list[str]) -> np.ndarray:
        """A row for each text: windows, then for each toxic dictionary the windows that gain GAINS bytes or more, and
        all gains (8 a window at most)."""
        number, seen = np.zeros(len(texts)), np.zeros((len(texts), len(self.own), 9))
        held: list[bytes] = []
        at: list[int] = []
        for i, x in enumerate(texts):
            cut = windows(folded(x))
            while part := list(islice(cut, RUN)):
                number[i] += len(part)
                held += part
                at += [i] * len(part)
                if len(held) >= RUN:
                    self._gains(held, at, seen)
                    held, at = [], []
        self._gains(held, at, seen)
        out = [number]
        for d in range(len(self.own)):
            out += [seen[:, d, g:].sum(1) for g in GAINS] + [seen[:, d] @ np.arange(9.0)]
        return np.stack(out, axis=1)

    def _gains(self, held: list[bytes], at: list[int], seen: np.ndarray) -> None:
        """Count the gains of windows, whose texts are numbered by `at`."""
        base, *rest = self.by
        column, before = pa.array(held, pa.large_binary()), {}
        for d, (own, c) in enumerate(zip(self.own, rest, strict=True)):
            for i in np.flatnonzero(pc.match_substring_regex(column, own)).tolist() if own else ():
                w = held[i]
                if i not in before:
                    before[i] = len(base(w))
                gain = before[i] - len(c(w))
                if gain > 0:
                    seen[at[i], d, min(gain, 8)] += 1


@functools.lru_cache(maxsize=2)
def lengths_of(ordinary: bytes, toxic: tuple[bytes, ...]) -> Lengths:
    return Lengths(ordinary, toxic)


def columns(counts: np.ndarray, gains: tuple[int, int]) -> np.ndarray:
    """What the curve sees: for each dictionary and gain the number and share of windows, for each the mean gain."""
    n = counts[:, 0]
    out = [np.log1p(n)]
    for at in range(1, counts.shape[1], len(GAINS) + 1):
        for g in gains:
            hits = counts[:, at + GAINS.index(g)]
            out += [np.log(hits + 0.3) - np.log(n + 8), np.log1p(hits), hits > 0]
        out.append(np.log(counts[:, at + len(GAINS)] + 0.5) - np.log(n + 8))
    return np.array(out, float).T


def grams(data: bytes) -> np.ndarray:
    """The strings of GRAM bytes at each place, as numbers."""
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | a[i : len(out) + i]
    return out


def telling_spans(toxic: list[bytes], ordinary: list[bytes], least: int = 4, ratio: float = 8.0, deviations: float = 8.0) -> list[bytes]:
    """The distinct spans of each toxic text made of strings that `least` toxic texts have or more, and that are `ratio`
    times as frequent there as in ordinary text, by that many deviations."""
    per_text = [np.unique(grams(x), return_counts=True) for x in toxic]
    if not per_text:
        return []
    keys, at = np.unique(np.concatenate([k for k, _ in per_text]), return_inverse=True)
    texts = np.bincount(at, minlength=len(keys))
    times = np.bincount(at, weights=np.concatenate([n for _, n in per_text]), minlength=len(keys))
    others, all_others = np.zeros(len(keys)), 0
    for x in ordinary:
        g = grams(x)
        all_others += len(g)
        i = np.minimum(np.searchsorted(keys, g), len(keys) - 1) if len(keys) else np.zeros(0, int)
        others += np.bincount(i[keys[i] == g], minlength=len(keys)) if len(keys) else 0
    n1, n0 = max(1.0, times.sum()), max(1, all_others)
    expected = (times + others) * n1 / (n1 + n0)
    beyond = (times - expected) / np.sqrt(expected * n0 / (n1 + n0) + 1e-9)
    good = keys[(texts >= least) & (times / n1 > ratio * (others + 1) / n0) & (beyond > deviations)]
    out = []
    for x in toxic if len(good) else ():
        g = grams(x)
        i = np.minimum(np.searchsorted(good, g), len(good) - 1)
        edge = np.zeros(len(x) + 1, int)
        hits = np.flatnonzero(good[i] == g)
        edge[hits] += 1
        edge[hits + GRAM] -= 1
        inside = np.r_[0, (np.cumsum(edge)[: len(x)] > 0).astype(int), 0]
        ends = np.flatnonzero(np.diff(inside))
        out += sorted({x[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)})
    return out


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of zstandard's trained dictionary of about `size` bytes, without its tables; the samples themselves
    where they are too few to train on."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]
    head = whole.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0", 8)  # the last words before the content
    return whole[head + 12 :] if head > 0 else whole


def ordinary_dictionary(ordinary: list[str], size: int = 16_384, most: int = 30_000, seed: int = 5) -> bytes:
    """Trained on at most `most` windows of ordinary texts, drawn at random."""
    cut = [w for x in ordinary for w in windows(folded(x))]
    chosen = np.random.default_rng(seed).permutation(len(cut))[:most]
    return trained([cut[i] for i in chosen], size, 32)


def toxic_dictionaries(base: bytes, toxic: list[str], ordinary: list[str], size: int = 1024) -> tuple[bytes, ...]:
    """Two dictionaries; the second from the toxic texts that under the first have no larger a share of gaining windows
    than ordinary texts (0.95 of the first 500)."""
    fine, found, left = [folded(x) for x in ordinary], [], toxic
    for _ in range(2):
        spans = telling_spans([folded(x) for x in left], fine)
        found.append(trained(spans, size, 16) if spans else b"")
        lengths = Lengths(base, (found[-1],))
        share = lambda xs: (c := lengths.all_counts(xs))[:, 2] / np.maximum(c[:, 0], 1)  # noqa: B023, E731
        usual = np.quantile(share(ordinary[:500]), 0.95)
        left = [x for x, k in zip(left, share(left), strict=True) if k <= usual]
    return tuple(found)


def fit_curve(counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[int, int], tuple]:
    """The pair of gains whose curve fits labelled documents best, its loss first, and that curve."""
    best = None
    for gains in PAIRS:
        x = columns(counts, gains)
        curve = logistic(x, y, weight)
        p = np.clip(predict(curve, x), 1e-4, 1 - 1e-4)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if best is None or loss < best[0] * 0.99:
            best = (loss, gains, curve)
    return best


def flat(share: float) -> ToxicityModel:
    """A model without dictionaries: one score for all texts."""
    at = float(np.log(np.clip(share, 0.001, 0.999) / (1 - np.clip(share, 0.001, 0.999))))
    return ToxicityModel(b"", (), PAIRS[0], (np.zeros(1), np.ones(1), np.array([0.0, at])))


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    """The score of each text, 0 to 1."""
    if not texts:
        return np.zeros(0)
    lengths = lengths_of(model.ordinary, model.toxic)
    return predict(model.curve, columns(lengths.all_counts(texts), model.gains))


def sampled(df: DataFrame, labels: DataFrame, rows: int, key: str, text: str, label: str) -> DataFrame:
    """(key, text, y, of) of at most about `rows` rows of each label whose crc32(key as text) mod 3 is not 1; of is the
    number of the label's rows that they stand for. Keys with labels of both kinds, null labels and null texts are left out."""
    k = F.col(quoted(key))
    own = labels.where(F.col(quoted(label)).isin(0, 1)).groupBy(k.alias("key")).agg(F.min(quoted(label)).alias("y"), F.max(quoted(label)).alias("z")).where("y = z")
    own = own.where(F.crc32(F.col("key").cast("string").cast("binary")) % 3 != 1).select("key", "y")
    parts = []
    for y in (0, 1):
        kind = own.where(F.col("y") == y)
        parts.append(bounded_sample(kind, "key", rows).withColumn("of", F.lit(kind.count())))
    chosen = parts[0].unionByName(parts[1])  # at most about 2.4 times rows keys: small enough to broadcast
    texts = df.where(F.col(quoted(text)).isNotNull()).select(k.alias("key"), F.col(quoted(text)).alias("text"))
    return texts.join(F.broadcast(chosen), "key")


def train(df: DataFrame, labels: DataFrame, rows: int = 2000, part: int = 2048, parts: int = 4, folds: int = 3, sizes: tuple[int, ...] = (8192, 16_384), positive: float = 1.0, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most about `rows` labelled rows of each label whose crc32(key as text) mod 3 is not 1.

    The dictionaries are trained on the driver, from those rows' texts; of a text of over part * parts characters, from
    as many parts of that length, evenly spread. The curve is fitted to counts over the rows' whole texts, which the
    executors take, each fold under toxic dictionaries of the other folds, so that no row is judged by its own spans;
    only the counts come back, and they choose the ordinary dictionary's size too. A row of label 1 weighs `positive` times one of label 0. Without rows of both labels the
    score is one number for all texts.
    """
    short_batches(df.sparkSession)
    some = sampled(df, labels, rows, key, text, label).withColumn("fold", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(folds)).cast("int"))
    n, most = F.length("text"), part * parts
    spread = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(F.col("text"), (i * (n - part) / (parts - 1)).cast("int") + 1, F.lit(part)))
    got = some.select("key", F.when(n > most, spread).otherwise(F.array("text")).alias("text"), "y", "fold").toPandas().sort_values(["key", "y"], kind="stable")
    y, fold = got["y"].to_numpy(dtype=float), got["fold"].to_numpy()
    if not len(y) or y.min() == y.max():
        return flat(float(y.mean()) if len(y) else 0.0)
    texts = [" ".join(x) for x in got["text"]]
    of = lambda label, but=None: [x for x, k, f in zip(texts, y, fold, strict=True) if k == label and f != but]
    bases = [ordinary_dictionary(of(0), size) for size in sizes]
    apart = [[toxic_dictionaries(base, of(1, f), of(0, f) or of(0)) for f in range(folds)] for base in bases]

    @F.arrow_udf("array<double>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by = [[Lengths(base, x) for x in own] for base, own in zip(bases, apart, strict=True)]
        for batch, of_fold in batches:
            texts, fold = strings(batch), of_fold.to_numpy()
            out = np.zeros((len(texts), len(by) * (1 + 2 * (len(GAINS) + 1))))
            for f in range(folds):
                at = np.flatnonzero(fold == f)
                out[at] = np.concatenate([own[f].all_counts([texts[i] for i in at]) for own in by], axis=1)
            yield pa.array(out.tolist(), pa.list_(pa.float64()))

    seen = some.select("key", "y", "of", count.asNondeterministic()(F.col("text"), F.col("fold")).alias("c")).toPandas().sort_values(["key", "y"], kind="stable")
    y, rows_of = seen["y"].to_numpy(dtype=float), seen["of"].to_numpy(dtype=float)
    weight = rows_of / np.where(y == 1, y.sum(), len(y) - y.sum()) * np.where(y == 1, positive, 1.0)
    counts = np.split(np.array(seen["c"].tolist(), float), len(sizes), axis=1)
    fits = [(*fit_curve(c, y, weight / weight.mean()), base) for c, base in zip(counts, bases, strict=True)]
    _, gains, curve, base = min(fits, key=lambda x: x[0])
    return ToxicityModel(base, toxic_dictionaries(base, of(1), of(0)), gains, curve)


def score(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", cut: float = 0.7) -> DataFrame:
    """Add held_out (crc32(key as text) mod 3 is 1), score (0 to 1) and predicted (1 if score >= cut) to every row.

    The whole text is scored and nothing else is looked at. Null counts as empty; empty texts get the score of one
    window of spaces. Repeated rows score alike; extra columns stay; columns of df with the names of the new ones are
    replaced. A null key is not held out. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scores(strings(batch), model), pa.float64())

    held = F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = with_struct(df, F.struct(held.alias("held_out"), run.asNondeterministic()(F.col(quoted(text))).alias("score")), ["held_out", "score"])
    return out.drop("predicted").withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
