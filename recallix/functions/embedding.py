"""Hash functions of texts and the synthetic embedding, as Arrow functions over canonical tokens."""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EMBED_WEIGHT
from .text import HEAD, SYNONYMS, canonical_counts, canonical_list


def _units(text: str) -> list[int]:
    """UTF-16 code units, over which the hashes run."""
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for u in _units(text):
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return h


def mixed(text: str, seed: int = 0xDEADBEEF) -> int:
    h = seed
    for u in _units(text):
        h = (h ^ u) * 0x5BD1E995 & 0xFFFFFFFF
        h ^= h >> 13
    return h


def times_31(tokens: list[str]) -> np.ndarray:
    """Multiply-by-31 hashes of tokens' code units in 32 bits, a unit of all tokens at a time."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in sorted(tokens, key=len, reverse=True)]
    size = np.array([len(r) // 2 for r in raw])
    by = np.argsort(-size, kind="stable")  # a letter may have two units
    units, starts = np.frombuffer(b"".join(raw), "<u2").astype(np.uint32), (np.cumsum(size) - size)[by]
    h = np.zeros(len(raw), np.uint32)
    left = len(raw) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0))), "right")
    for i, k in enumerate(left.tolist()):
        h[:k] = h[:k] * np.uint32(31) + units[starts[:k] + i]
    return h


def token_votes(tokens: Iterable[str]) -> str:
    """32 majority votes over the tokens' multiply-by-31 hashes as eight hex digits, low bits first, written twice."""
    hashes = times_31(list(dict.fromkeys(tokens)))
    bits = (hashes.astype(np.uint64)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    up = 2 * bits.sum(0) > len(hashes)
    half = "".join(f"{int(sum(8 >> j for j in range(4) if up[i + j])):x}" for i in range(0, 32, 4))
    return half * 2


#: The simhash of no tokens, where all texts without any are to be one.
NO_BITS = "0" * 16


def simhash(text: Column, bare: str | None = None) -> Column:
    """Hash of a text's distinct canonical tokens; without tokens, `bare` or a hash of the text itself. Null gives null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for x in texts.to_pylist():
                t = canonical_counts(x)
                out.append(None if x is None else token_votes(t) if t else bare or hashlib.blake2b(x.encode()).hexdigest()[:16])
            yield pa.array(out, pa.string())

    return run.asNondeterministic()(text)


def _prefix(text: str) -> tuple[int, int]:
    return fnv1a(text), mixed(text)


@functools.lru_cache(maxsize=8)
def _waves(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first fifty positions: where a wave adds, and its sines and cosines."""
    at = np.arange(50) % dim
    angles = [i / 10000 ** (2 * int(x) / dim) for i, x in enumerate(at)]
    return at, np.array([math.sin(x) for x in angles]), np.array([math.cos(x) for x in angles])


class _Features:
    """Features of many texts as stretches of one array of code units, so that all are hashed side by side."""

    def __init__(self):
        self.units, self.size, self.seeds, self.starts, self.lengths = [], 0, [], [], []
        self.known: dict[str, tuple[int, int]] = {}

    def put(self, text: str) -> int:
        """Where the units of a text begin."""
        raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        self.units.append(raw)
        self.size += len(raw)
        return self.size - len(raw)

    def seed(self, prefix: str) -> np.ndarray:
        return np.array(self.known.get(prefix) or self.known.setdefault(prefix, _prefix(prefix)), np.uint32)

    def add(self, prefix: str, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.add_each(np.broadcast_to(self.seed(prefix), (len(starts), 2)), starts, lengths)

    def add_each(self, seeds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.seeds.append(seeds)
        self.starts.append(starts)
        self.lengths.append(lengths)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """fnv1a() and mixed() of each feature, a code unit of all at a time; the longest features stand first."""
        units = np.concatenate([*self.units, np.zeros(0, np.uint16)]).astype(np.uint32)
        starts, lengths = np.concatenate(self.starts), np.concatenate(self.lengths)
        by = np.argsort(-lengths, kind="stable")
        starts, (h, g) = starts[by], np.concatenate(self.seeds)[by].T.copy()
        left = len(starts) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
        for i, k in enumerate(left.tolist()):
            u = units[starts[:k] + i]
            h[:k] = (h[:k] ^ u) * np.uint32(16777619)
            x = (g[:k] ^ u) * np.uint32(0x5BD1E995)
            g[:k] = x ^ x >> np.uint32(13)
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        return h[back], g[back]


def synthetic_many(rows: list[tuple[list[str], str]], dim: int) -> list[np.ndarray]:
    """Signed feature hashing of tokens, their character triples and quadruples, neighbours, positions and length, for
    many (tokens, sector)."""
    f, weights = _Features(), []
    for tokens, sector in rows:
        if not tokens:
            weights.append(None)
            continue
        sw, distinct = EMBED_WEIGHT.get(sector, 1.0), list(dict.fromkeys(tokens))
        n = len(distinct)
        w = (math.log(1 + n) / n + 1) * sw
        size = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in distinct])
        at = f.put("_".join(distinct)) + np.cumsum(size + 1) - size - 1
        # each token's own stretches in turn: itself, its triples, its quadruples
        number = 1 + np.maximum(0, size - 2) + np.maximum(0, size - 3)
        owner = np.repeat(np.arange(n), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        triples = np.maximum(0, size - 2)[owner]
        kind = np.where(place == 0, 0, np.where(place <= triples, 1, 2))
        start = at[owner] + np.where(kind == 0, 0, np.where(kind == 1, place - 1, place - 1 - triples))
        length = np.where(kind == 0, size[owner], kind + 2)
        own = [np.array([w, w * 0.4, w * 0.3])[kind]]
        seeds = np.array([f.known.get(p) or f.known.setdefault(p, _prefix(p)) for p in (f"{sector}|tok|", f"{sector}|c3|", f"{sector}|c4|")], np.uint32)
        f.seeds.append(seeds[kind])
        f.starts.append(start)
        f.lengths.append(length)
        m, wide = len(tokens), dict(zip(distinct, size.tolist(), strict=True))
        sizes = np.array([wide[t] for t in tokens])
        starts = f.put("_".join(tokens)) + np.cumsum(sizes + 1) - sizes - 1
        ends = starts + sizes
        if m > 1:
            f.add(f"{sector}|bi|", starts[:-1], ends[1:] - starts[:-1])
            own.append(1.4 * sw / (1 + np.arange(m - 1) * 0.1))
        if m > 2:
            f.add(f"{sector}|tri|", starts[:-2], ends[2:] - starts[:-2])
            own.append(np.full(m - 2, sw))
            skips = [f"{tokens[i]}_{tokens[i + 2]}" for i in range(min(m - 2, 20))]
            lengths = sizes[: len(skips)] + sizes[2 : len(skips) + 2] + 1
            f.add(f"{sector}|skip|", f.put("".join(skips)) + np.cumsum(lengths) - lengths, lengths)
            own.append(np.full(len(skips), 0.7 * sw))
        for prefix, text, share in (("len", str(min(int(math.log2(n + 1)), 10)), 0.6), ("dens", "10", 0.5)):
            f.add(f"{sector}|{prefix}|", np.array([f.put(text)]), np.array([len(text)]))
            own.append(np.array([share * sw]))
        weights.append((np.concatenate(own), min(m, 50), 0.5 * sw / math.log(1 + n)))
    h, g = f.hashes() if f.starts else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    out, low = [], 0
    for row in weights:
        if row is None:
            out.append(np.full(dim, 1 / math.sqrt(dim), np.float32))
            continue
        w, m, part = row
        mine = slice(low, low + len(w))
        low += len(w)
        at = np.stack([h[mine] % dim, g[mine] % dim], 1)
        value = np.where(h[mine] & 1, -w, w)
        value = np.stack([value, value * 0.5], 1).astype(np.float32)
        v = np.zeros(dim, np.float32)
        np.add.at(v, at[:-2].ravel(), value[:-2].ravel())
        wave, sin, cos = (x[:m] for x in _waves(dim))
        np.add.at(v, np.stack([wave, (wave + 1) % dim], 1).ravel(), np.stack([part * sin, part * cos], 1).astype(np.float32).ravel())
        np.add.at(v, at[-2:].ravel(), value[-2:].ravel())
        norm = math.sqrt(float((v.astype(np.float64) ** 2).sum()))
        out.append(v / np.float32(norm) if norm else v)
    return out


def plain_many(rows: list[tuple[list[str], str]], dim: int) -> list[np.ndarray]:
    """The smaller variant for many (tokens, sector): tokens with their synonyms, character triples, pairs of neighbours
    and positions."""
    f, weights = _Features(), []
    for tokens, sector in rows:
        if not tokens:
            weights.append(None)
            continue
        every = [x for t in tokens for x in (t, *_OTHERS.get(t, ()))]
        n, sw, counts = len(every), EMBED_WEIGHT.get(sector, 1.0), Counter(every)
        of = {c: (c / n * math.log(1 + n / c) + 1) * sw for c in set(counts.values())}
        w = np.array([of[c] for c in counts.values()])
        size = np.array([_wide(t) for t in counts])
        at = f.put("_".join(counts)) + np.cumsum(size + 1) - size - 1
        # each token's own stretches in turn: itself, its triples
        number = 1 + np.maximum(0, size - 2)
        owner = np.repeat(np.arange(len(size)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        part = place > 0
        f.add_each(np.where(part, f.seed(f"{sector}|c3|")[:, None], f.seed(f"{sector}|tok|")[:, None]).T, at[owner] + np.where(part, place - 1, 0), np.where(part, 3, size[owner]))
        own, m = [np.where(part, w[owner] * 0.4, w[owner])], len(tokens)
        if m > 1:
            sizes = np.array([_wide(t) for t in tokens])
            starts = f.put("_".join(tokens)) + np.cumsum(sizes + 1) - sizes - 1
            f.add(f"{sector}|bi|", starts[:-1], starts[1:] + sizes[1:] - starts[:-1])
            own.append(1.4 * sw / (1 + np.arange(m - 1) * 0.1))
        weights.append((np.concatenate(own), min(m, 50), 0.5 * sw / math.log(1 + n)))
    h, g = f.hashes() if f.starts else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    out, low = [], 0
    for row in weights:
        if row is None:
            out.append(np.full(dim, 1 / math.sqrt(dim), np.float32))
            continue
        w, m, part = row
        mine = slice(low, low + len(w))
        low += len(w)
        value = np.where(h[mine] & 1, -w, w)
        v = np.zeros(dim, np.float32)
        np.add.at(v, np.stack([h[mine] % dim, g[mine] % dim], 1).ravel(), np.stack([value, value * 0.5], 1).astype(np.float32).ravel())
        wave, sin, cos = (x[:m] for x in _waves(dim))
        np.add.at(v, np.stack([wave, (wave + 1) % dim], 1).ravel(), np.stack([part * sin, part * cos], 1).astype(np.float32).ravel())
        norm = np.linalg.norm(v)
        out.append(v / norm if norm else v)
    return out


#: What stands beside a token that heads a group of synonyms.
_OTHERS = {g[0]: [HEAD.get(x, x) for x in g] for g in SYNONYMS}


def _wide(token: str) -> int:
    return len(token) if token.isascii() else len(token.encode("utf-16-le", "surrogatepass")) // 2


def synthetic(tokens: list[str], sector: str, dim: int) -> np.ndarray:
    return synthetic_many([(tokens, sector)], dim)[0]


def vectors_of(rows: Iterable[tuple[str | None, str]], dim: int, most: int = 20_000, many=synthetic_many) -> Iterator[np.ndarray]:
    """synthetic(), or what many gives, of (text, sector), hashed together in runs of about so many tokens."""
    run, held = [], 0
    for text, sector in rows:
        tokens = canonical_list(text)
        if run and held + len(tokens) > most:
            yield from many(run, dim)
            run, held = [], 0
        run.append((tokens, sector))
        held += len(tokens)
    yield from many(run, dim)


def synthetic_embedding(text: Column, sector: Column, dim: int = 256) -> Column:
    """array<float> of a text in a sector; a text without tokens has equal components. Null counts as empty."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sectors in batches:
            rows = [(x, s or "semantic") for x, s in zip(texts.to_pylist(), sectors.to_pylist(), strict=True)]
            out = list(vectors_of(rows, dim))
            flat = np.concatenate([np.zeros(0, np.float32), *out])
            yield pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * dim, pa.array(flat))

    return run.asNondeterministic()(text, sector)


def fingerprint(text: Column, dim: int = 32) -> Column:
    """A vector from a xorshift stream that the text's hash seeds, of length one."""

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            h, v = fnv1a(x or "") or 1, []
            for _ in range(dim):
                h ^= h << 13 & 0xFFFFFFFF
                h ^= h >> 17
                h ^= h << 5 & 0xFFFFFFFF
                v.append(h / 0xFFFFFFFF * 2 - 1)
            a = np.array(v)
            out.append((a / (np.linalg.norm(a) or 1)).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return run.asNondeterministic()(text)
