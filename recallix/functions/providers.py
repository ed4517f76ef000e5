"""Embedders by name: the synthetic one, its variant, a local one from digests, and tiers that combine them. Remote ones
are put into the registry by the caller; an embedder that fails gives way to the next."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SECTORS
from .embedding import plain_many, synthetic, synthetic_many, vectors_of
from .passages import chunked
from .text import canonical_list

Embedder = Callable[[str, str, int], np.ndarray]
#: Fixed value: the dimension unless another is asked for.
DIMENSION = 1536


def by_features(text: str, sector: str, dim: int) -> np.ndarray:
    return synthetic(canonical_list(text), sector, dim)


def by_digest(text: str, sector: str, dim: int) -> np.ndarray:
    """Pairs of neighbouring bytes of a digest of text and sector, of length one."""
    h = hashlib.sha256((text + sector).encode("utf-8", "surrogatepass")).digest()
    v = np.array([(h[i % 32] * 256 + h[(i + 1) % 32]) / 65535 * 2 - 1 for i in range(dim)])
    return v / np.linalg.norm(v)


def by_plain_features(text: str, sector: str, dim: int) -> np.ndarray:
    """The smaller variant: tokens with their synonyms, character triples, pairs of neighbours and positions."""
    return plain_many([(canonical_list(text), sector)], dim)[0]


REGISTRY: dict[str, Embedder] = {"synthetic": by_features, "plain": by_plain_features, "local": by_digest}
#: Embedders that take many (tokens, sector) at once.
MANY = {by_features: synthetic_many, by_plain_features: plain_many}


def bucketed(v: np.ndarray, n: int) -> np.ndarray:
    """n means over buckets with floor bounds, of length one; a vector of at most n components stays."""
    if len(v) <= n:
        return v
    ends = [i * len(v) // n for i in range(n + 1)]
    out = np.array([v[a:b].mean() if b > a else 0.0 for a, b in zip(ends, ends[1:], strict=False)])
    return out / (np.linalg.norm(out) or 1)


class Unavailable(RuntimeError):
    """What an embedder raises when it cannot answer just now; other errors are faults, and are not hidden."""


def answered(name: str, text: str, sector: str, dim: int, attempts: int = 3, wait: float = 1.0, sleep=time.sleep) -> np.ndarray | None:
    """A registered embedder's vector; asked again after twice as long each time while it is unavailable, at last none.
    A name that is not registered gives none."""
    for n in range(attempts if name in REGISTRY else 0):
        try:
            return np.asarray(REGISTRY[name](text, sector, dim), float)
        except Unavailable:
            if n + 1 < attempts:
                sleep(wait * 2**n)
    return None


def is_synthetic(tier: str, chain: tuple[str, ...]) -> bool:
    return tier in ("hybrid", "fast") or tier == "smart" and chain[0] == "synthetic"


def embedded(text: str, sector: str, tier: str = "hybrid", chain: tuple[str, ...] = ("synthetic",), dim: int = DIMENSION) -> np.ndarray:
    """A text's vector in a sector. hybrid and fast: the synthetic one; smart: 0.6 of it beside 0.4 of the chain's, in 128
    components; deep: the chain's. The first embedder of the chain that gives one counts, the synthetic one at last."""
    if sector not in SECTORS:
        raise ValueError(f"unknown sector: {sector}")
    if is_synthetic(tier, chain):
        return by_features(text, sector, dim)
    v = next((v for name in chain if (v := answered(name, text, sector, dim)) is not None), None)
    if v is None:
        v = by_features(text, sector, dim)
    if tier == "smart":
        v = np.concatenate([0.6 * by_features(text, sector, dim).astype(float), 0.4 * bucketed(v, 128)])
        return v / (np.linalg.norm(v) or 1)
    return v


def embedded_many(rows: list[tuple[str, str]], tier: str, chain: tuple[str, ...], dim: int) -> Iterator[np.ndarray]:
    """embedded() of many (text, sector), together where their embedder takes many."""
    if is_synthetic(tier, chain):
        return vectors_of(rows, dim)
    first = next((REGISTRY[name] for name in chain if name in REGISTRY), by_features)
    if tier == "smart" or first not in MANY:
        return (embedded(x, s, tier, chain, dim) for x, s in rows)
    return (v.astype(float) for v in vectors_of(rows, dim, many=MANY[first]))


def pooled(vectors: list[np.ndarray]) -> np.ndarray:
    """The mean of a text's chunks, as it is."""
    return np.mean(vectors, axis=0)


def embed_text(text: Column, sector: Column, tier: str = "hybrid", chain: tuple[str, ...] = ("synthetic",), dim: int = DIMENSION) -> Column:
    """array<float> of a text in a sector; a long text is the mean of its chunks. Null counts as empty."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sectors in batches:
            parts = [[x for x, _ in chunked(t or "")] or [""] for t in texts.to_pylist()]
            asked = [(x, s) for xs, s in zip(parts, sectors.to_pylist(), strict=True) for x in xs]
            if unknown := {s for _, s in asked}.difference(SECTORS):
                raise ValueError(f"unknown sectors: {sorted(map(str, unknown))}")
            found = iter(embedded_many(asked, tier, chain, dim))
            yield pa.array([pooled([next(found) for _ in xs]).astype(np.float32) for xs in parts], pa.list_(pa.float32()))

    return run.asNondeterministic()(text, sector)


def model_of(models: dict[str, dict[str, str]], sector: str, provider: str, given: dict[str, str] | None = None) -> str:
    """The model of a sector and provider: one given for the provider, the sector's, the semantic sector's, a default."""
    return (given or {}).get(provider) or models.get(sector, {}).get(provider) or models.get("semantic", {}).get(provider) or "nomic-embed-text"
