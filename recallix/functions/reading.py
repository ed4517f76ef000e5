"""Text analysis of the dashboard in Python, and its Arrow functions: key terms and phrases, sentences, density,
coherence and quality."""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import MARKERS
from .analysis import STOP_WORDS as _STOPS

_STOP = frozenset(_STOPS)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Bytes as they are where they are letters, digits or underscores, else spaces.
_APART = bytes(b if chr(b).isalnum() or b == 95 else 32 for b in range(128)) + b" " * 128
_CAPITAL, _RUN = re.compile("[A-Z]"), re.compile("[a-z0-9_]+")
_INDEX = re.compile(r"0|[1-9][0-9]*")
_ENTITIES = [re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", re.A), re.compile(r'"([^"]+)"'), re.compile(r"\b[A-Z]{2,}\b", re.A), re.compile(r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", re.A), re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", re.A)]
#: The first and third of these at once: no character is in matches of both, and a search for capitals is quick.
_CAPITALS = re.compile(r"[A-Z](?<!\w[A-Z])(?:[a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z]+)\b", re.A)


def words(text: str) -> list[str]:
    """Lower-case words of more than two letters, digits or underscores that are no stop words. All else parts them, so
    that other characters may be any mark."""
    return [w for w in text.lower().encode("ascii", "replace").translate(_APART).decode().split() if len(w) > 2 and w not in _STOP]


def ngrams(tokens: list[str], n: int) -> list[str]:
    return list(map(" ".join, zip(*(tokens[i:] for i in range(n)), strict=False)))


def _ranked(scores: dict[str, float], n: int) -> list[str]:
    """The n best, ties in order of entry; what looks like a number entered before all others, in order of size."""
    place = {k: (0, int(k)) if _INDEX.fullmatch(k) and int(k) < 2**32 - 1 else (1, i) for i, k in enumerate(scores)}
    return sorted(scores, key=lambda k: (-scores[k], place[k]))[:n]


def key_terms(text: str, n: int = 10) -> list[str]:
    """Words, pairs and triples by 1, 1.5 and 2 for each time they stand."""
    t, scores = words(text), {}
    for size, weight in ((1, 1.0), (2, 1.5), (3, 2.0)):
        for g in ngrams(t, size):
            scores[g] = scores.get(g, 0.0) + weight
    return _ranked(scores, n)


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if len(s) > 10]


def key_phrases(text: str, n: int = 5) -> list[str]:
    """Pairs and triples within sentences, by their length for each time, half as much again where a capital stands in
    or beside their first place in the text."""
    counts = Counter()
    for s in sentences(text):
        counts.update(phrases(s))
    ranked = sorted(enumerate((p, c * (1 + p.count(" "))) for p, c in counts.items()), key=lambda x: -x[1][1])
    capitals, lower, places, best = bool(_CAPITAL.search(text)), text.lower(), None, []
    for tried, (i, (phrase, score)) in enumerate(ranked):
        if len(best) == n and best[-1] < (-1.5 * score, i):  # no later one can be better
            break
        if tried == 64 and capitals:  # a search for each of many would grow with the square of the text
            places = first_places(lower, [p for _, (p, x) in ranked[tried:] if len(best) < n or 1.5 * x >= -best[-1][0]])
        if capitals:
            at = lower.find(phrase) if places is None else places.get(phrase, -1)
            score *= 1.5 if _CAPITAL.search(text, max(0, at - 1), max(0, at + len(phrase) + 1)) else 1.0
        insort(best, (-score, i, phrase))
        del best[n:]
    return [phrase for _, _, phrase in best]


def phrases(sentence: str) -> list[str]:
    """Pairs, then triples of a sentence's words."""
    t = words(sentence)
    return ngrams(t, 2) + ngrams(t, 3)


def first_places(lower: str, wanted: list[str]) -> dict[str, int]:
    """Where phrases of two or three words of a-z, 0-9 and _ first stand in a text: lower.find() of each, by one pass over
    the runs of such characters. The first word ends a run and the last one begins one."""
    apart = [p.split(" ") for p in wanted]
    heads, middles, tails = {p[0] for p in apart}, {p[1] for p in apart if len(p) > 2}, {p[-1] for p in apart}
    asked, out, ends, starts = set(wanted), {}, {}, {}

    def put(phrase: str, at: int) -> None:
        if phrase in asked and not 0 <= out.get(phrase, -1) <= at:
            out[phrase] = at

    runs = [(m.start(), m.end(), m[0]) for m in _RUN.finditer(lower)]
    for i in range(len(runs) - 1):
        (_, end, a), (start, stop, b) = runs[i], runs[i + 1]
        if start != end + 1 or lower[end] != " ":
            continue
        if a not in ends:
            ends[a] = [x for k in range(len(a)) if (x := a[k:]) in heads]
        if not ends[a]:
            continue
        if b not in starts:
            starts[b] = _begun(b, tails)
        last = []
        if b in middles and i + 2 < len(runs) and runs[i + 2][0] == stop + 1 and lower[stop] == " ":
            c = runs[i + 2][2]
            if c not in starts:
                starts[c] = _begun(c, tails)
            last = starts[c]
        for x in ends[a]:
            for y in starts[b]:
                put(f"{x} {y}", end - len(x))
            for y in last:
                put(f"{x} {b} {y}", end - len(x))
    return out


def _begun(run: str, words: set[str]) -> list[str]:
    return [x for k in range(1, len(run) + 1) if (x := run[:k]) in words]


def informative(text: str, n: int = 3) -> list[str]:
    """The n sentences that say most: distinct words by 0.4, all by 0.6, less below 15 words."""
    found = sentences(text)
    if len(found) <= n:
        return found

    def score(s: str) -> float:
        t = words(s)
        return (len(set(t)) * 0.4 + len(t) * 0.6) * min(1, len(t) / 15)

    return sorted(found, key=score, reverse=True)[:n]


def named(text: str) -> list[str]:
    """Capitalized runs, quoted passages, acronyms and dates, each once."""
    capitals = _CAPITALS.findall(text)
    runs, acronyms = [x for x in capitals if not x[1].isupper()], [x for x in capitals if x[1].isupper()]
    quoted, dates = _ENTITIES[1].findall(text) if '"' in text else [], _ENTITIES[3].findall(text) if "/" in text else []
    return list(dict.fromkeys([*runs, *quoted, *acronyms, *dates]))


def entities(text: str) -> list[str]:
    return list(dict.fromkeys(x for p in _ENTITIES for x in p.findall(text)))


def diversity(text: str) -> float:
    t = words(text)
    return len(set(t)) / len(t) if t else 0.0


def density(text: str, share: float | None = None) -> float:
    """Share of distinct words (diversity(), if known), more for entities and key phrases, 1 at most."""
    share = diversity(text) if share is None else share
    if not share:
        return 0.0
    few = set()  # as many as key_phrases(text, 3)
    for s in sentences(text):
        few.update(phrases(s))
        if len(few) >= 3:
            break
    return min(1.0, share * (1 + len(entities(text)) * 0.1) * (1 + min(3, len(few)) * 0.05))


def spans(text: str) -> list[tuple[int, int]]:
    """Places of the sentences."""
    out, at = [], 0
    for s in sentences(text):
        start = text.find(s, at)
        out.append((start, start + len(s)))
        at = start + len(s)
    return out


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def segment_coherence(parts: list[str]) -> float:
    """Mean similarity of neighbours; 1 for one part or none."""
    t = [words(p) for p in parts]
    return sum(jaccard(a, b) for a, b in zip(t, t[1:], strict=False)) / (len(t) - 1) if len(t) > 1 else 1.0


def coherence(text: str) -> float:
    """Mean similarity of neighbouring sentences, more with discourse markers and diversity, 1 at most."""
    found = sentences(text)
    if len(found) <= 1:
        return 1.0
    lower = text.lower()
    marked = any(m in lower for ms in MARKERS.values() for m in ms)
    return min(1.0, segment_coherence(found) * (1.1 if marked else 1.0) * min(1.2, 1 + diversity(text) * 0.5))


def completeness(answer: str, query: str, memories: int) -> float:
    """Share of the query's five key terms among the answer's words, and how much of the memories it uses."""
    asked, have = key_terms(query, 5), set(words(answer))
    covered = sum(k in have for k in asked) / max(1, len(asked))
    used = min(1.0, len(answer) / (memories * 100)) if memories else 0.5
    return min(1.0, covered * 0.6 + used * 0.3 * (1.1 if "\n\n" in answer else 1.0))


def quality(text: str | None, salience: float) -> tuple[bool, list[str], float]:
    """Whether a memory is good enough, what is wrong with it, and a score of 1 times a penalty for each fault."""
    if not (text or "").strip():
        return False, ["Empty content"], 0.0
    share = diversity(text)
    faults = [
        ("Very short content", 0.6, len(text) < 20),
        ("Very long content", 0.9, len(text) > 2000),
        ("No complete sentences", 0.5, not sentences(text)),
        ("Low lexical diversity (repetitive content)", 0.8, share < 0.3),
        ("Low semantic density", 0.7, density(text, share) < 0.2),
        ("Very low salience score", 1.0, salience < 0.1),
    ]
    issues, score = [name for name, _, bad in faults if bad], 1.0
    for _, penalty, bad in faults:
        score *= penalty if bad else 1.0
    return not issues or score > 0.5, issues, score


def gaps(query: str, topics: set[str]) -> list[tuple[str, float]]:
    """Topics that a query names and memories lack: 1 less 0.2 for each that contains one or is contained, above 0.5."""
    asked = dict.fromkeys([*key_terms(query), *entities(query)])
    out = [(t, 1 - 0.2 * sum(t in m or m in t for m in topics)) for t in asked if t not in topics]
    return sorted(((t, c) for t, c in out if c > 0.5), key=lambda x: -x[1])


def clusters(texts: list[str], most: int = 5) -> list[list[int]]:
    """Greedy groups: the row most similar to all others left (by TF-IDF) takes its share of the nearest ones."""
    import numpy as np

    n = len(texts)
    if n <= most:
        return [[i] for i in range(n)]
    t = [words(x) for x in texts]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for x in t for w in x))}
    df = Counter(w for x in t for w in set(x))
    m = np.zeros((n, max(1, len(vocab))))
    for i, x in enumerate(t):
        for w, c in Counter(x).items():
            m[i, vocab[w]] = c / len(x) * np.log((n + 1) / (df[w] + 1))
    norm = np.linalg.norm(m, axis=1)
    u = m / np.where(norm > 0, norm, 1)[:, None]
    sim, left, out = u @ u.T, list(range(n)), []
    for g in range(most):
        if not left:
            break
        share = [(sim[i, left].sum() / max(1, len(left)), -i) for i in left]
        seed = -max(share, key=lambda x: (round(x[0], 12), x[1]))[1]
        left.remove(seed)
        size = -(-len(left) // (most - g))
        near = sorted(left, key=lambda i: (-round(sim[seed, i], 12), i))[: max(0, size - 1)]
        out.append([seed, *near])
        left = [i for i in left if i not in set(near)]
    return out


def _of(call, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else call(x) for x in column.to_pylist()], arrow)

    return run.asNondeterministic()


def key_terms_of(text: Column, n: int = 10) -> Column:
    return _of(lambda x: key_terms(x, n), "array<string>", pa.list_(pa.string()))(text)


def key_phrases_of(text: Column, n: int = 5) -> Column:
    return _of(lambda x: key_phrases(x, n), "array<string>", pa.list_(pa.string()))(text)


def informative_of(text: Column, n: int = 3) -> Column:
    return _of(lambda x: informative(x, n), "array<string>", pa.list_(pa.string()))(text)


def density_of(text: Column) -> Column:
    return _of(density, "double", pa.float64())(text)


def coherence_of(text: Column) -> Column:
    return _of(coherence, "double", pa.float64())(text)


def spans_of(text: Column) -> Column:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return _of(lambda x: [{"start": a, "end": b} for a, b in spans(x)], "array<struct<start:int,end:int>>", kind)(text)


def quality_of(text: Column, salience: Column) -> Column:
    """struct of valid, issues and score; null text is empty."""

    @F.arrow_udf("struct<valid:boolean,issues:array<string>,score:double>")
    def run(texts: pa.Array, saliences: pa.Array) -> pa.Array:
        out = [quality(x, 0.5 if s is None else s) for x, s in zip(texts.to_pylist(), saliences.to_pylist(), strict=True)]
        cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.bool_(), pa.list_(pa.string()), pa.float64()))]
        return pa.StructArray.from_arrays(cols, ["valid", "issues", "score"])

    return run.asNondeterministic()(text, salience)
