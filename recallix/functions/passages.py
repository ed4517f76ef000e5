"""Sequential text operators: chunks, sections, essences and summaries, as Arrow functions."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_STOP, _WORD = set(STOP_WORDS), re.compile("[a-z0-9]+")

#: What makes a sentence worth keeping, and how much.
CUES = [
    (8, re.compile(r"^#+\s|^[A-Z][A-Z\s]+:")),
    (6, re.compile(r"^[A-Za-z][a-z]+:", re.I)),
    (7, re.compile(r"\d{4}-\d{2}-\d{2}")),
    (5, re.compile(r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d+", re.I | re.A)),
    (4, re.compile(r"\$\d+|\d+\s*(miles|dollars|years|months|km)")),
    (3, re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", re.A)),
    (4, re.compile(r"\b(bought|purchased|serviced|visited|went|got|received|paid|earned|learned|discovered|found|saw|met|completed|finished|fixed|implemented|created|updated|added|removed|resolved)\b", re.I | re.A)),
    (2, re.compile(r"\b(who|what|when|where|why|how)\b", re.I | re.A)),
    (1, re.compile(r"\b(I|my|me)\b", re.A)),
]


def chunked(text: str, target: int = 768, overlap: float = 0.1) -> list[tuple[str, int]]:
    """Chunks of about target tokens (four characters each) with their places; a chunk begins with its predecessor's
    tail."""
    if -(-len(text) // 4) <= target:
        return [(text, 0)]
    size = target * 4
    tail = int(size * overlap)
    out, held, start = [], "", 0
    for sentence in (s for p in re.split(r"\n\n+", text) for s in _SENTENCE.split(p)):
        longer = f"{held} {sentence}" if held else sentence
        if len(longer) <= size or not held:
            held = longer
            continue
        out.append((held, start))
        keep = held[-tail:] if tail else held
        held = f"{keep} {sentence}"
        start += len(held) - len(keep) - 1
    return [*out, (held, start)] if held else out


def sections(text: str, size: int = 3000) -> list[str]:
    """Paragraphs joined into sections of at most size characters where they fit."""
    if len(text) <= size:
        return [text]
    out, held = [], ""
    for p in re.split(r"\n\n+", text):
        if held and len(held) + len(p) > size:
            out.append(held.strip())
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held.strip()] if held.strip() else out


def essence(text: str, most: int = 200) -> str:
    """The sentences that score best, as far as they fit, in their order; the first one goes first if it fits."""
    if len(text) <= most:
        return text
    sentences = [s for s in (x.strip() for x in _SENTENCE.split(text)) if len(s) > 10]
    if not sentences:
        return text[:most]

    def score(i: int) -> int:
        s = sentences[i]
        return {0: 10, 1: 5}.get(i, 0) + sum(w for w, p in CUES if p.search(s)) + 2 * (len(s) < 80)

    taken, used = [], 0
    if len(sentences[0]) < most:
        taken, used = [0], len(sentences[0])
    for i in sorted(range(1, len(sentences)), key=lambda i: -score(i)):
        if used + len(sentences[i]) + 2 <= most:
            taken.append(i)
            used += len(sentences[i]) + 2
    return " ".join(sentences[i] for i in sorted(taken))


def frequent_words(text: str, k: int) -> list[str]:
    """The k most frequent words that are no stop words, ties in alphabetical order."""
    n = Counter(w for w in _WORD.findall(text.lower()) if w not in _STOP)
    return [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]]


def summary(text: str) -> str:
    """A third of the sentences, three at most, in their order: those with most words of their own (six count) and marks
    within (three count)."""
    sentences = [s for s in _SENTENCE.split(text) if s]
    if not sentences:
        return text
    own = lambda s: len(set(_WORD.findall(s.lower())) - _STOP)
    score = [min(6, own(s)) + min(3, s.count(",") + s.count(";") + s.count(":")) for s in sentences]
    best = sorted(range(len(sentences)), key=lambda i: -score[i])[: min(3, -(-len(sentences) // 3))]
    return " ".join(sentences[i] for i in sorted(best)) or sentences[0]


def reduced(text: str, left: float, layers: int = 3) -> str:
    """What decay leaves of a text: its beginning, its summary's, or its most frequent words, by the share that is left."""
    t = text.strip()
    cut = lambda x, n: x if len(x) <= n else x[: n - 1].rstrip() + "…"
    if not t:
        return ""
    if left > 0.8:
        return cut(t, 200)
    if left > 0.4:
        return cut(summary(t), 80 if layers >= 2 else 200)
    return " ".join(frequent_words(t, 5 if layers >= 3 else 3))


def _texts(call, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else call(x) for x in column.to_pylist()], arrow)

    return run.asNondeterministic()


def chunks(text: Column, target: int = 768, overlap: float = 0.1) -> Column:
    """array of (text, start, end, tokens); null stays null."""
    kind = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())])

    def call(x: str) -> list[dict]:
        return [{"text": t, "start": s, "end": s + len(t), "tokens": -(-len(t) // 4)} for t, s in chunked(x, target, overlap)]

    return _texts(call, "array<struct<text:string,start:int,end:int,tokens:int>>", pa.list_(kind))(text)


def section_array(text: Column, size: int = 3000) -> Column:
    return _texts(lambda x: sections(x, size), "array<string>", pa.list_(pa.string()))(text)


def essence_of(text: Column, most: int = 200) -> Column:
    return _texts(lambda x: essence(x, most), "string", pa.string())(text)


def summary_of(text: Column) -> Column:
    return _texts(summary, "string", pa.string())(text)


def reduced_of(text: Column, left: Column, layers: int = 3) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, lefts: pa.Array) -> pa.Array:
        return pa.array([None if x is None or f is None else reduced(x, f, layers) for x, f in zip(texts.to_pylist(), lefts.to_pylist(), strict=True)], pa.string())

    return run.asNondeterministic()(text, left)


def words_of_text(text: Column, k: int) -> Column:
    return _texts(lambda x: " ".join(frequent_words(x, k)), "string", pa.string())(text)
