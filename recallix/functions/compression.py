"""Rule-based text compression: semantic, syntactic, aggressive, and the choice among them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import re2, word
from .text import compression_tokens, let

#: Fillers that go, and phrases with their shorter forms.
FILLERS = ["just|really|very|quite|rather|somewhat|somehow", "actually|basically|essentially|literally", "I think that|I believe that|It seems that|It appears that", "in order to"]
PHRASES = [("at this point in time", "now"), ("due to the fact that", "because"), ("in the event that", "if"), ("for the purpose of", "to"), ("in the near future", "soon"), ("a number of", "several"), ("prior to", "before"), ("subsequent to", "after")]
CONTRACTIONS = [("do not", "don't"), ("cannot", "can't"), ("will not", "won't"), ("should not", "shouldn't"), ("would not", "wouldn't"), ("it is", "it's"), ("that is", "that's"), ("what is", "what's"), ("who is", "who's"), ("there is", "there's"), ("has been", "been"), ("have been", "been")]
SHORT_NAMES = [("JavaScript", "JS"), ("TypeScript", "TS"), ("Python", "Py"), ("application", "app"), ("function", "fn"), ("parameter", "param"), ("argument", "arg"), ("return", "ret"), ("variable", "var"), ("constant", "const"), ("database", "db"), ("repository", "repo"), ("environment", "env"), ("configuration", "config"), ("documentation", "docs")]


def _replaced(texts: pa.Array, pairs: list[tuple[str, str]]) -> pa.Array:
    for pattern, to in pairs:
        texts = pc.replace_substring_regex(texts, pattern, to)
    return texts


_WORDS = [*[(word(f), "") for f in FILLERS], (r"[\t-\r ]{2,}|[\t-\r]", " ")]
_SHORTER = [(word(a), b) for a, b in PHRASES]
_TIGHTER = [*[(word(a), b) for a, b in CONTRACTIONS], (r"\b" + re2(r"(the|a|an)\s+([A-Za-z0-9_]+),\s+(the|a|an)\s+"), r"\2, "), *[(re2(rf"\s*\{m}\s*"), m) for m in "{}();"]]
_MARKS = [("[*_~`#]", ""), (re2(r"https?://(www\.)?([^/\s]+)(/[^\s]*)?"), r"\2"), *[(word(a), b) for a, b in SHORT_NAMES], (r"\n{3,}", "\n\n"), (r" *\n *", "\n")]
_CODE = word("function|const|let|var|def|class|import|export", cased=True)
_PART = re.compile(r"[.!?]+[\t-\r ]+")


def _apart(text: str | None) -> str | None:
    """The sentences but for those that repeat the one before."""
    if text is None:
        return None
    parts = _PART.split(text)
    same = [x.lower().strip(" ") for x in parts]
    return ". ".join(x for i, x in enumerate(parts) if not i or same[i] != same[i - 1]).strip(" ")


def _semantic(texts: pa.Array) -> pa.Array:
    out = _replaced(pa.array([_apart(x) for x in texts.to_pylist()], pa.string()), _WORDS)
    return pc.if_else(pc.less(pc.utf8_length(texts), 50), texts, _replaced(pc.utf8_trim(out, " "), _SHORTER))


def _syntactic(texts: pa.Array) -> pa.Array:
    return pc.if_else(pc.less(pc.utf8_length(texts), 30), texts, _replaced(texts, _TIGHTER))


def _aggressive(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(_replaced(_syntactic(_semantic(texts)), _MARKS), " ")


def _chosen(texts: pa.Array) -> pa.Array:
    code = pc.or_(pc.match_substring_regex(texts, _CODE), pc.match_substring_regex(texts, "https?://"))
    long = pc.greater(pc.count_substring_regex(texts, r"[\t-\r ]+"), 99)
    cases = pa.StructArray.from_arrays([pc.fill_null(x, False) for x in (pc.less(pc.utf8_length(texts), 50), code, long)], ["short", "code", "long"])
    return pc.case_when(cases, *map(pa.scalar, ("semantic", "aggressive", "semantic", "syntactic")))


def _over(of: Callable[[pa.Array], pa.Array], text: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, batches)

    return run.asNondeterministic()(text)


def semantic(text: Column) -> Column:
    """Drop a sentence that repeats the one before, fillers and long phrases; texts under 50 characters stay."""
    return _over(_semantic, text)


def syntactic(text: Column) -> Column:
    """Contractions and tight brackets; texts under 30 characters stay."""
    return _over(_syntactic, text)


def aggressive(text: Column) -> Column:
    """Both, then marks of markdown, addresses as their host, and short names; lines are trimmed."""
    return _over(_aggressive, text)


def chosen(text: Column) -> Column:
    """aggressive for code or addresses, semantic for more than 100 words or under 50 characters, else syntactic."""
    return _over(_chosen, text)


def compressed(text: Column, algorithm: Column) -> Column:
    """A text by its algorithm, syntactic where that is no other."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names in batches:
            known = np.array([x if x in ("aggressive", "semantic") else "" for x in names.to_pylist()])
            rows = [np.flatnonzero(known == x) for x in ("aggressive", "semantic", "")]
            parts = [of(texts.take(pa.array(i))) for of, i in zip((_aggressive, _semantic, _syntactic), rows, strict=True)]
            yield pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))

    return run.asNondeterministic()(text, algorithm)


def metrics(before: Column, after: Column) -> Column:
    """Tokens before and after, those saved, the ratio, the share saved in percent, and the latency that it spares."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        ratio = F.when(a > 0, b / a).otherwise(1.0)
        return F.struct(a.alias("before"), b.alias("after"), (a - b).alias("saved"), ratio.alias("ratio"), F.when(a > 0, (a - b) / a * 100).otherwise(0.0).alias("percent"), ((a - b) * 0.05).alias("latency"))

    return let(F.struct(compression_tokens(before).alias("a"), compression_tokens(after).alias("b")), of)
