"""Query and text analysis: intent, form, complexity, time, sentiment, discourse markers, entities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import re2
from .text import WORDS, by_text, let

#: Words that the analysis leaves out, and its word lists.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with i you me my we our this these those can do have had been being but or if than because while where after so though since until whether before although nor like once unless now except also into over such then them same only may must shall".split()
TIME_WORDS = ["yesterday", "today", "tomorrow", "last week", "next week", "last month", "next month", "last year", "next year", "ago", "later", "soon", "recently", "earlier", "before", "after", "during", "while", "when", "now", "currently", "previously", "formerly", "future", "past", "present", "meanwhile"]
POSITIVE = "good great excellent amazing wonderful fantastic love happy joy pleased satisfied excited delighted brilliant perfect best awesome terrific superb outstanding".split()
NEGATIVE = "bad terrible awful horrible poor worst hate sad angry frustrated disappointed upset annoyed irritated concerned worried anxious stressed unhappy displeased".split()
MARKERS = {
    "causal": ["because", "therefore", "thus", "hence", "consequently", "as a result", "due to"],
    "temporal": ["then", "next", "after", "before", "while", "during", "meanwhile", "subsequently"],
    "additive": ["also", "furthermore", "moreover", "additionally", "besides", "in addition"],
    "contrastive": ["but", "however", "although", "despite", "yet", "nevertheless", "on the other hand"],
    "exemplification": ["for example", "for instance", "such as", "like", "specifically", "particularly"],
}
MODERATE = ["how", "why", "explain", "describe", "compare"]
COMPLEX = ["analyze", "evaluate", "synthesize", "critique", "justify", "hypothesize"]
STARTERS = "what how why when where who which whose can could should would is are do does did".split()
INTENTS = {
    "procedural": r"how\s+(?:do|to|can)|steps|process|procedure|guide|tutorial|instructions|method|way to",
    "episodic": r"remember|recall|when did|last time|previous|earlier|before|history|experience|happened",
    "emotional": r"feel|feeling|emotion|mood|sentiment|happy|sad|anxious|stressed|excited|worried",
    "reflective": r"why|reason|insight|analysis|summary|reflect|think|believe|opinion|lesson|learning",
    "factual": r"what is|define|explain|describe|tell me about|information on|details|fact",
    "comparative": r"compare|difference|better|worse|versus|vs|which one|best|prefer",
    "actionable": r"recommend|suggest|advise|should i|what to|help me|looking for",
}
PAST, FUTURE, PRESENT = ["yesterday", "ago", "earlier", "before", "previously", "past"], ["tomorrow", "later", "soon", "future"], ["today", "now", "currently", "present"]


def words(text: Column) -> Column:
    """Lower-case words of more than two letters, digits or underscores that are no stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), r"\s+")
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def _has(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def intent(text: Column) -> Column:
    """The kind whose first match is longest, the earlier kind on ties; factual where none matches."""
    kinds, patterns = [*INTENTS, "factual"], [f"(?P<m>{re2(p)})" for p in INTENTS.values()]

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [pc.utf8_length(pc.struct_field(pc.extract_regex(texts, p), "m")) for p in patterns]
            length = np.stack([pc.fill_null(n, 0).to_numpy(zero_copy_only=False) for n in found])
            best = np.where(length.max(0) > 0, length.argmax(0), len(patterns))
            yield pa.array([kinds[i] for i in best], pa.string())

    return run.asNondeterministic()(text)


def form(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(F.contains(t, F.lit("?")) | t.rlike("^(?:" + "|".join(STARTERS) + ")"), "interrogative").otherwise("declarative")


def complexity(text: Column) -> Column:
    t = F.lower(text)
    return F.when(_has(t, COMPLEX), "complex").when(_has(t, MODERATE), "moderate").otherwise("simple")


def traits(text: Column) -> Column:
    """struct of hard, a text's complexity(), and timed, whether it holds one of the time_words(). Null counts as empty."""

    @F.arrow_udf("struct<hard:string,timed:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lower = [(x or "").lower() for x in texts.to_pylist()]
            any_of = lambda parts: [any(p in x for p in parts) for x in lower]
            hard = ["complex" if c else "moderate" if m else "simple" for c, m in zip(any_of(COMPLEX), any_of(MODERATE), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(hard, pa.string()), pa.array(any_of(TIME_WORDS), pa.bool_())], ["hard", "timed"])

    return run.asNondeterministic()(text)


def time_scope(text: Column) -> Column:
    t = F.lower(text)
    return F.when(_has(t, PAST), "past").when(_has(t, FUTURE), "future").when(_has(t, PRESENT), "present").otherwise("general")


def time_words(text: Column) -> Column:
    t = F.lower(text)
    return F.filter(F.array(*map(F.lit, TIME_WORDS)), lambda w: F.contains(t, w))


_FEELING = tuple(rf"\b(?:{'|'.join(w)})\b" for w in (POSITIVE, NEGATIVE))


def _felt(texts: list[str]) -> tuple[list[str], list[float]]:
    """Polarity and intensity of each text. Arrow counts the words of feeling; all words are only counted where there are any."""
    from .reading import words as listed

    lower = pa.array([x.lower() for x in texts], pa.large_string())
    good, bad = (pc.count_substring_regex(lower, p).to_pylist() for p in _FEELING)
    polarity = ["positive" if g > b else "negative" if b > g else "neutral" for g, b in zip(good, bad, strict=True)]
    return polarity, [min(1.0, (g + b) / len(listed(x)) * 10) if g + b else 0.0 for x, g, b in zip(texts, good, bad, strict=True)]


def _few_at_once(text: Column, of, kind: str, type_: pa.DataType) -> Column:
    """The columns of a struct that a function takes from texts, 64 of them at a time; null for null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for i in range(0, len(texts), 64):
                some = texts.slice(i, 64)
                columns = [pa.array(x, f.type) for x, f in zip(of([x or "" for x in some.to_pylist()]), type_, strict=True)]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(type_), mask=pc.is_null(some)))
            yield pa.concat_arrays(parts) if parts else pa.array([], type_)

    return run.asNondeterministic()(text)


_SENTIMENT = [("polarity", pa.string()), ("intensity", pa.float64())]


def sentiment(text: Column) -> Column:
    """polarity and intensity: ten times the share of words of feeling, at most 1."""
    return _few_at_once(text, _felt, "struct<polarity:string,intensity:double>", pa.struct(_SENTIMENT))


def tone(text: Column) -> Column:
    """sentiment() and the number of entities(), for one passage of a text to Python."""
    from .reading import named

    def of(texts: list[str]) -> tuple:
        return *_felt(texts), [len(named(x)) for x in texts]

    return _few_at_once(text, of, "struct<polarity:string,intensity:double,entities:int>", pa.struct([*_SENTIMENT, ("entities", pa.int32())]))


def markers(text: Column, kind: str) -> Column:
    """Discourse markers of a kind that stand anywhere in the text."""
    t = F.lower(text)
    return F.filter(F.array(*map(F.lit, MARKERS[kind])), lambda m: F.contains(t, m))


def entities(text: Column) -> Column:
    """Capitalized runs, quoted passages, acronyms and dates, each once."""
    from .reading import named

    return by_text(text, named, "array<string>", WORDS)


def ngrams(w: Column, n: int) -> Column:
    """Runs of n neighbouring words."""
    places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))


def bm25(query: Column, content: Column, mean_length: float = 100.0, k1: float = 1.5, b: float = 0.75) -> Column:
    """Sum over the query's words, repeated ones too, of the variant whose weight is ln(1 + 1 / (tf + 1))."""

    def of(c: Column) -> Column:
        def term(tf: Column) -> Column:
            return F.when(tf > 0, F.log(1 + 1 / (tf + 1)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (F.size(c) / mean_length)))).otherwise(0.0)

        return F.aggregate(F.transform(query, lambda q: F.size(F.filter(c, lambda x: x == q)).cast("double")), F.lit(0.0), lambda a, tf: a + term(tf))

    return let(content, of)
