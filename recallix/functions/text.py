"""Text functions as Column expressions."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SECTORS, SECTOR_WEIGHT
from .patterns import re2, word

#: Groups of words that count as their first one.
SYNONYMS = [
    ["prefer", "like", "love", "enjoy", "favor"],
    ["theme", "mode", "style", "layout"],
    ["meeting", "meet", "session", "call", "sync"],
    ["dark", "night", "black"],
    ["light", "bright", "day"],
    ["user", "person", "people", "customer"],
    ["task", "todo", "job"],
    ["note", "memo", "reminder"],
    ["time", "schedule", "when", "date"],
    ["project", "initiative", "plan"],
    ["issue", "problem", "bug"],
    ["document", "doc", "file"],
    ["question", "query", "ask"],
]
HEAD = {w: g[0] for g in SYNONYMS for w in g}

#: Stop words of the keyword summary.
STOP_WORDS = "the a an to of and or in on for with at by is it be as are was were from that this these those but if then so than into over under about via vs not".split()

#: Classifier rules by sector, as (weight of a match, kind, pattern): kind w stands between word ends.
RULES = {
    "episodic": [
        (4, "w", r"today|yesterday|tomorrow|last\s+(?:week|month|year)|next\s+(?:week|month|year)"),
        (2, "w", r"remember\s+when|recall|that\s+time|when\s+I|I\s+was|we\s+were"),
        (2, "w", r"went|saw|met|felt|heard|visited|attended|participated"),
        (3, "w", r"at\s+\d{1,2}:\d{2}|on\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"),
        (2, "w", r"event|moment|experience|incident|occurrence|happened"),
        (1, "w", r"I\s+'?m\s+going\s+to"),
        (1, "c", r"今天|昨天|明天|前天|后天|本周|上周|下周|上个月|下个月|去年|明年|刚才|当时|那天|这次"),
        (1, "c", r"(?:我|我们).{0,12}(?:去了|看到|见到|遇到|参加|经历|发生|做了|完成了)"),
        (1, "c", r"(?:\d{4}年)?\d{1,2}月\d{1,2}日"),
        (1, "c", r"(?:周|星期)[一二三四五六日天]"),
    ],
    "semantic": [
        (2, "w", r"is\s+a|represents|means|stands\s+for|defined\s+as"),
        (2, "w", r"concept|theory|principle|law|hypothesis|theorem|axiom"),
        (2, "w", r"fact|statistic|data|evidence|proof|research|study|report"),
        (2, "w", r"capital|population|distance|weight|height|width|depth"),
        (2, "w", r"history|science|geography|math|physics|biology|chemistry"),
        (2, "w", r"know|understand|learn|read|write|speak"),
        (1, "c", r"是|指的是|意味着|代表|定义为|属于"),
        (1, "c", r"概念|理论|原理|定律|假设|定义|知识"),
        (1, "c", r"事实|数据|证据|研究|报告"),
        (1, "c", r"历史|科学|地理|数学|物理|生物|化学"),
    ],
    "procedural": [
        (2, "w", r"how\s+to|step\s+by\s+step|guide|tutorial|manual|instructions"),
        (2, "w", r"first|second|then|next|finally|afterwards|lastly"),
        (2, "w", r"install|run|execute|compile|build|deploy|configure|setup"),
        (2, "w", r"click|press|type|enter|select|drag|drop|scroll"),
        (2, "w", r"method|function|class|algorithm|routine|recipie"),
        (2, "w", r"to\s+do|to\s+make|to\s+build|to\s+create"),
        (1, "c", r"(?:怎么|如何|怎样).{0,12}(?:做|操作|安装|运行|配置|部署|创建|实现)"),
        (1, "c", r"第一步|第二步|然后|接着|下一步|最后|依次"),
        (1, "c", r"安装|运行|执行|编译|构建|部署|配置|设置|点击|输入|选择|按下"),
        (1, "c", r"步骤|教程|指南|操作方法|流程|做法"),
    ],
    "emotional": [
        (2, "w", r"feel|feeling|felt|emotions?|mood|vibe"),
        (2, "w", r"happy|sad|angry|mad|excited|scared|anxious|nervous|depressed"),
        (2, "w", r"love|hate|like|dislike|adore|detest|enjoy|loathe"),
        (2, "w", r"amazing|terrible|awesome|awful|wonderful|horrible|great|bad"),
        (2, "w", r"frustrated|confused|overwhelmed|stressed|relaxed|calm"),
        (2, "w", r"wow|omg|yay|nooo|ugh|sigh"),
        (1, "c", r"[!]{2,}"),
        (1, "c", r"感觉|感到|心情|情绪"),
        (1, "c", r"开心|高兴|难过|伤心|生气|愤怒|兴奋|害怕|焦虑|紧张|沮丧|郁闷|烦躁|压力|放松|平静"),
        (1, "c", r"喜欢|讨厌|热爱|厌恶|满意|失望|尴尬|痛苦|幸福"),
    ],
    "reflective": [
        (2, "w", r"realize|realized|realization|insight|epiphany"),
        (2, "w", r"think|thought|thinking|ponder|contemplate|reflect"),
        (2, "w", r"understand|understood|understanding|grasp|comprehend"),
        (2, "w", r"pattern|trend|connection|link|relationship|correlation"),
        (2, "w", r"lesson|moral|takeaway|conclusion|summary|implication"),
        (2, "w", r"feedback|review|analysis|evaluation|assessment"),
        (2, "w", r"improve|grow|change|adapt|evolve"),
        (1, "c", r"意识到|明白了|想通了|发现|领悟|反思|复盘"),
        (1, "c", r"我觉得|我认为|在我看来|回头看|仔细想想"),
        (1, "c", r"规律|趋势|联系|关系|相关性|模式"),
        (1, "c", r"教训|启发|心得|体会|收获|总结|结论|反省"),
        (1, "c", r"改进|成长|改变|适应|优化"),
    ],
}

#: Marks of time in a text; kind s stands after a word end only.
TEMPORAL = [
    ("w", r"today|yesterday|tomorrow|this\s+week|last\s+week|this\s+morning"),
    ("w", r"\d{4}-\d{2}-\d{2}"),
    ("w", r"20\d{2}[/-]?(?:0[1-9]|1[0-2])[/-]?(?:0[1-9]|[12]\d|3[01])"),
    ("s", r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}"),
    ("w", r"what\s+(?:did|have)\s+(?:i|we)\s+(?:do|done)"),
]

#: Endings and what they become, in the order of trial; an optional letter once with it and once without.
_ENDINGS = [("ies", "y"), ("ing", ""), ("ers", "er"), ("er", "er"), ("ed", ""), ("s", "")]

_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pattern(kind: str, body: str) -> str:
    """A Java pattern with ASCII word ends, whatever letters stand around."""
    if kind == "c":
        return body
    return f"(?i){_LEFT}(?:{body}){_RIGHT if kind == 'w' else ''}"


#: The Arrow type of lists of words.
WORDS = pa.list_(pa.string())


def by_text(text: Column, of: Callable[[str], Any], kind: str, type_: pa.DataType) -> Column:
    """A Python function of each text, null for null, with the results of few texts held at once."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([None if x is None else of(x) for x in texts.slice(i, 64).to_pylist()], type_) for i in range(0, len(texts), 64)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type_)

    return run.asNondeterministic()(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; runs of CJK as pairs of neighbours (one character alone as itself)."""
    return by_text(text, token_list, "array<string>", WORDS)


_TOKEN = re.compile(rf"[a-z0-9]+|[{_CJK}]+")


def token_list(text: str) -> list[str]:
    """tokens() of one text in Python."""
    out = _TOKEN.findall(text.lower())
    if text.isascii():
        return out
    return [x for t in out for x in ([t] if len(t) < 2 or t[0] < "\x80" else [t[i : i + 2] for i in range(len(t) - 1)])]


def canonical_tokens(text: Column) -> Column:
    """tokens() as the heads of their synonyms, or of their stems' synonyms, or as stems; of two characters or more."""
    return by_text(text, canonical_list, "array<string>", WORDS)


def canonical_list(text: str | None) -> list[str]:
    """canonical_tokens() of one text in Python."""
    return [x for x in map(_canonical, token_list(text or "")) if len(x) > 1]


@functools.lru_cache(maxsize=1 << 16)
def _canonical(t: str) -> str:
    return HEAD.get(t) or HEAD.get(x := _stemmed(t), x)


def canonical_counts(text: str | None) -> Counter:
    """How often each canonical token stands in a text; each distinct word is taken apart once."""
    out = Counter()
    for t, n in Counter(m[0] for m in re.finditer(rf"[a-z0-9]+|[{_CJK}]+", (text or "").lower())).items():
        for x in [t] if len(t) < 2 or t[0] < "\x80" else [t[i : i + 2] for i in range(len(t) - 1)]:
            if len(x := _canonical(x)) > 1:
                out[x] += n
    return out


def _stemmed(t: str) -> str:
    """The first ending whose cut leaves three characters or more; tokens of up to three stay."""
    for end, to in _ENDINGS if len(t) > 3 else ():
        if t.endswith(end) and len(t) - len(end) + len(to) >= 3:
            return t[: len(t) - len(end)] + to
    return t


def keyword_set(tokens: list[str], least: int = 3) -> set[str]:
    """keywords() of canonical tokens in Python."""
    out = set()
    for t in tokens:
        if len(t) >= max(least, 1):
            out.add(t)
            out.update(t[i : i + 3] for i in range(len(t) - 2))
    out.update(x for x in map("_".join, zip(tokens, tokens[1:], strict=False)) if len(x) >= least)
    out.update(map("_".join, zip(tokens, tokens[1:], tokens[2:], strict=False)))
    return out


def text_scores(query: tuple, content: tuple, corpus: int = 10_000, mean_length: float = 100.0, k1: float = 1.5, b: float = 0.75) -> tuple[float, float]:
    """token_overlap() and keyword_score() in Python, of (lower-case trimmed text, canonical tokens, keywords) of a query
    and (lower-case text, counts of tokens, number of tokens, keywords) of a content."""
    (phrase, tokens, own), (text, counts, n, theirs) = query, content
    distinct = set(tokens)
    overlap = sum(t in counts for t in distinct) / len(distinct) if distinct else 0.0
    weight = lambda k: sum(2 if "_" in x else 1 for x in k)
    shared = weight(own & theirs) / weight(own) if own else 0.0
    bm = 0.0
    for t in tokens:
        if tf := counts.get(t):
            bm += math.log((corpus + 1) / (tf + 0.5)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (n / mean_length)))
    return overlap, (1.0 if phrase in text else 0.0) + shared * 0.8 + min(1.0, bm / 10) * 0.5


def search_document(text: Column) -> Column:
    """Tokens with all their synonyms, in order, each once, joined by spaces."""
    groups = F.create_map(*[x for g in SYNONYMS for x in (F.lit(g[0]), F.array(*map(F.lit, g)))])
    return F.array_join(F.array_distinct(F.flatten(F.transform(canonical_tokens(text), lambda t: F.coalesce(F.try_element_at(groups, t), F.array(t))))), " ")


def fts_query(text: Column) -> Column:
    """Quoted distinct tokens joined by OR."""
    return F.array_join(F.transform(F.array_distinct(canonical_tokens(text)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def token_overlap(query: Column, memory: Column) -> Column:
    """Share of the query's distinct tokens that the memory has; 0 for an empty query."""
    both = F.struct(F.array_distinct(query).alias("q"), memory.alias("m"))
    return let(both, lambda x: F.when(F.size(x["q"]) == 0, 0.0).otherwise(F.size(F.array_intersect(x["q"], x["m"])) / F.size(x["q"])))


def jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("any")), lambda n: F.when(n["any"] == 0, 0.0).otherwise(n["both"] / n["any"]))


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct canonical tokens of the least length with their character triples, and neighbours joined by _."""
    none = F.array().cast("array<string>")

    def grams(x: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))
        return F.concat(F.array(x), F.when(F.length(x) >= 3, triples).otherwise(none))

    def runs(t: Column, n: int) -> Column:
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(t, i, n), "_"))

    def of(t: Column) -> Column:
        single = F.flatten(F.transform(F.filter(t, lambda x: F.length(x) >= max(least, 1)), grams))
        return F.array_distinct(F.concat(single, F.filter(runs(t, 2), lambda x: F.length(x) >= least), runs(t, 3)))

    return let(canonical_tokens(text), of)


def keyword_overlap(query: Column, content: Column) -> Column:
    """Weight of the query's keywords that the content has over the weight of all; pairs and triples weigh double."""

    def weight(k: Column) -> Column:
        return F.size(k) + F.size(F.filter(k, lambda x: x.contains("_")))

    def of(x: Column) -> Column:
        return F.when(F.size(x["q"]) == 0, 0.0).otherwise(let(F.array_intersect(x["q"], x["c"]), weight) / weight(x["q"]))

    return let(F.struct(query.alias("q"), content.alias("c")), of)


def keyword_share(query: str, content: Column, least: int = 3) -> Column:
    """keyword_overlap() of one query's keywords with those of each content, which are looked up and not listed."""
    own = keyword_set(canonical_list(query), least)
    weight = lambda k: sum(2 if "_" in x else 1 for x in k)
    total = weight(own)

    def of(text: str) -> float:
        t, found = canonical_list(text), set()
        for x in dict.fromkeys(t):
            if len(x) >= max(least, 1):
                found.update(y for y in (x, *(x[i : i + 3] for i in range(len(x) - 2))) if y in own)
        found.update(y for y in map("_".join, zip(t, t[1:], strict=False)) if y in own)
        found.update(y for y in map("_".join, zip(t, t[1:], t[2:], strict=False)) if y in own)
        return weight(found) / total if total else 0.0

    return by_text(content, of, "double", pa.float64())


def phrase_match(query: Column, content: Column) -> Column:
    return F.contains(F.lower(content), F.lower(F.trim(query)))


def bm25(query: Column, content: Column, corpus: int = 10_000, mean_length: float = 100.0, k1: float = 1.5, b: float = 0.75) -> Column:
    """Sum over the query's terms, repeated ones too; the term's weight falls with its own frequency in the content."""

    def of(both: Column) -> Column:
        q, c = both["q"], both["c"]
        n = F.size(c)

        def term(tf: Column) -> Column:
            return F.when(tf > 0, F.log((corpus + 1) / (tf + 0.5)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (n / mean_length)))).otherwise(0.0)

        return F.aggregate(F.transform(q, lambda t: F.size(F.filter(c, lambda x: x == t)).cast("double")), F.lit(0.0), lambda a, tf: a + term(tf))

    return let(F.struct(query.alias("q"), content.alias("c")), of)


def keyword_score(phrase: Column, overlap: Column, bm: Column) -> Column:
    """Exact phrase 1, overlap 0.8, and up to 0.5 for BM25."""
    return F.when(phrase, 1.0).otherwise(0.0) + overlap * 0.8 + F.least(F.lit(1.0), bm / 10) * 0.5


def tag_score(tags: Column, query: Column) -> Column:
    """A tag that is a query token counts 2, else 1 for each token that contains it or is contained; over twice the
    tags, at most 1."""
    q = F.array_distinct(query)

    def one(tag: Column) -> Column:
        t = F.lower(tag)
        part = F.size(F.filter(q, lambda x: F.contains(t, x) | F.contains(x, t)))
        return F.when(F.array_contains(q, t), 2).otherwise(part)

    total = F.aggregate(F.transform(tags, one), F.lit(0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(tags), F.lit(0)) < 1, 0.0).otherwise(F.least(F.lit(1.0), total / (F.size(tags) * 2)))


def sector_scores(text: Column) -> Column:
    """array<double> of the sectors' scores: every rule that fires adds its own weight once."""
    rules = [(i, w, word(p) if k == "w" else re2(p, cased=True)) for i, s in enumerate(SECTORS) for w, k, p in RULES[s]]
    weights = np.array([SECTOR_WEIGHT[s] for s in SECTORS])

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts, scores = pc.fill_null(texts, ""), np.zeros((len(texts), len(SECTORS)))
            for i, w, p in rules:
                scores[:, i] += w * _matches(texts, p)
            yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(SECTORS), pa.array((scores * weights).ravel()))

    return run.asNondeterministic()(text)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def classify(text: Column, given: Column | None = None) -> Column:
    """primary, additional (sectors with 0.3 of the best or more, at least 1) and confidence; a given sector wins."""
    return classified(sector_scores(text), given)


def classified(scores: Column, given: Column | None = None) -> Column:
    """classify() of the sectors' scores."""

    def pick(order: Column) -> Column:
        top, second = -F.get(order, F.lit(0))["minus"], -F.get(order, F.lit(1))["minus"]
        bar = F.greatest(F.lit(1.0), top * 0.3)
        more = F.transform(F.filter(F.slice(order, 2, 4), lambda x: (-x["minus"] > 0) & (-x["minus"] >= bar)), lambda x: x["sector"])
        primary = F.when(top > 0, F.get(order, F.lit(0))["sector"]).otherwise("semantic")
        confidence = F.when(top > 0, F.least(F.lit(1.0), top / (top + second + 1))).otherwise(0.2)
        return F.struct(primary.alias("primary"), F.when(top > 0, more).otherwise(F.array().cast("array<string>")).alias("additional"), confidence.alias("confidence"))

    sectors = F.array(*map(F.lit, SECTORS))
    best = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("minus"), i.alias("order"), F.get(sectors, i).alias("sector"))))
    found = let(best, pick)
    if given is None:
        return found
    fixed = F.struct(given.alias("primary"), F.array().cast("array<string>").alias("additional"), F.lit(1.0).alias("confidence"))
    return F.when(given.isin(*SECTORS), fixed).otherwise(found)


def has_temporal_marker(text: Column) -> Column:
    """Whether a mark of time stands in the text; null for null."""
    marks = [word(p, i not in (0, 3, 4), k == "w") for i, (k, p) in enumerate(TEMPORAL)]

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield reduce(pc.or_, [pc.match_substring_regex(texts, p) for p in marks])

    return run.asNondeterministic()(text)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes of sixteen hex digits differ."""
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def top_keywords(text: Column, k: int = 5) -> Column:
    """The k most frequent words that are no stop words, ties in alphabetical order."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    # equal words stand together once sorted, so that one pass counts them
    empty = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.array().cast("array<struct<minus:int,word:string>>").alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct((-s["n"]).alias("minus"), s["w"].alias("word"))))).otherwise(s["out"])

    def step(s: Column, w: Column) -> Column:
        return F.when((s["n"] > 0) & (s["w"] == w), F.struct(s["w"].alias("w"), (s["n"] + 1).alias("n"), s["out"].alias("out"))).otherwise(F.struct(w.alias("w"), F.lit(1).alias("n"), closed(s).alias("out")))

    counted = F.aggregate(F.array_sort(words), empty, step, closed)
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda x: x["word"])


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def compression_tokens(text: Column) -> Column:
    """A quarter of the characters and half of the words, rounded up."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(F.length(text) / 4 + words / 2)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s+$", ""), F.lit("..."))).otherwise(text)


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def parsed_or(text: Column, kind: str, otherwise: Column) -> Column:
    """JSON of a kind; what is no such JSON gives the other value."""
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), otherwise)


def text_key(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)
