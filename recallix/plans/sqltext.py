"""Parts of reference SQL for text functions."""

from __future__ import annotations

from ..config import SECTOR_WEIGHT, SECTORS
from ..functions.text import HEAD, RULES, TEMPORAL


def stem(t: str) -> str:
    """SQL of the stem of a token."""
    rules = [("ies$", "y"), ("ing$", ""), ("ers?$", "er"), ("ed$", ""), ("s$", "")]
    cases = " ".join(f"WHEN regexp_matches({t}, '{p}') AND length(regexp_replace({t}, '{p}', '{to}')) >= 3 THEN regexp_replace({t}, '{p}', '{to}')" for p, to in rules)
    return f"(CASE WHEN length({t}) <= 3 THEN {t} {cases} ELSE {t} END)"


HEADS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in HEAD.items()) + "}"


def canonical(t: str) -> str:
    return f"coalesce({HEADS}[{t}], {HEADS}[{stem(t)}], {stem(t)})"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def canonical_tokens(text: str) -> str:
    return f"list_filter(list_transform({tokens(text)}, lambda t: {canonical('t')}), lambda t: length(t) > 1)"


def pattern(kind: str, body: str) -> str:
    return body if kind == "c" else rf"(?i)\b(?:{body})" + (r"\b" if kind == "w" else "")


def fires(text: str, kind: str, body: str, cased: bool = False) -> str:
    p = pattern(kind, body).replace("(?i)", "") if cased else pattern(kind, body)
    return f"regexp_matches({text}, '" + p.replace("'", "''") + "')"


def sector_score(sector: str, text: str) -> str:
    parts = " + ".join(f"CASE WHEN {fires(text, k, p)} THEN {w} ELSE 0 END" for w, k, p in RULES[sector])
    return f"CAST({parts} AS DOUBLE) * CAST({SECTOR_WEIGHT[sector]} AS DOUBLE)"


def temporal(text: str) -> str:
    return " OR ".join(fires(text, k, p, i not in (0, 3, 4)) for i, (k, p) in enumerate(TEMPORAL))


def scores(text: str) -> str:
    return ", ".join(f"{sector_score(s, text)} AS s{i}" for i, s in enumerate(SECTORS))



def token_hashes(text: str) -> str:
    """SQL of the multiply-by-31 hashes of a text's distinct canonical tokens, of ASCII letters and digits."""
    return f"list_transform(list_distinct({canonical_tokens(text)}), lambda t: list_reduce(list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: (a * 31 + b) & 4294967295, CAST(0 AS BIGINT)))"


def majority_bits(hashes: str) -> str:
    """SQL of the number whose bits are the majority votes of a column of hashes."""
    return " + ".join(f"CASE WHEN 2 * len(list_filter({hashes}, lambda h: (h >> {i}) & 1 = 1)) > len({hashes}) THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i in range(32))


def simhashes(memories: str) -> str:
    """CTEs of the memories' token hashes and simhash bits."""
    return f"""{memories}, token_hashes AS (SELECT id, {token_hashes("coalesce(content, '')")} AS h FROM memories), simhashes AS (SELECT id, {majority_bits("h")} AS bits FROM token_hashes)"""


def hex_digits(hashes: str) -> str:
    """SQL of the simhash as text: eight digits of four votes each, the first vote the highest bit, written twice."""
    vote = lambda i: f"CASE WHEN 2 * len(list_filter({hashes}, lambda h: (h >> {i}) & 1 = 1)) > len({hashes}) THEN 1 ELSE 0 END"
    digits = " || ".join(f"'0123456789abcdef'[1 + " + " + ".join(f"{8 >> j} * ({vote(i + j)})" for j in range(4)) + "]" for i in range(0, 32, 4))
    return f"repeat({digits}, 2)"
