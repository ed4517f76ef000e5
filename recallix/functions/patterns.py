"""Java patterns as Arrow's matcher takes them, which reads a text once whatever the pattern."""

from __future__ import annotations

import re

_PART = re.compile(r"\\.|.", re.S)


def re2(body: str, cased: bool = False) -> str:
    """A pattern with Java's meaning of \\s and of the dot; letters outside classes stand for both ASCII cases, unless
    cased."""
    out, inside = [], False
    for x in _PART.findall(body):
        if x in "[]":
            inside = x == "["
        elif x == r"\s":
            x = r"\t-\r " if inside else r"[\t-\r ]"
        elif x == "." and not inside:
            x = r"[^\n\r\x{85}\x{2028}\x{2029}]"
        elif not (inside or cased) and re.fullmatch("[A-Za-z]", x):
            x = f"[{x.lower()}{x.upper()}]"
        out.append(x)
    return "".join(out)


def word(body: str, cased: bool = False, end: bool = True) -> str:
    """A body whose ends are ASCII letters, digits or underscores, between ASCII word ends."""
    return rf"\b(?:{re2(body, cased)})" + (r"\b" if end else "")
