"""Search string -> field conditions and left-over words."""

from __future__ import annotations

import re
from typing import NamedTuple

# The search-string notation.
FIELD_VALUE = r'(\w+)[:=]"([^"]+)"|(\w+)[:=](\S+)'
COMPARISON = r"(\w+)\s*(<=|>=|<|>|=|!=)\s*(\d+(?:\.\d+)?)"
OPERATORS = {"<": "lt", ">": "gt", "<=": "lte", ">=": "gte", "=": "eq", "!=": "neq"}
CONNECTIVES = {"and", "or", "not"}
MIN_KEYWORD_LENGTH = 3
NUMBER = r"\d+(?:\.\d+)?"
COUNTING = (
    "how many", "count", "total", "number of", "tally",
    "sum of", "sum up", "calculate", "compute",
)
MANY_OR_NUMBER = r"how\s+many|number\s+of"
ID_IN_QUERY = r"(?:^|\s)(?:item\s+)?id\s*[:=]?\s*(\d+)|(?:^|\s)#(\d+)"
FILLERS = ("are", "is", "there", "do", "we", "have", "the")
LAST_SPAN = r"(?:in|from|within)\s+(?:the\s+)?last\s+(\d+)\s+(day|week|month|year)s?"
GROUP_BY = r"group by\s+(\w+)"


class Condition(NamedTuple):
    """``op`` is one of lt, gt, lte, gte, eq, neq (numbers) or is (text)."""

    field: str
    op: str
    value: str | int | float


def as_number(text: str) -> int | float:
    return float(text) if "." in text else int(text)


def read_terms(query: str) -> tuple[list[Condition], list[str]]:
    """Conditions of ``query`` and the words outside them, connectives removed.

    A time span such as "from the last 7 days" is neither; see :func:`last_span`.
    """
    found: list[Condition] = []

    def take_value(m: re.Match) -> str:
        name, value = m[1] or m[3], m[2] or m[4]
        if m[4] and m[0][len(name)] == "=" and re.fullmatch(NUMBER, value):
            found.append(Condition(name, "eq", as_number(value)))
        else:
            found.append(Condition(name, "is", value))
        return " "

    def take_comparison(m: re.Match) -> str:
        found.append(Condition(m[1], OPERATORS[m[2]], as_number(m[3])))
        return " "

    rest = re.sub(COMPARISON, take_comparison, re.sub(FIELD_VALUE, take_value, without_span(query)))
    words = [w for w in rest.split() if w.lower() not in CONNECTIVES]
    return found, words


def keywords(words: list[str]) -> list[str]:
    """Words long enough to search for."""
    return [w for w in words if len(w) >= MIN_KEYWORD_LENGTH]


def without_counting(query: str) -> str:
    """``query`` without counting words, time span, grouping and fillers."""
    text = query.lower()
    for word in COUNTING:
        text = text.replace(word, " ")
    for pattern in (LAST_SPAN, GROUP_BY, r"\?", rf"\b(?:{'|'.join(FILLERS)})\b"):
        text = re.sub(pattern, " ", text)
    return " ".join(text.split())


def without_span(query: str) -> str:
    return re.sub(LAST_SPAN, " ", query, flags=re.IGNORECASE)


def last_span(query: str) -> tuple[int, str] | None:
    m = re.search(LAST_SPAN, query, re.IGNORECASE)
    return (int(m[1]), m[2].lower()) if m else None


def group_field(query: str) -> str | None:
    m = re.search(GROUP_BY, query, re.IGNORECASE)
    return m[1] if m else None


def wanted_id(query: str) -> str | None:
    m = re.search(ID_IN_QUERY, query, re.IGNORECASE)
    return (m[1] or m[2]) if m else None


def asks_for_count(query: str, word_boundary: bool = False) -> bool:
    """A counting word anywhere in the text, or with ``word_boundary`` only as a word of its own."""
    low = query.lower()
    if word_boundary:
        return bool(re.search(rf"\b(?:{'|'.join(map(re.escape, COUNTING))}|{MANY_OR_NUMBER})\b", low))
    return any(w in low for w in COUNTING) or bool(re.search(rf"\b(?:{MANY_OR_NUMBER})\b", low))
