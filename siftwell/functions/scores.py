"""Relevance as Column arithmetic."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.predicates import as_text, atomic_columns, contains, either
from siftwell.functions.text import between_blanks
from siftwell.roles import Roles

# Points and column weights.
EXACT, INSIDE, WORD = 10.0, 5.0, 1.0
NAME_WEIGHT, STATUS_WEIGHT, OTHER_WEIGHT = 3.0, 2.0, 1.0
KEYWORD_EQUAL, KEYWORD_INSIDE, WHOLE_QUERY = 2.0, 0.5, 1.0
IMPORTANT = ("name", "title", "id", "description")
FIELD_WEIGHTS = {
    "name": 2.0,
    "description": 1.5,
    "status": 1.0,
    "error_message": 1.0,
    "default": 0.5,
}


def role_weights(roles: Roles | None) -> dict[str, float]:
    weights: dict[str, float] = {"default": OTHER_WEIGHT}
    if roles and roles.name:
        weights[roles.name] = NAME_WEIGHT
    if roles and roles.status:
        weights[roles.status] = STATUS_WEIGHT
    return weights


def add(parts: Sequence[Column]) -> Column:
    return reduce(operator.add, parts, F.lit(0.0))


def points(c: Column, query: str) -> Column:
    """Points of one column: whole value, then substring, then a shared word."""
    text, want = F.lower(as_text(c)), query.lower()
    words = sorted(set(want.split()))
    out = (
        F.when(c.isNull() | (text == ""), 0.0)
        .when(text == want, EXACT)
        .when(F.contains(text, F.lit(want)), INSIDE)
    )
    if words != [want]:
        # The substring test is cheap; only texts that pass it meet the pattern.
        maybe = either(F.contains(text, F.lit(w)) for w in words)
        out = out.when(maybe & F.regexp_like(text, F.lit(between_blanks(words))), WORD)
    return out.otherwise(0.0)


def text_score(
    df: DataFrame,
    query: str,
    roles: Roles | None = None,
    *,
    weights: Mapping[str, float] | None = None,
    fields: Sequence[str] | None = None,
) -> Column:
    """Weighted points over all columns; ``weights["default"]`` covers the rest.

    Without ``weights`` the roles decide; ``FIELD_WEIGHTS`` is a set by field name.
    """
    weights = weights if weights is not None else role_weights(roles)
    default = weights.get("default", OTHER_WEIGHT)
    return add(
        [points(F.col(f), query) * weights.get(f, default) for f in fields or atomic_columns(df)]
    )


def matched_fields(df: DataFrame, query: str, fields: Sequence[str] | None = None) -> Column:
    """Names of the columns that earned points, in column order."""
    return F.array_compact(
        F.array(
            *[F.when(points(F.col(f), query) > 0, F.lit(f)) for f in fields or atomic_columns(df)]
        )
    )


def hit_count(df: DataFrame, query: str, fields: Sequence[str] | None = None) -> Column:
    """Number of columns containing the query."""
    hits = [
        F.coalesce(contains(F.col(f), query).cast("int"), F.lit(0))
        for f in fields or atomic_columns(df)
    ]
    return reduce(operator.add, hits)


def structured_score(
    df: DataFrame, phrase: str, keywords: Sequence[str], fields: Sequence[str] | None = None
) -> Column:
    """1, more for each keyword in a column and for the phrase in an important one."""
    fields = fields or atomic_columns(df)
    parts = []
    for field in fields:
        text = F.lower(F.coalesce(as_text(F.col(field)), F.lit("none")))
        for word in (w.lower() for w in keywords):
            parts.append(
                F.when(text == word, KEYWORD_EQUAL)
                .when(F.contains(text, F.lit(word)), KEYWORD_INSIDE)
                .otherwise(0.0)
            )
        if field in IMPORTANT:
            parts.append(F.when(F.contains(text, F.lit(phrase.lower())), WHOLE_QUERY).otherwise(0.0))
    return F.lit(1.0) + add(parts)
