"""Filtered, scored and ranked search over one table or several."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import predicates as P
from siftwell.functions import scores as S
from siftwell.functions.terms import Condition, keywords, last_span, read_terms, without_span
from siftwell.roles import Roles

# Result settings.
RESULT_SETTINGS = {
    "max_results": 10,
    "min_score": 0.0,
    "sort_by": "_score",
    "sort_order": "desc",
    "exclude_fields": ("_internal", "_metadata"),
}


def show_condition(cond: Condition) -> str:
    signs = {"is": "=", "eq": "=", "neq": "!=", "lt": "<", "gt": ">", "lte": "<=", "gte": ">="}
    return f"{cond.field}{signs[cond.op]}{cond.value}"


def in_span(
    df: DataFrame, query: str, roles: Roles | None = None, as_of: Column | str | None = None
) -> DataFrame:
    """Rows inside the time span the query names, by the first timestamp role."""
    span = last_span(query)
    if span is None:
        return df
    if not roles or not roles.timestamps:
        raise ValueError("the query names a time span, but no column has a timestamp role")
    return in_last(df, roles.timestamps[0], *span, as_of)


def filter_rows(
    df: DataFrame,
    query: str,
    *,
    connective: str = "AND",
    whole_words: bool = False,
    roles: Roles | None = None,
    as_of: Column | str | None = None,
) -> DataFrame:
    """Rows meeting the conditions, left-over keywords and time span of ``query``."""
    conds, words = read_terms(query)
    df = in_span(df, query, roles, as_of)
    return df.filter(
        P.structured(df, conds, keywords(words), connective=connective, whole_words=whole_words)
    )


def structured_search(df: DataFrame, query: str, *, connective: str = "AND") -> DataFrame:
    """:func:`filter_rows` with a constant score and the conditions that applied."""
    conds, _ = read_terms(query)
    shown = [F.lit(show_condition(c)) for c in conds]
    return filter_rows(df, query, connective=connective).withColumns(
        {
            "_score": F.lit(1.0),
            "_match_type": F.lit("structured"),
            "_conditions": F.array(*shown) if shown else F.array().cast("array<string>"),
        }
    )


def relevance_search(df: DataFrame, query: str, fields: Sequence[str] | None = None) -> DataFrame:
    """:func:`filter_rows` scored by where the keywords hit."""
    _, words = read_terms(query)
    phrase = " ".join(words)
    return filter_rows(df, query).withColumn(
        "_score", S.structured_score(df, phrase, keywords(words), fields)
    )


def text_scored(
    df: DataFrame,
    query: str,
    roles: Roles | None = None,
    *,
    weights: Mapping[str, float] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with its text score, 0 where nothing matches."""
    return df.withColumns(
        {
            "_score": S.text_score(df, query, roles, weights=weights, fields=fields),
            "_match_type": F.lit("text"),
            "_matched_fields": S.matched_fields(df, query, fields),
        }
    )


def text_search(
    df: DataFrame,
    query: str,
    roles: Roles | None = None,
    *,
    weights: Mapping[str, float] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with any text match, scored."""
    return text_scored(df, query, roles, weights=weights, fields=fields).filter("_score > 0")


def best_matches(
    df: DataFrame, query: str, roles: Roles, k: int, fields: Sequence[str] | None = None
) -> DataFrame:
    """Top ``k`` of :func:`text_search`.

    Rows without a match rank last and are dropped after the limit, so every
    text is scored once and not once more for the filter.
    """
    return best(text_scored(df, query, roles, fields=fields), k, roles.id).filter("_score > 0")


def best(df: DataFrame, k: int, id_column: str | Sequence[str], by: str = "_score") -> DataFrame:
    """Top ``k`` by score, ties by id: each task keeps k rows, nothing is shuffled whole."""
    ids = [id_column] if isinstance(id_column, str) else list(id_column)
    return df.orderBy(F.desc(by), *[F.asc(i) for i in ids]).limit(k)


def merge_sources(sources: Sequence[DataFrame], k: int, id_column: str = "id") -> DataFrame:
    """Best ``k`` over several scored tables with differing columns."""
    tops = [best(s, k, id_column) for s in sources]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tops)
    return best(union, k, id_column)


def with_settings(df: DataFrame, id_column: str, settings: Mapping[str, Any] = ()) -> DataFrame:
    """Apply score floor, order, column exclusions and result cap."""
    s = {**RESULT_SETTINGS, **dict(settings)}
    order = F.desc if s["sort_order"] == "desc" else F.asc
    return (
        df.filter(F.col("_score") >= s["min_score"])
        .orderBy(order(s["sort_by"]), F.asc(id_column))
        .limit(s["max_results"])
        .drop(*s["exclude_fields"])
    )


def by_id(df: DataFrame, id_column: str, value: str | int) -> DataFrame:
    return df.filter(P.with_id(df, id_column, value)).limit(1)


def id_first(
    df: DataFrame,
    value: str | int,
    query: str,
    roles: Roles,
    k: int = 10,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """The row with that id; only where there is none, the text matches instead.

    One job: the fall-back branch is guarded by an EXISTS subquery.
    """
    hit = by_id(df, roles.id, value)
    exact = hit.withColumns({"_score": F.lit(1.0), "_match_type": F.lit("exact_id")})
    found = best_matches(df.filter(~hit.exists()), query, roles, k, fields).drop("_matched_fields")
    return exact.unionByName(found)


def search(
    df: DataFrame,
    query: str,
    roles: Roles,
    k: int = 10,
    fields: Sequence[str] | None = None,
    as_of: Column | str | None = None,
) -> DataFrame:
    """Structured search where the query holds conditions, else text search."""
    conds, _ = read_terms(query)
    rows, rest = in_span(df, query, roles, as_of), " ".join(without_span(query).split())
    if conds:
        return best(structured_search(rows, rest), k, roles.id)
    return best_matches(rows, rest, roles, k, fields)


def in_last(
    df: DataFrame, column: str, amount: int, unit: str, as_of: Column | str | None = None
) -> DataFrame:
    return df.filter(P.within_last(F.col(column), amount, unit, as_of))
