"""One entry for a search string: by id, as a count, as a search, as hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.querytext import ROUTE_SEMANTIC, SHORT_QUERY_WEIGHT, SHORT_QUERY_WORDS
from siftwell.functions.predicates import structured
from siftwell.functions.terms import asks_for_count, last_span, read_terms, wanted_id, without_counting
from siftwell.functions.vectors import embed_text
from siftwell.operators import fusion
from siftwell.operators.aggregates import count_query
from siftwell.operators.search import best_matches, id_first, in_span, search
from siftwell.operators.vectorindex import knn
from siftwell.roles import Roles


def ask(
    df: DataFrame,
    query: str,
    roles: Roles,
    k: int = 10,
    *,
    as_of: Column | str | None = None,
    fields: Sequence[str] | None = None,
    word_boundary: bool = False,
) -> DataFrame:
    """An id asks for its row, counting words for a count, anything else for a ranking.

    A counting word counts anywhere in the text, also inside other words such as
    "discount"; with ``word_boundary`` only as a word of its own.
    """
    value = wanted_id(query)
    if value is not None:
        return id_first(df, value, query, roles, k, fields)
    if asks_for_count(query, word_boundary):
        return count_query(df, query, roles, as_of)
    return search(df, query, roles, k, fields, as_of)


def is_structured(query: str) -> bool:
    """Conditions and no word that asks for meaning."""
    conds, _ = read_terms(query)
    return bool(conds) and not set(query.lower().split()) & set(ROUTE_SEMANTIC)


def query_weight(query: str, weight: float = 0.5) -> float:
    """Short plain queries lean on the vector side."""
    conds, _ = read_terms(query)
    short = len(query.split()) <= SHORT_QUERY_WORDS
    return max(weight, SHORT_QUERY_WEIGHT) if short and not conds else weight


def both_sides(
    df: DataFrame, index: DataFrame, text: str, roles: Roles, as_of: Column | str | None
) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the query's conditions and time span, and the part of the index that belongs to them."""
    conds, _ = read_terms(text)
    allowed = in_span(df, text, roles, as_of).filter(structured(df, conds))
    near = index.select("id", "embedding")
    if conds or last_span(text) is not None:
        ids = allowed.select(F.col(roles.id).cast("string").alias("a_id"))
        near = near.join(ids, F.col("id") == F.col("a_id"), "left_semi")
    return allowed, near


def hybrid_rows(
    df: DataFrame,
    index: DataFrame,
    query: str,
    roles: Roles,
    dim: int,
    k: int = 100,
    *,
    weight: float | None = None,
    fields: Sequence[str] | None = None,
    as_of: Column | str | None = None,
    embed: Callable[[str, int], Sequence[float]] = embed_text,
) -> DataFrame:
    """The rows themselves with ``_structured_score``, ``_vector_score``, ``_combined_score``, ``_score``, ``_result_type``.

    Conditions and the time span of the query hold on both sides: the index is
    cut to the ids that meet them before its nearest are taken. At most k ids are
    joined back to the table.
    """
    text = without_counting(query) if asks_for_count(query) else query
    _, words = read_terms(text)
    allowed, near = both_sides(df, index, text, roles, as_of)
    id = F.col(roles.id).cast("string")
    phrase = " ".join(words)
    keyword = best_matches(allowed, phrase, roles, k, fields) if words else allowed.withColumn("_score", F.lit(1.0))
    found = fusion.hybrid_scores(
        keyword.select(id.alias("id"), "_score"),
        knn(near, "id", "embedding", embed(phrase or text, dim), k, unit=True),
        weight if weight is not None else query_weight(text),
        k,
    )
    # Bounded by k, so every task can hold it.
    found = F.broadcast(found.withColumnRenamed("id", "_id"))
    return df.join(found, id == F.col("_id")).drop("_id")


def hybrid_search(
    df: DataFrame,
    index: DataFrame,
    query: str,
    roles: Roles,
    dim: int,
    k: int = 100,
    *,
    weight: float | None = None,
    fields: Sequence[str] | None = None,
    as_of: Column | str | None = None,
    embed: Callable[[str, int], Sequence[float]] = embed_text,
) -> DataFrame:
    """(id, _score, _result_type) from the keyword side, the vector side or both.

    ``index`` is (id, embedding) with unit vectors; ids are compared as text.
    Conditions and the time span of the query hold on both sides.
    """
    as_text = F.col(roles.id).cast("string").alias("id")
    if is_structured(query):
        found = search(df, query, roles, k, as_of=as_of).select(as_text, "_score")
        return found.withColumn("_result_type", F.lit("structured"))
    text = without_counting(query) if asks_for_count(query) else query
    keyword = search(df, text, roles, k, fields, as_of).select(as_text, "_score")
    _, near = both_sides(df, index, text, roles, as_of)
    near = knn(near, "id", "embedding", embed(query, dim), k, unit=True)
    w = weight if weight is not None else query_weight(query)
    return fusion.hybrid(keyword, near, w, k)
