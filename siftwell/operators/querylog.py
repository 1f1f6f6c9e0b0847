"""Analysis of a table of search strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import querytext as Q


def explain_queries(log: DataFrame, query: str, as_of: Column) -> DataFrame:
    """How each search string would be handled, one column per rule."""
    q, counting = F.col(query), F.col("counting")
    return log.withColumn("counting", Q.is_counting(q)).withColumns(
        {
            "id_value": Q.id_in_query(q),
            "kind": F.when(counting, "counting").otherwise(Q.search_kind(q)),
            "count_target": F.when(counting, Q.count_target(q)),
            "search_text": F.when(counting, Q.strip_counting(q)),
            "window_start": Q.window_start(q, as_of),
            "n_filters": F.size(Q.filters(q, as_of)).cast("long"),
        }
    )


def query_filters(log: DataFrame, query: str, as_of: Column) -> DataFrame:
    """One row per (field, op, value) condition of each search string.

    The outer explode keeps Spark from adding a non-empty test that would read
    every string once more.
    """
    kept = [c for c in log.columns if c != query]
    rows = log.select(*kept, F.explode_outer(Q.filters(F.col(query), as_of)).alias("f"))
    return rows.filter("f is not null").select(*kept, "f.field", "f.op", "f.value")
