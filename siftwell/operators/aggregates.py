"""Counts, histograms, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import predicates as P
from siftwell.functions import scores as S
from siftwell.functions.terms import group_field, read_terms, without_counting
from siftwell.operators.quantiles import exact_quantiles
from siftwell.operators.search import in_span
from siftwell.roles import Roles

SAMPLES = 5
# Name parts of columns that can stand in for a status.
STATUS_PARTS = ("status", "state", "type")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def count_matching(df: DataFrame, query: str, *, connective: str = "AND") -> DataFrame:
    """Rows meeting the conditions of ``query``; its keywords are ignored."""
    conds, _ = read_terms(query)
    return count_rows(df.filter(P.structured(df, conds, connective=connective)))


def counted_rows(
    df: DataFrame, query: str, roles: Roles, as_of: Column | str | None = None
) -> DataFrame:
    """Rows a counting query is about: its conditions, else its words, plus its time span."""
    conds, _ = read_terms(query.replace("?", " "))
    text, df = without_counting(query), in_span(df, query, roles, as_of)
    if conds:
        return df.filter(P.structured(df, conds))
    if not text:
        return df
    return df.filter(S.text_score(df, text, roles, fields=P.text_columns(df)) > 0)


def count_query(
    df: DataFrame, query: str, roles: Roles, as_of: Column | str | None = None
) -> DataFrame:
    """Exact count plus the first few matching ids, in one row."""
    rows = counted_rows(df, query, roles, as_of)
    first = rows.select(roles.id).orderBy(roles.id).limit(SAMPLES)
    sample = first.agg(F.array_sort(F.collect_list(roles.id))).scalar()
    return count_rows(rows).select(F.lit(query).alias("query"), "count", sample.alias("sample"))


def count_query_groups(
    df: DataFrame, query: str, roles: Roles, as_of: Column | str | None = None
) -> DataFrame:
    """Histogram over the ``group by`` field of a counting query."""
    field = group_field(query)
    if field is None:
        raise ValueError("the query has no group by")
    P.data_type(df, field)
    return count_by(counted_rows(df, query, roles, as_of), field)


def count_by(df: DataFrame, field: str | Column, name: str = "value") -> DataFrame:
    """Histogram of a field read as text, missing values as ``unknown``."""
    c = F.col(field) if isinstance(field, str) else field
    return df.groupBy(F.coalesce(c.cast("string"), F.lit("unknown")).alias(name)).agg(
        F.count("*").alias("count")
    )


def as_number(df: DataFrame, field: str) -> Column:
    """Field read as double; text that is no finite number becomes null."""
    c = F.col(field)
    if isinstance(P.data_type(df, field), T.StringType):
        c = c.try_cast("double")
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def field_statistics(df: DataFrame, field: str) -> DataFrame:
    """count, min, max, sum, avg and exact median of the numeric values."""
    v = F.col("v")
    values = df.select(as_number(df, field).alias("v")).filter("v is not null")
    median = exact_quantiles(values, ["v"], [0.5]).select("value")
    return values.agg(
        F.count(v).alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(v).alias("sum"),
        F.avg(v).alias("avg"),
    ).withColumn("median", median.scalar())


def summarize(results: DataFrame, id_column: str, name: str, status: str) -> DataFrame:
    """(part, key, count): total, top result, rows per status and per result type."""
    kind = "_result_type"
    counts = results.groupingSets([[], [F.col(status)], [F.col(kind)]], status, kind).agg(
        F.grouping_id().alias("g"), F.count("*").alias("count")
    )
    top = (
        results.orderBy(F.desc("_score"), F.asc(id_column))
        .limit(1)
        .select(F.concat_ws(" ", F.col(id_column).cast("string"), F.col(name)))
        .scalar()
    )
    g = F.col("g")
    return counts.select(
        F.when(g == 3, "total").when(g == 1, "status").otherwise("result_type").alias("part"),
        F.coalesce(
            F.when(g == 3, top).when(g == 1, F.col(status)).otherwise(F.col(kind)), F.lit("unknown")
        ).alias("key"),
        "count",
    )


def status_counts(results: DataFrame, status: str | None = None) -> DataFrame:
    """(status, count); without a status column the first one named like a status serves."""
    if status is None or status not in results.columns:
        like = [c for c in results.columns if any(p in c.lower() for p in STATUS_PARTS)]
        status = next(iter(like), None)
    return count_by(results, F.lit(None) if status is None else status, "status")
