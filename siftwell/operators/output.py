"""Shapes results leave in: ordered columns, JSON, CSV, one summary payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.roles import Roles, to_standard

FIRST = ("id", "name", "status")
NESTED = (T.ArrayType, T.MapType, T.StructType)


def drop_meta(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def shape(df: DataFrame, roles: Roles) -> DataFrame:
    """id, name, status first, then the other columns, then metadata."""
    out = to_standard(df, roles)
    head = [c for c in FIRST if c in out.columns]
    rest = [c for c in out.columns if c not in head]
    meta = [c for c in rest if c.startswith("_")]
    return out.select(*head, *[c for c in rest if c not in meta], *meta)


def shape_text(df: DataFrame, roles: Roles, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """:func:`shape` with timestamps formatted and missing values blank."""
    out = shape(df, roles)

    def show(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, pattern)
        if isinstance(f.dataType, NESTED):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return out.select(*[show(f) for f in out.schema])


def csv_columns(df: DataFrame, include_metadata: bool = False) -> DataFrame:
    """Columns in export order, nested values as JSON."""
    df = df if include_metadata else drop_meta(df)
    head = [c for c in FIRST if c in df.columns]
    names = head + sorted(c for c in df.columns if c not in head)
    nested = {f.name for f in df.schema if isinstance(f.dataType, NESTED)}
    return df.select(*[F.to_json(n).alias(n) if n in nested else n for n in names])


def payload(results: DataFrame, query: str, k: int, id_column: str = "id") -> DataFrame:
    """One JSON document about the best ``k`` results, for a language model.

    ``results`` has id, name, status, _score and _match_type; everything below
    works on the k rows left by the limit.
    """
    order = W.orderBy(F.desc("_score"), F.asc(id_column))
    top = (
        results.orderBy(F.desc("_score"), F.asc(id_column))
        .limit(k)
        .withColumn("_rank", F.row_number().over(order))
    )
    rest = [c for c in drop_meta(top).columns if c not in ("id", "name", "status")]
    item = F.struct(
        "_rank",
        F.struct(
            "id",
            "name",
            F.col("_match_type").alias("match_type"),
            F.round("_score", 4).alias("match_score"),
            "status",
            *rest,
        ).alias("item"),
    )
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    one = top.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(item)).alias("items"),
        F.array_sort(F.collect_list(status)).alias("statuses"),
    )
    kinds = F.array_distinct("statuses")

    def counted(kind: Column) -> Column:
        same = F.filter("statuses", lambda x: x == kind)
        return F.struct(kind.alias("status"), F.size(same).alias("n"))

    tally = F.transform(kinds, counted)
    first = F.get(F.col("items.item"), F.lit(0))
    shown = F.transform("tally", lambda t: F.concat_ws(" ", t.n.cast("string"), t.status))
    summary = F.array_join(shown, ", ")
    sentence = (
        F.when(
            F.col("n") == 0,
            F.lit(
                f"Nothing matches '{query}'; other words may help."
            ),
        )
        .when(
            F.col("n") == 1,
            F.concat(
                F.lit(f"One match for '{query}': "), first.getField("name"),
                F.lit(", id "), first.getField("id").cast("string"),
                F.coalesce(F.concat(F.lit(", status "), first.getField("status")), F.lit("")),
                F.lit("."),
            ),
        )
        .otherwise(
            F.concat(
                F.col("n").cast("string"), F.lit(f" matches for '{query}' ("),
                summary, F.lit("), best of all "), first.getField("name"), F.lit("."),
            )
        )
    )
    return one.withColumn("tally", tally).select(
        F.to_json(
            F.struct(
                F.lit(query).alias("query"),
                F.col("n").alias("result_count"),
                F.col("items.item").alias("results"),
                F.map_from_entries("tally").alias("result_types"),
                sentence.alias("suggested_response"),
            )
        ).alias("payload")
    )
