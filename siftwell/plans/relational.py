"""Common relational questions as DataFrame plans.

``facts`` may hold a third of its rows under one key: they are aggregated per
key before any join, which combines inside each task first, so the join sees
one row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.predicates import seconds_of
from siftwell.operators.ordered import HOT_ROWS, IN_PLACE, cumulative, hot_keys, in_slices, order_number, parted
from siftwell.session import shared_folder


@dataclass(frozen=True)
class SqlResult:
    """What became of a statement; ``data`` is lazy and empty where it failed."""

    success: bool
    data: DataFrame
    error: str | None
    columns: tuple[str, ...]

    @property
    def row_count(self) -> int:
        return self.data.count()


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def only_query(spark: SparkSession, sql: str, params: Sequence[Any] | Mapping[str, Any] | None = None) -> str:
    """The statement if it is a query, else an error: nothing but a query can stand in a subquery.

    Only the subquery is analysed here, so a command is never run.
    """
    sql = sql.strip().rstrip(";")
    try:
        spark.sql(f"SELECT * FROM (\n{sql}\n) AS q", args=params or {})
    except ParseException as error:
        raise ValueError("only SELECT statements are run") from error
    return sql


def capped_sql(
    spark: SparkSession,
    sql: str,
    max_rows: int,
    params: Sequence[Any] | Mapping[str, Any] | None = None,
) -> DataFrame:
    """A SELECT with bound parameters and an exact row cap, which the caller names."""
    return spark.sql(only_query(spark, sql, params), args=params or {}).limit(max_rows)


def sql_result(
    spark: SparkSession,
    sql: str,
    max_rows: int | None = None,
    params: Sequence[Any] | Mapping[str, Any] | None = None,
) -> SqlResult:
    """A query's rows, written to the shared folder, or its error; never raises for a faulty statement."""
    schema = T.StructType()
    try:
        rows = spark.sql(only_query(spark, sql, params), args=params or {})
        schema = rows.schema
        rows = rows if max_rows is None else rows.limit(max_rows)
        path = shared_folder(spark, "sql")
        # Names may repeat or be such as files refuse, so columns are written by number.
        plain = rows.toDF(*[f"c{i}" for i in range(len(schema))])
        plain.write.parquet(path)
        kept = spark.read.schema(plain.schema).parquet(path).toDF(*schema.names)
        return SqlResult(True, kept, None, tuple(schema.names))
    except (PySparkException, ValueError) as error:
        return SqlResult(False, spark.createDataFrame([], schema), str(error), tuple(schema.names))


def many_sql(spark: SparkSession, statements: Mapping[str, str]) -> dict[str, DataFrame]:
    """One result per named statement, in order; one that fails, also while it runs, gives an empty one."""
    return {name: sql_result(spark, sql).data for name, sql in statements.items()}


def many_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(name, count): several counting queries over one table in a single scan."""
    cells = [
        F.struct(F.lit(n).alias("name"), F.count_if(c).alias("count")) for n, c in conditions.items()
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def previous_month_count(facts: DataFrame, ts: str, as_of: Column) -> DataFrame:
    start = F.date_trunc("month", as_of).cast("timestamp_ntz")
    before = F.add_months(start, -1).cast("timestamp_ntz")
    return facts.filter((F.col(ts) >= before) & (F.col(ts) < start)).agg(F.count("*").alias("count"))


def money(c: str | Column, scale: int | None = None) -> Column:
    """An amount as it is, or as an exact decimal of ``scale`` places where the caller names them.

    Decimal and whole columns add up exactly anyway. Sums of doubles depend in
    their last digits on the order in which rows arrive; with a scale they do not.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c if scale is None else c.cast(f"decimal({min(38, 20 + scale)},{scale})")


def per_key(facts: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    return facts.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])


def totals_per_entity(
    entities: DataFrame, key: str, facts: DataFrame, fact_key: str, amount: str, scale: int | None = None
) -> DataFrame:
    """Every entity with its summed amount, 0 where it has no facts."""
    sums = per_key(facts, fact_key, _sum=F.sum(money(amount, scale)))
    joined = entities.join(sums, entities[key] == sums[fact_key], "left").drop(fact_key)
    return joined.withColumn("total", F.coalesce("_sum", F.lit(0)).cast("double")).drop("_sum")


def ranked_entities(
    entities: DataFrame,
    key: str,
    facts: DataFrame,
    fact_key: str,
    amount: Column,
    n: int,
    *,
    lowest: bool = False,
) -> DataFrame:
    """The ``n`` entities with the highest or lowest summed amount."""
    sums = per_key(facts, fact_key, total=F.sum(amount))
    joined = entities.join(sums, entities[key] == sums[fact_key]).drop(fact_key)
    by = F.asc("total") if lowest else F.desc("total")
    return joined.orderBy(by, F.asc(key)).limit(n).withColumn("total", F.col("total").cast("double"))


def by_month(facts: DataFrame, ts: str) -> DataFrame:
    return facts.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("count"))


def average_per_key(facts: DataFrame, key: str, amount: str, scale: int | None = None) -> DataFrame:
    return per_key(facts, key, average=F.sum(money(amount, scale)).cast("double") / F.count(amount))


def sales_by_name(
    products: DataFrame, key: str, name: str, facts: DataFrame, fact_key: str, amount: Column, scale: int | None = None
) -> DataFrame:
    """Summed amount per product name."""
    sums = per_key(facts, fact_key, _sum=F.sum(money(amount, scale)))
    joined = products.join(sums, products[key] == sums[fact_key])
    return joined.groupBy(name).agg(F.sum("_sum").cast("double").alias("sales"))


def above_average(facts: DataFrame, key: str, amount: str, scale: int | None = None) -> DataFrame:
    """Keys whose sum exceeds the mean of all sums (HAVING over a scalar subquery)."""
    sums = per_key(facts, key, total=F.sum(money(amount, scale)).cast("double"))
    return sums.filter(F.col("total") > sums.agg(F.avg("total")).scalar())


def last_days(facts: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    return facts.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def this_month(facts: DataFrame, ts: str, as_of: Column) -> DataFrame:
    return facts.filter(F.col(ts) >= F.date_trunc("month", as_of).cast("timestamp_ntz"))


def year_over_year(facts: DataFrame, ts: str, amount: str, scale: int | None = None) -> DataFrame:
    """Sum per year beside the year before; the window sees one row per year."""
    years = facts.groupBy(F.year(ts).alias("year")).agg(F.sum(money(amount, scale)).cast("double").alias("total"))
    before = F.lag("total").over(W.orderBy("year"))
    return years.withColumn("previous", before).withColumn(
        "change", F.try_divide(F.col("total") - F.col("previous"), F.col("previous"))
    )


def _keys(facts: DataFrame, fact_key: str) -> DataFrame:
    return facts.select(fact_key).distinct()


def without(entities: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Entities that have no facts (NOT EXISTS, LEFT JOIN ... IS NULL)."""
    keys = _keys(facts, fact_key)
    return entities.join(keys, entities[key] == keys[fact_key], "left_anti")


def having(entities: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Entities that have facts (EXISTS, IN)."""
    keys = _keys(facts, fact_key)
    return entities.join(keys, entities[key] == keys[fact_key], "left_semi")


def latest(facts: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Latest row of every key: a running maximum, combined in each task first.

    Where the order columns make one number and the kept columns have a fixed width,
    the maximum is overwritten in place and Spark hashes. Otherwise the kept row is a
    struct, and Spark sorts each task's rows by key for that. Nulls in the order come
    first; of rows equal in all order columns one whole row is kept, whichever is met first.
    """
    number = order_number(facts, order)
    if number is not None and all(isinstance(facts.schema[c].dataType, IN_PLACE) for c in columns):
        place = "_order" + "_" * max(map(len, facts.columns))  # longer than any name there
        kept = [F.max_by(F.col(f"`{c}`"), place).alias(c) for c in columns]
        return facts.withColumn(place, number).groupBy(key).agg(*kept)
    row = F.struct(*columns)
    return facts.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r")).select(key, "r.*")


def ranks(df: DataFrame, key: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rank and dense_rank by descending value within ``key``, nulls last.

    Keys of ordinary size are ranked by a window. For hot keys the values are
    counted first, so ties are one row, and cut into slices whose totals carry
    over, so no task sorts a whole key.
    """
    falling = W.partitionBy(key).orderBy(F.desc(value))

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "rank": F.rank().over(falling).cast("long"),
                "dense_rank": F.dense_rank().over(falling).cast("long"),
            }
        )

    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return plain(df)
    large, small = parted(df, key, hot)
    counts = large.groupBy(key, value).agg(F.count("*").alias("_n"))
    order = [F.desc(value)]
    counts = in_slices(counts, [F.col(key), *order], "_slice")
    upto = cumulative(counts, [key], "_slice", order, F.col("_n"), "_upto")
    distinct = cumulative(upto, [key], "_slice", order, F.lit(1), "dense_rank")
    places = distinct.select(
        F.col(key).alias("_key"),
        F.col(value).alias("_value"),
        (F.col("_upto") - F.col("_n") + 1).alias("rank"),
        "dense_rank",
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(value).eqNullSafe(F.col("_value"))
    ranked = large.join(places, same).drop("_key", "_value")
    return plain(small).unionByName(ranked)


def running_total(
    facts: DataFrame,
    key: str,
    ts: str,
    tie: str,
    amount: str,
    name: str = "running",
    hot_rows: int = HOT_ROWS,
    scale: int | None = None,
) -> DataFrame:
    """Cumulative amount per key in time order.

    Keys of ordinary size are summed by a window; hot keys slice by slice of
    time, the totals carried over.
    """
    rows, hot = facts.withColumn("_at", seconds_of(facts, ts)), hot_keys(facts, key, hot_rows)
    so_far = W.partitionBy(key).orderBy("_at", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    large, plain = (None, rows) if hot is None else parted(rows, key, hot)
    out = plain.withColumn(name, F.sum(money(amount, scale)).over(so_far))
    if hot is not None:
        parts = in_slices(large, [F.col(key), F.col("_at"), F.col(tie)], "_slice")
        large = cumulative(parts, [key], "_slice", ["_at", tie], money(amount, scale), name)
        out = out.unionByName(large.drop("_slice"))
    return out.withColumn(name, F.col(name).cast("double")).drop("_at")


def segments(
    entities: DataFrame,
    key: str,
    facts: DataFrame,
    fact_key: str,
    amount: str,
    ts: str,
    as_of: Column,
    high: float = 1000.0,
    recent_days: int = 30,
    scale: int | None = None,
) -> DataFrame:
    """high-value, recent, active or inactive, from spending and last activity."""
    sums = per_key(facts, fact_key, _total=F.sum(money(amount, scale)), _last=F.max(ts))
    joined = entities.join(sums, entities[key] == sums[fact_key], "left")
    recent = F.col("_last") >= as_of - F.make_dt_interval(F.lit(recent_days))
    segment = (
        F.when((F.col("_total") > high) & recent, "high-value recent")
        .when(F.col("_total") > high, "high-value")
        .when(F.col("_total").isNotNull(), "active")
        .otherwise("inactive")
    )
    return joined.select(entities[key], segment.alias("segment"))


def share_of_total(facts: DataFrame, segment: str, amount: str, scale: int | None = None) -> DataFrame:
    """Sum and share of the grand total per segment; no share where the total is zero.

    The total is the sum of the segments' sums, combined in each task.
    """
    sums = per_key(facts, segment, revenue=F.sum(money(amount, scale)))
    total = sums.agg(F.sum("revenue")).scalar()
    return sums.withColumn("_all", total.cast("double")).select(
        segment,
        F.col("revenue").cast("double").alias("revenue"),
        F.try_divide(F.col("revenue").cast("double"), F.col("_all")).alias("share"),
    )
