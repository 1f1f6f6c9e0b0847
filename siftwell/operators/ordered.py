"""Ordered work within keys, where one key may hold a large part of the rows."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import shared_folder

HOT_ROWS = 5_000_000
#: Most hot keys that go to every task.
HELD_KEYS = 100_000
#: Bits of the types that one number can stand for.
WIDTHS = {
    T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64,
    T.DateType: 32, T.TimestampType: 64, T.TimestampNTZType: 64,
}
#: Types that an aggregate can overwrite in place, so that it may hash.
IN_PLACE = (*WIDTHS, T.BooleanType, T.FloatType, T.DoubleType, T.DecimalType)


def as_whole(kind: T.DataType, c: Column) -> Column:
    """A number, date or time as a whole number of the same order."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return minutes * 60_000_000 + micros
    return c


def order_number(df: DataFrame, columns: Sequence[str]) -> Column | None:
    """``columns`` as one decimal that rises with them in turn, null first and never null itself.

    None where a type has no whole numbers or 38 digits do not hold all of them.
    """
    number, codes = F.lit(0).cast("decimal(38,0)"), 1
    for name in columns:
        kind = df.schema[name].dataType
        bits = WIDTHS.get(type(kind))
        if bits is None:
            return None
        codes *= (1 << bits) + 1
        if codes >= 10**38:
            return None
        base, lift = (F.lit(str(n)).cast("decimal(20,0)") for n in ((1 << bits) + 1, (1 << (bits - 1)) + 1))
        code = as_whole(kind, F.col(f"`{name}`")).cast("decimal(20,0)") + lift
        number = (number * base + F.coalesce(code, F.lit(0))).cast("decimal(38,0)")
    return number


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``rows`` rows, or None where there are none.

    One counting pass over the key column. A table of n rows has fewer than
    n / ``rows`` such keys; up to ``HELD_KEYS`` of them are broadcast, as a join that
    deals rows by key would send all rows of a hot one to one task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    found = counts.select(F.col(key).alias("_hot"))
    held = found.limit(HELD_KEYS + 1).count()
    if not held:
        return None
    return F.broadcast(found) if held <= HELD_KEYS else found


def parted(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys and the others; a null key is a key."""
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_semi"), df.join(hot, same, "left_anti")


def in_slices(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the range of ``order`` each row falls into, about equally many rows in each.

    Ranges come from a sample of the columns themselves, whatever their types, so
    equal values share a slice only if all of ``order`` is equal. The number of
    slices is that of shuffle partitions and the rows are written, so every later
    use sees the same slices.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id())
    path = shared_folder(df.sparkSession, "slices")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def cumulative(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    amount: Column,
    name: str,
) -> DataFrame:
    """Running total of ``amount`` within ``by``, in ``order``.

    ``bucket`` must grow with ``order``. Rows are summed inside a bucket and the
    totals of earlier buckets added, so a hot key is spread over its buckets.
    """
    keys = [*by, bucket]
    earlier = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.sum(amount).alias("_total"))
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.withColumn("_inside", F.sum(amount).over(inside))
        .join(offsets, reduce(operator.and_, same))
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", *[f"_key{i}" for i in range(len(keys))])
    )
