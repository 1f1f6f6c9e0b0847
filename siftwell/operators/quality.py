"""Data-quality and exploratory checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.operators.quantiles import exact_quantiles


def completeness(df: DataFrame) -> DataFrame:
    """(column, n, nulls, complete): one aggregate over all columns."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count("*").alias("n"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
        )
        for c in df.columns
    ]
    rows = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return rows.withColumn("complete", F.try_divide(F.col("n") - F.col("nulls"), F.col("n")))


def duplicates(df: DataFrame, keys: Sequence[str | Column], digest: bool = False) -> DataFrame:
    """Groups of equal rows with their size.

    ``digest`` groups long texts by their SHA-256, so the shuffle moves 64
    characters per distinct text and task.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    if digest:
        whole = columns[0] if len(columns) == 1 else F.to_json(F.struct(*columns))
        columns = [F.sha2(whole, 256).alias("digest")]
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).filter("copies > 1")


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, mean, stddev, min, max) and exact quartiles."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("stddev"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    rows = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    quartiles = exact_quantiles(df, columns, probs).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in probs]
    )
    # One row per column on both sides.
    return rows.join(quartiles, "column")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share) of one column."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    # The total is that of the counts, so the table is read once.
    sizes = counts.select(F.col("count").alias("n"))
    return counts.withColumn("share", F.col("count") / sizes.agg(F.sum("n")).scalar())


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair, from one aggregate."""
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"))
        for a, b in combinations_with_replacement(columns, 2)
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, others: str = "others") -> DataFrame:
    """Counts of ``row`` by the given ``column`` values; all other values, null too, count under ``others``."""
    cells = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    rest = F.count_if(~F.coalesce(F.col(column).isin(list(values)), F.lit(False))).alias(others)
    return df.groupBy(row).agg(*cells, rest)


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    s = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    z = F.try_divide(F.col(column) - s.getField("m"), s.getField("s"))
    return df.withColumn("z", z).filter(F.abs("z") > threshold)


def iqr_outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows further than ``reach`` interquartile ranges outside the exact quartiles.

    The two quartiles become literals, so the filter reaches the scan.
    """
    found = {r.prob: r.value for r in exact_quantiles(df, [column], [0.25, 0.75]).collect()}
    if not found:
        return df.limit(0)
    q1, q3 = found[0.25], found[0.75]
    return df.filter((F.col(column) < q1 - reach * (q3 - q1)) | (F.col(column) > q3 + reach * (q3 - q1)))


def spikes(df: DataFrame, ts: str, key: str, days: int = 7, factor: float = 2.0) -> DataFrame:
    """Days on which a key's count leaves the band of the ``days`` days before.

    Rows are counted per key and day first; the windows see one row per day. Days
    without rows between a key's first and last day count as 0, in a band and as a
    day judged; days whose band would start before the first day are not judged.
    """
    daily = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).filter(F.col("day").isNotNull())
    # Of a gap only the first and last days are made: bands within it hold zeros alone.
    following = F.lead("day").over(W.partitionBy(key).orderBy("day"))
    late = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda i: F.col("_gap") - i)
    steps = F.filter(F.concat(F.sequence(F.lit(0), F.lit(days)), late), lambda i: (i >= 0) & (i < F.col("_gap")))
    filled = (
        daily.withColumn("_gap", F.coalesce(F.datediff(following, "day"), F.lit(1)))
        .withColumn("_step", F.explode(F.array_distinct(steps)))
        .select(
            key,
            F.date_add("day", F.col("_step")).alias("day"),
            F.when(F.col("_step") == 0, F.col("n")).otherwise(F.lit(0)).alias("n"),
        )
    )
    before = W.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    band = filled.withColumns(
        {
            "seen": F.count("*").over(before),
            "mean": F.avg("n").over(before),
            "sd": F.stddev_samp("n").over(before),
        }
    )
    out = F.abs(F.col("n") - F.col("mean")) > factor * F.col("sd")
    return band.filter((F.col("seen") == days) & out).drop("seen")


def mahalanobis(df: DataFrame, x: str, y: str) -> DataFrame:
    """Squared Mahalanobis distance of two columns, closed-form 2x2 inverse."""
    m = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.struct(
            F.avg(x).alias("mx"), F.avg(y).alias("my"),
            F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"),
            F.covar_samp(x, y).alias("c"),
        )
    ).scalar()
    mx, my, vx, vy, c = (m.getField(f) for f in ("mx", "my", "vx", "vy", "c"))
    dx, dy = F.col(x) - mx, F.col(y) - my
    d2 = F.try_divide(vy * dx * dx - 2 * c * dx * dy + vx * dy * dy, vx * vy - c * c)
    return df.withColumn("d2", d2)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): rows failing each rule, all rules in one pass."""
    cells = [
        F.struct(F.lit(name).alias("rule"), F.count_if(~ok).alias("violations"))
        for name, ok in rules.items()
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
