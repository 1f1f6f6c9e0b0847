"""Keyword and vector results brought together.

Both sides are (id, _score) and are cut to their best k before anything else;
whether a side is empty is part of the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the published reciprocal-rank constant.
RANK_CONSTANT = 60


def _ranked(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("_score"), F.asc("id")).limit(k)


def _side_by_side(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """(id, k, v) with each side's peak and size, every side scanned once.

    The window covers at most 2k rows: both inputs are limited first.
    """
    none = F.lit(None).cast("double")
    left = _ranked(keyword, k).select("id", F.col("_score").cast("double").alias("k"), none.alias("v"))
    right = _ranked(vector, k).select("id", none.alias("k"), F.col("_score").cast("double").alias("v"))
    rows = left.unionByName(right).groupBy("id").agg(F.max("k").alias("k"), F.max("v").alias("v"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def peak(side: str) -> Column:
        best = F.max(side).over(everything)
        return F.when(best > 0, best).otherwise(1.0)

    return rows.withColumns(
        {
            "peak_k": peak("k"),
            "peak_v": peak("v"),
            "n_k": F.count("k").over(everything),
            "n_v": F.count("v").over(everything),
        }
    )


def _weighted(rows: DataFrame, weight: float | Column) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return rows.withColumns(
        {
            "_structured_score": F.coalesce("k", F.lit(0.0)) / F.col("peak_k"),
            "_vector_score": F.coalesce("v", F.lit(0.0)) / F.col("peak_v"),
        }
    ).withColumn("_combined_score", (1 - w) * F.col("_structured_score") + w * F.col("_vector_score"))


def fuse_weighted(keyword: DataFrame, vector: DataFrame, weight: float | Column, k: int) -> DataFrame:
    """``(1-w) * keyword + w * vector`` on scores divided by their maximum."""
    scores = _weighted(_side_by_side(keyword, vector, k), weight).select(
        "id", "_structured_score", "_vector_score", "_combined_score",
        F.col("_combined_score").alias("_score"),
    )
    return _ranked(scores, k)


def hybrid(keyword: DataFrame, vector: DataFrame, weight: float | Column, k: int) -> DataFrame:
    """:func:`fuse_weighted`; where one side is empty, the other with its raw scores."""
    rows = _weighted(_side_by_side(keyword, vector, k), weight)
    fused = (F.col("n_k") > 0) & (F.col("n_v") > 0)
    kind = F.when(F.col("k").isNull(), "vector").when(F.col("v").isNull(), "structured").otherwise("both")
    return _ranked(
        rows.select(
            "id",
            F.when(fused, F.col("_combined_score")).otherwise(F.coalesce("k", "v")).alias("_score"),
            kind.alias("_result_type"),
        ),
        k,
    )


def hybrid_scores(keyword: DataFrame, vector: DataFrame, weight: float | Column, k: int) -> DataFrame:
    """:func:`hybrid` with the scaled score of either side and both together."""
    rows = _weighted(_side_by_side(keyword, vector, k), weight)
    kind = F.when(F.col("k").isNull(), "vector").when(F.col("v").isNull(), "structured").otherwise("both")
    fused = (F.col("n_k") > 0) & (F.col("n_v") > 0)
    score = F.when(fused, F.col("_combined_score")).otherwise(F.coalesce("k", "v"))
    scores = ("_structured_score", "_vector_score", "_combined_score")
    return _ranked(rows.select("id", *scores, score.alias("_score"), kind.alias("_result_type")), k)


def fuse_sequential(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Keyword results first, then vector results not already shown."""
    keyword, vector = _ranked(keyword, k), _ranked(vector, k)
    rest = vector.join(keyword.select("id"), "id", "left_anti")
    tiers = keyword.select("id", "_score", F.lit(0).alias("tier")).unionByName(
        rest.select("id", "_score", F.lit(1).alias("tier"))
    )
    return tiers.orderBy("tier", F.desc("_score"), "id").limit(k)


def fuse_by_rank(keyword: DataFrame, vector: DataFrame, k: int, constant: int = RANK_CONSTANT) -> DataFrame:
    """Sum of 1 / (constant + rank) over both sides."""

    def ranks(side: DataFrame, name: str) -> DataFrame:
        # At most k rows: the window sits on top of a limit.
        order = W.orderBy(F.desc("_score"), F.asc("id"))
        return _ranked(side, k).select("id", F.row_number().over(order).alias(name))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))

    both = ranks(keyword, "rk").join(ranks(vector, "rv"), "id", "full_outer")
    return _ranked(both.select("id", (share("rk") + share("rv")).alias("_score")), k)
