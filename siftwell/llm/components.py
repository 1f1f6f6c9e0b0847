"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import merged, written


def _toward_least(pairs: DataFrame, rows: int | None) -> DataFrame:
    """Every pair u, v with the least of u and all its partners as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(merged(least, rows), F.col("u") == F.col("w")).select("u", "v", "m")


def large_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Larger neighbours of every node are linked to the least node around it; ``rows``: most links there can be."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _toward_least(both, rows and 2 * rows).filter("v > u AND v != m")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them; ``rows``: most links there can be."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _toward_least(down, rows)
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = found.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u != v").distinct()


def are_stars(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, and that one has none itself."""
    inner = links.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("root"))
    outer = links.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("root"))
    nodes = inner.union(outer).groupBy("n").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
    return nodes.filter("down > 1 OR (down > 0 AND root > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of ``edges`` (long columns u, v).

    Steps alternate until the links are stars around their least nodes.
    Each round is written, so a lost executor costs one round at most. Nodes with
    very many links only ever meet their neighbours in joins that can be split.
    """
    now = written(edges.filter("u != v").select("u", "v").distinct(), "links")
    while True:
        rows = now.count()
        # A large star has a link at most for each end of a link.
        now = written(small_star(large_star(now, rows), 2 * rows), "stars")
        if are_stars(now):
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return nodes.union(roots)
