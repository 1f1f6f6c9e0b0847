"""Embedding index as a table: build, save, check, search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.vectors import (
    Model,
    dot,
    embedding,
    embedding_weights,
    literal_vector,
    norm,
    row_text,
    with_unit,
)
from siftwell.operators.nearest import as_matrix, best_of, block_of, near_by_lots
from siftwell.roles import Roles

VERSION = 1
BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 32 << 20


def build_index(
    items: DataFrame,
    id_column: str,
    vector: str,
    version: str | None = None,
    data: Sequence[str] = (),
    kind: str = "float",
) -> DataFrame:
    """(id, embedding, data): unit vectors, latest version of every id.

    Vectors are kept in single precision; with ``kind`` "double" scores agree
    with those of the vectors given to all places, at twice the size.

    ``max_by`` combines before the shuffle, so an id with many versions costs
    no more than one row per task. Without a version column nothing says which of
    two rows is the later one, so an id that repeats is an error when the index
    is read.
    """
    kept = items.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull())
    entry = F.struct(F.col(vector).alias("embedding"), F.struct(id_column, *data).alias("data"))
    by_id = kept.groupBy(F.col(id_column).cast("string").alias("id"))
    if version:
        latest = by_id.agg(F.max_by(entry, F.struct(F.col(version), F.xxhash64(F.col(vector)))).alias("e"))
    else:
        repeated = F.raise_error(F.concat(F.lit("name a version column: the id repeats: "), F.col("id")))
        latest = by_id.agg(F.first(entry).alias("e"), F.count("*").alias("n"))
        latest = latest.withColumn("e", F.when(F.col("n") == 1, F.col("e")).otherwise(repeated.cast(latest.schema["e"].dataType)))
    return with_unit(latest.select("id", "e.embedding", "e.data"), "embedding", kind)


def index_table(
    df: DataFrame,
    roles: Roles,
    fields: Sequence[str],
    dim: int,
    version: str | None = None,
    model: Model | None = None,
    kind: str = "float",
) -> DataFrame:
    """Index of a whole table: weighted row text, embedded; rows without text are left out.

    ``model`` embeds the texts, the stand-in where none is given; its ``one`` is
    the function for the query side (``embed``) of the hybrid searches.
    """
    if model and model.dim != dim:
        raise ValueError(f"the model gives {model.dim} numbers, not {dim}")
    text = row_text(df, fields, embedding_weights(roles))
    rows = df.withColumn("_text", text).filter((F.col("_text") != "") & F.col(roles.id).isNotNull())
    embedded = rows.withColumn("_vector", embedding(F.col("_text"), dim, model)).drop("_text")
    data = [c for c in df.columns if c != roles.id]
    return build_index(embedded, roles.id, "_vector", version, data, kind)


def save_index(index: DataFrame, path: str, dim: int) -> None:
    """Parquet plus a one-row table of metadata, read from the written rows."""
    index.write.mode("overwrite").parquet(f"{path}/items")
    spark = index.sparkSession
    meta = spark.read.parquet(f"{path}/items").agg(
        F.lit(dim).alias("dim"), F.count("*").alias("count"), F.lit(VERSION).alias("version")
    )
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/meta")


def verify_index(index: DataFrame, dim: int, data: DataFrame | None = None) -> DataFrame:
    """One row: items, vectors of the wrong size, repeated ids, ids without data."""
    # One row per id first: everything is counted from these, so the index is read once.
    per_id = index.groupBy("id").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("embedding") != dim).alias("w"),
        F.count_if(F.col("data").isNull()).alias("d"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    checks = [
        total("n").alias("items"),
        total("w").alias("wrong_dim"),
        total("d").alias("no_data"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    ]
    if data is not None:
        known = data.select(F.col("id").alias("known")).distinct()
        per_id = per_id.join(known, F.col("id") == F.col("known"), "left")
        checks.append(total(F.when(F.col("known").isNull(), F.col("n"))).alias("orphans"))
    out = per_id.agg(*checks)
    bad = [c for c in out.columns if c != "items"]
    return out.withColumn("valid", sum((F.col(c) for c in bad), F.lit(0)) == 0)


def index_stats(index: DataFrame) -> DataFrame:
    """items, dim and approximate bytes (4 per float)."""
    return index.agg(
        F.count("*").alias("items"),
        F.max(F.size("embedding")).cast("long").alias("dim"),
        F.sum(F.size("embedding").cast("long") * 4).alias("approx_bytes"),
    )


def similarity(vector: str, query: Column) -> Column:
    """Cosine of a column and a unit query vector."""
    return F.coalesce(F.try_divide(dot(F.col(vector), query), norm(F.col(vector))), F.lit(0.0))


def knn(
    items: DataFrame,
    id_column: str,
    vector: str,
    query: Sequence[float],
    k: int,
    *,
    unit: bool = False,
) -> DataFrame:
    """Exact ``k`` nearest rows to one literal vector; every task keeps k rows.

    ``unit`` skips the norm where the stored vectors already have length 1.
    """
    q = literal_vector(query)
    score = dot(F.col(vector), q) if unit else similarity(vector, q)
    return (
        items.withColumn("_score", score)
        .drop(vector)
        .orderBy(F.desc("_score"), F.asc(id_column))
        .limit(k)
    )


def knn_batch(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact ``k`` nearest items for every query, both sides (id, embedding).

    A query set below ``broadcast_bytes`` goes to every task and the items are
    never shuffled. For a larger one the items are dealt to centres and a query
    visits only lots that may hold nearer ones (:func:`nearest.near_by_lots`);
    ``block_bytes`` is the size of a lot. Either way only the best k per block
    leave a task. Ids of items are unique, as :func:`build_index` leaves them. A
    vector with nulls or numbers that are not finite counts as a zero vector,
    whose similarity is 0.
    """
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    filled = F.col("id").isNotNull() & F.col("embedding").isNotNull()
    items = items.filter(filled).select("id", vector)
    queries = queries.filter(filled).select(F.col("id").alias("query_id"), vector)
    id_kind, query_kind = items.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, _score double"

    size = queries.agg(F.coalesce(F.sum(F.size("embedding") * 4 + 8), F.lit(0)).alias("bytes")).first()
    if size["bytes"] <= broadcast_bytes:
        held = queries.toArrow().combine_chunks()
        query_ids = held["query_id"].combine_chunks()
        matrix = as_matrix(held["embedding"].combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    yield from best_of(query_ids, matrix, block_of(batch["id"], as_matrix(batch["embedding"]), k), k)

        near = items.mapInArrow(scan, schema)
    else:
        near, _ = near_by_lots(items, queries, k, block_bytes)
    order = W.partitionBy("query_id").orderBy(F.desc("_score"), F.asc("id"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def group_centres(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key: one small state per key and position, combined in each task."""
    cells = df.select(F.col(key).alias("id"), F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy("id", "pos").agg(F.avg("x").alias("mean"))
    # One row per position of a vector is left for each key.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("id").agg(ordered.getField("mean").cast("array<float>").alias("embedding"))
