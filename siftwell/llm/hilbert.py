"""Documents laid out along a Hilbert curve over several metadata dimensions.

Rows near each other on the curve agree in most dimensions, so equal runs of the
sorted rows make files whose value ranges are narrow in every dimension at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import written

BITS = 16
#: Bits of a curve position.
CURVE_BITS = 62


def cell(column: str, kind: T.DataType, bits: int = BITS) -> Column:
    """Grid coordinate of a value: numbers by magnitude, anything else by a hash; null is 0.

    Numbers are quantised on a logarithmic scale over the whole range of their
    type, so no pass over the data is needed and the coordinate rises with the
    value: 512 steps per doubling for integers at 16 bits, 32 for doubles.
    """
    top = (1 << bits) - 1
    if isinstance(kind, T.NumericType):
        number = F.col(column).cast("double")
        half = (top + 1) // 2
        doublings = 64 if isinstance(kind, T.IntegralType) else 1024 if isinstance(kind, T.DoubleType) else 128
        steps = F.floor(F.least(F.log2(F.abs(number) + 1) * (half / doublings), F.lit(float(half))))
        signed = F.when(number < 0, F.lit(half) - steps).otherwise(F.lit(half) + steps)
        return F.when(number.isNull() | F.isnan(number), 0).otherwise(F.least(F.greatest(signed, F.lit(1)), F.lit(top))).cast("int")
    hashed = F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(top)) + 1
    return F.coalesce(hashed, F.lit(0)).cast("int")


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of every row of coordinates (rows x dimensions).

    The bits of all rows are taken together, from the highest: each level swaps
    or mirrors the lower bits of the first axis, then a Gray code joins the axes.
    """
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            mirrored = (x[d] & q) != 0
            swapped = np.where(mirrored, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0]) ^ swapped
            if d:
                x[d] = x[d] ^ swapped
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | (((x[d] ^ turn) >> level) & 1)
    return index


def with_curve(df: DataFrame, cells: Mapping[str, Column], name: str = "curve", bits: int = BITS) -> DataFrame:
    """Adds the curve position; the cells' columns stay, under their names."""
    if len(cells) * bits > CURVE_BITS:
        raise ValueError("dimensions times bits must be at most 62")
    placed = df.withColumns(dict(cells))
    at = [placed.columns.index(c) for c in cells]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1)
            found = pa.array(curve_index(grid, bits), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return placed.mapInArrow(add, T.StructType([*placed.schema.fields, T.StructField(name, T.LongType())]))


def in_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot``: ``shards`` runs of the ordered rows, counts at most one apart.

    Rows are sorted by ranges, so no task sees all of them; the count of every
    range is all that is gathered. Rows alike in all of ``order`` take any order.
    """
    ranged = df.repartitionByRange(*order, "doc_id").sortWithinPartitions(*order, "doc_id")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "curve")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(r.n for r in counts)
    starts, before = [], 0
    for row in counts:
        starts.append((row.part, before))
        before += row.n
    small = df.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + place
    ranked = ranged.withColumn("part", part).join(F.broadcast(small), "part").withColumn("rank", rank)
    shard = F.expr(f"int(rank * {shards} div {max(total, 1)})")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - start).drop("at", "part", "before")


def hilbert_shards(
    docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), text: str = "text"
) -> DataFrame:
    """Every document's shard and slot along the curve; texts themselves do not move.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, the cells, curve, rank,
    shard, slot. Null ids, texts and values are allowed (text: no bytes, value:
    cell 0). Repeated rows each get a slot. Dimensions missing from the table
    count as null. An empty table gives no rows, fewer rows than shards leave
    shards empty. Other columns are ignored.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    bits = min(BITS, CURVE_BITS // max(len(dimensions), 1))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    picked = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[
            (cell(c, kinds[c], bits) if c in kinds else F.lit(0)).alias(f"cell_{i}")
            for i, c in enumerate(dimensions)
        ],
    )
    cells = {f"cell_{i}": F.col(f"cell_{i}") for i in range(len(dimensions))}
    return in_runs(with_curve(picked, cells, bits=bits), ["curve"], shards)


def manifest(docs: DataFrame, placed: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Smallest and largest value of every dimension in each shard: what a reader needs to skip files."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))]
    where = placed.select(F.col("doc_id").alias("p_id"), F.col("shard").alias("p_shard"))
    return docs.join(where, F.expr("doc_id <=> p_id")).groupBy(F.col("p_shard").alias("shard")).agg(F.count("*").alias("n"), *ranges)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents themselves, one folder per shard, in curve order inside each file."""
    where = placed.select(F.col("doc_id").alias("p_id"), F.col("shard").alias("p_shard"), F.col("slot").alias("p_slot"))
    rows = docs.join(where, F.expr("doc_id <=> p_id")).drop("p_id")
    rows = rows.repartitionByRange("p_shard", "p_slot").sortWithinPartitions("p_shard", "p_slot")
    rows.drop("p_slot").write.partitionBy("p_shard").parquet(path)
