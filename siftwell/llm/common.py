"""Small helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import shared_folder


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: a fixed table that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that a join may broadcast: some 10 MB on the driver.
FEW_ROWS = 50_000


def merged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, for a join that sorts and merges unless it is known to have few rows.

    Spark takes a table's size from compressed files and does not count the rows that
    an explode adds, so it may broadcast many times what its limit says.
    """
    return df if rows is not None and rows <= FEW_ROWS else df.hint("merge")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words_at(data: bytes, width: int = 8) -> np.ndarray:
    """The little-endian word that starts at every byte, as far as whole words go."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))


def parts_for(df: DataFrame, text: str, target: int) -> tuple[int, int]:
    """Bytes of all texts, and how many parts of about ``target`` bytes they make."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return total, max(1, -(-total // target))


def apart(df: DataFrame, name: str) -> str:
    """The name, with marks behind it until no column of the table has it (names ignore case)."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every level, as rows have that come back from Arrow."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def nullable_arrow(kind: pa.DataType) -> pa.DataType:
    """The same for a type of Arrow."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable_arrow(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(nullable_arrow(kind.key_type), pa.field("value", nullable_arrow(kind.item_type)))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable_arrow(kind.value_type)))
    return kind


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finishing steps of a multiplicative hash)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
