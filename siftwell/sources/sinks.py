"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.predicates import FOLDED
from siftwell.operators.output import csv_columns, drop_meta
from siftwell.sources.scans import escaped


def write_json(df: DataFrame, path: str, include_metadata: bool = False) -> None:
    """One JSON object per line, files written by the executors."""
    (df if include_metadata else drop_meta(df)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, include_metadata: bool = False, *, escape_breaks: bool = True) -> None:
    """CSV with header, export column order, nested values as JSON.

    Line breaks in texts are written as escapes, so that a row is a line and files
    can be split; ``read_csv(..., escaped_breaks=True)`` turns them back. Blanks around
    a text stay; an empty text is written as two quotes, a null as nothing.
    """
    rows = csv_columns(df, include_metadata)
    if escape_breaks:
        texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({c: escaped(F.col(f"`{c}`")) for c in texts})
    (
        rows
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_searchable(df: DataFrame, path: str, fields: Sequence[str], **options) -> None:
    """Parquet whose texts ``fields`` can be found by ``field:value`` without reading every row group.

    Beside each of them stands its lower-cased companion with a Bloom filter per row group
    (a dictionary, where there are few values). Conditions compare the companion wherever a
    table has one; keyword searches and scores leave it out, and ``drop_meta`` and the other
    sinks drop it. Change a text after reading and its companion must be dropped first.
    """
    for f in fields:
        if f not in df.columns or not isinstance(df.schema[f].dataType, T.StringType):
            raise ValueError(f"{f!r} is no text column; columns are {df.columns}")
    rows = df.withColumns({FOLDED + f: F.lower(F.col(f"`{f}`")) for f in fields})
    filters = {f"parquet.bloom.filter.enabled#{FOLDED}{f}": True for f in fields}
    # Filters get the size their row group needs, not the largest allowed.
    settings = {"parquet.bloom.filter.adaptive.enabled": True} | filters | options
    rows.write.mode("overwrite").options(**settings).parquet(path)
