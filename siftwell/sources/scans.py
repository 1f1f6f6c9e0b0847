"""Reading CSV, JSON, tables; cleaning raw logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.columns import LOG_TIME_PARTS, is_count_column, is_time_column

# Timestamp notations of raw logs, in the order tried.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?)?$"
SLASHED_TIME = r"^(\d{2})/(\d{2})/(\d{4})(?: (\d{2}):(\d{2}):(\d{2}))?$"

#: What an absent value is read as, before it becomes null; an empty text in quotes stays a text.
ABSENT = "\0null\0"
#: How CSV files are read: a header, quotes doubled.
CSV = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "nullValue": ABSENT}


def as_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    multi_line: bool = False,
    escaped_breaks: bool = False,
    **options,
) -> DataFrame:
    """CSV with a header row, quotes doubled or kept as they are; no inference pass.

    Columns are found by their names in the header, whatever their order; those
    the file lacks are null. All files of a folder must have one header, others
    raise. Foreign files with line breaks inside quotes need ``multi_line``, which
    reads each file in one task; files of ``write_csv`` hold breaks as escapes,
    stay splittable and are read with ``escaped_breaks``.
    """
    settings = CSV | {"multiLine": multi_line} | options
    wanted = spark.createDataFrame([], schema).schema
    head = spark.read.options(**settings).csv(path).columns
    if not set(head) & set(wanted.names):
        return spark.read.schema(wanted).options(**settings).csv(path)
    rows = spark.read.schema(in_header_order(head, wanted)).options(**settings, enforceSchema=False).csv(path)
    return by_header(rows, head, wanted, escaped_breaks)


def escaped(c: Column) -> Column:
    """Line breaks as backslash n and r, backslashes as backslash b."""
    for plain, coded in (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescaped(c: Column) -> Column:
    for plain, coded in (("\n", "\\n"), ("\r", "\\r"), ("\\", "\\b")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def read_csv_head(spark: SparkSession, path: str, schema: T.StructType | str, n: int) -> DataFrame:
    return read_csv(spark, path, schema).limit(n)


def read_json_records(
    spark: SparkSession,
    path: str,
    records_path: str | None = None,
    schema: T.StructType | str | None = None,
    *,
    multi_line: bool = False,
) -> DataFrame:
    """One row per object below a dotted path; anything that is no object is skipped.

    ``schema`` describes one record and is needed where records are mixed with
    other values. One document per line stays splittable; ``multi_line`` reads a
    file per task.
    """
    reader = spark.read.option("multiLine", multi_line)
    if not records_path:
        return (reader.schema(schema) if schema else reader).json(path)
    if schema is None:
        records = reader.json(path).select(F.explode(records_path).alias("r"))
        return records.filter("r is not null").select("r.*")
    # Elements are read as JSON text, so a number among the records spoils nothing.
    shape: T.DataType = T.ArrayType(T.StringType())
    for part in reversed(records_path.split(".")):
        shape = T.StructType([T.StructField(part, shape)])
    texts = reader.schema(shape).json(path).select(F.explode(records_path).alias("t"))
    objects = texts.filter(F.startswith(F.ltrim("t"), F.lit("{")))
    return objects.select(F.from_json("t", schema).alias("r")).select("r.*")


def coerce_json(df: DataFrame, timestamps: Sequence[str], pattern: str) -> DataFrame:
    """Declared timestamps parsed where the format fits, else left as text."""

    def parsed(name: str) -> Column:
        ts = F.try_to_timestamp(F.col(name), F.lit(pattern))
        return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.col(name))

    return df.withColumns({c: parsed(c) for c in timestamps})


def nested_as_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; used at output only."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str, **partitioning) -> DataFrame:
    """A database table; pass partitionColumn and bounds to read it in parallel."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, driver=driver, **partitioning)
        .load()
    )


def sample_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows; with an order the same rows every time."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def fetch_rows(df: DataFrame, max_rows: int | None = None) -> Iterator[Row]:
    """All rows one by one, a partition at a time; at most ``max_rows`` where a bound is given."""
    rows = df if max_rows is None else df.limit(max_rows)
    return rows.toLocalIterator(prefetchPartitions=True)


def stream_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    files_per_batch: int = 1,
    *,
    escaped_breaks: bool = False,
    **options,
) -> DataFrame:
    """CSV files as they arrive, a bounded number per micro-batch.

    Columns are found by the header of the files there at the start, as
    :func:`read_csv` does; a later file with another header fails the batch rather
    than mix up columns. In an empty folder the schema itself is taken for the header.
    """
    settings = CSV | options
    wanted = spark.createDataFrame([], schema).schema
    try:
        head = spark.read.options(**settings).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        head = wanted.names
    if not set(head) & set(wanted.names):
        head = wanted.names
    rows = spark.readStream.schema(in_header_order(head, wanted)).options(
        **settings, enforceSchema=False, maxFilesPerTrigger=files_per_batch
    )
    return by_header(rows.csv(path), head, wanted, escaped_breaks)


def in_header_order(head: Sequence[str], wanted: T.StructType) -> T.StructType:
    known = {f.name: f.dataType for f in wanted}
    return T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in head])


def by_header(rows: DataFrame, head: Sequence[str], wanted: T.StructType, escaped_breaks: bool) -> DataFrame:
    """The wanted columns in their order; those the header lacks are null."""

    def value(f: T.StructField) -> Column:
        if f.name not in head:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        return (unescaped(c) if escaped_breaks and isinstance(f.dataType, T.StringType) else c).alias(f.name)

    return rows.select(*[value(f) for f in wanted])


def log_time(c: Column) -> Column:
    """ISO 8601, else month/day/year, else day/month/year; null where none fits.

    Shapes are tested by pattern, so bad text never costs an exception, and the
    clock reading is kept whatever the session time zone.
    """
    first, second, year, *clock = [F.regexp_extract(c, SLASHED_TIME, i).try_cast("int") for i in range(1, 7)]
    hms = [F.coalesce(part, F.lit(0)) for part in clock]
    return F.coalesce(
        F.when(F.regexp_like(c, F.lit(ISO_TIME)), c.try_cast("timestamp_ntz")),
        F.try_make_timestamp_ntz(year, first, second, *hms),
        F.try_make_timestamp_ntz(year, second, first, *hms),
    )


def clean_log(raw: DataFrame) -> DataFrame:
    """Trim texts; counts become whole numbers (missing = 0), dates timestamps (bad = null).

    Columns that are times by the ending of their name are times; others whose
    name merely contains a word for one are times if most of their values can be
    read as such, which takes one pass over these columns.
    """
    maybe = [
        f.name
        for f in raw.schema
        if any(p in f.name.lower() for p in LOG_TIME_PARTS[:3])
        and not is_time_column(f.name)
        and not is_count_column(f.name)
    ]
    dated: set[str] = set()
    if maybe:
        text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("nan")) for c in maybe}
        read = [F.count_if(log_time(t).isNotNull()).alias(f"r{i}") for i, t in enumerate(text.values())]
        filled = [F.count_if((t != "") & t.isNotNull()).alias(f"f{i}") for i, t in enumerate(text.values())]
        seen = raw.agg(*read, *filled).first()
        dated = {c for i, c in enumerate(maybe) if seen[f"r{i}"] * 2 > seen[f"f{i}"]}

    def clean(f: T.StructField) -> Column:
        c, low = F.col(f.name), f.name.lower()
        text = F.nullif(F.trim(c.cast("string")), F.lit("nan"))
        if is_count_column(low):
            return F.coalesce(text.try_cast("double"), F.lit(0.0)).cast("long")
        if is_time_column(low) or f.name in dated:
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                return c
            return log_time(text)
        return text if isinstance(f.dataType, T.StringType) else c

    return raw.select(*[clean(f).alias(f.name) for f in raw.schema])
