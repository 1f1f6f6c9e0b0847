"""What the columns of a table are: roles, types, shapes.

Names give the first hint, one pass over the whole table the evidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.roles import Roles

# Column names and name parts by role, best first.
ID_NAMES = (
    ("id", "uuid", "key"),
    ("item_id", "product_id", "user_id", "job_id", "customer_id", "document_id", "event_id"),
)
NAME_NAMES = (
    ("name", "title", "label"),
    ("product_name", "full_name", "event_name", "job_name"),
    ("summary", "description"),
)
STATUS_NAMES = (
    ("status", "state", "condition", "type"),
    ("inventory_status", "account_status", "severity"),
)
TIME_PARTS = (
    "date", "time", "created", "updated", "timestamp",
    "execution_start", "execution_end", "modified", "published",
)
NUMBER_PARTS = (
    "count", "number", "amount", "price", "quantity", "percent",
    "ratio", "duration", "minutes", "usage", "mb", "cpu",
)
TEXT_PARTS = (
    "text", "description", "comment", "note", "summary", "detail",
    "message", "error", "name", "title",
)
EXTENDED_NAMES = {
    "id": ("id", "item_id", "job_id", "document_id", "record_id", "uuid", "_id"),
    "name": ("name", "title", "job_name", "document_name", "item_name", "heading"),
    "status": ("status", "state", "condition", "job_status"),
    "category": ("category", "type", "class", "group"),
    "date": ("date", "created_at", "timestamp", "execution_start_time", "created_date"),
    "description": ("description", "content", "text", "details", "summary"),
}
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
DATE_START = r"^\d{4}-\d{2}-\d{2}"
LOG_TIME_PARTS = ("date", "time", "timestamp", "created", "updated", "modified")

TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
# Types whose text form is cheap and may read as a boolean.
SHORT = (T.BooleanType, T.IntegralType)
DISTINCT_ERROR = 0.02
MOSTLY = 0.95


def candidates(columns: Sequence[str], names: Sequence[Sequence[str]]) -> list[str]:
    """Columns that may play a role, best first.

    Exact names come before case-insensitive and partial ones; general names
    before those of one kind of thing, which go by column order.
    """
    general, *others = names
    known = [n for group in names for n in group]
    exact = [n for n in general if n in columns]
    exact += [c for group in others for c in columns if c in group]
    folded = [c for c in columns if c.lower() in known]
    partial = [c for c in columns if any(n in c.lower() for n in known)]
    return list(dict.fromkeys(exact + folded + partial))


def _has_part(column: str, parts: Sequence[str]) -> bool:
    return any(p in column.lower() for p in parts)


def profile(df: DataFrame) -> DataFrame:
    """One row per column with counts of what its values look like.

    Cells become rows first, so one small set of aggregates serves any number of
    columns; only a few states per task are shuffled. Typed columns need no parsing.
    """

    def cell(f: T.StructField) -> Column:
        c, is_text = F.col(f.name), isinstance(f.dataType, T.StringType)
        number = isinstance(f.dataType, T.NumericType)
        dated = isinstance(f.dataType, TIMES)
        return F.struct(
            F.lit(f.name).alias("column"),
            (c.isNotNull() & (c != "" if is_text else F.lit(True))).alias("filled"),
            (c if is_text or isinstance(f.dataType, SHORT) else F.lit(None)).cast("string").alias("text"),
            F.lit(number).alias("number"),
            F.lit(dated).alias("dated"),
            F.xxhash64(c).alias("hash"),
        )

    fields = [f for f in df.schema if not isinstance(f.dataType, NESTED)]
    cells = df.select(F.explode(F.array(*[cell(f) for f in fields])).alias("c"))
    filled, text = F.col("c.filled"), F.col("c.text")
    return cells.groupBy(F.col("c.column").alias("column")).agg(
        F.count("*").alias("n"),
        F.count_if(filled).alias("filled"),
        F.count_if(filled & (F.col("c.number") | F.regexp_like(text, F.lit(NUMBER)))).alias("numeric"),
        F.count_if(filled & (F.col("c.dated") | F.regexp_like(text, F.lit(DATE_START)))).alias("dated"),
        F.count_if(F.lower(text).isin(*BOOLEAN_WORDS)).alias("boolean"),
        F.approx_count_distinct(F.when(F.col("c.filled"), F.col("c.hash")), DISTINCT_ERROR).alias("distinct"),
        F.coalesce(F.max(F.length(text)), F.lit(0)).alias("longest"),
    )


def _mostly(count: str) -> Column:
    return F.col(count) >= MOSTLY * F.col("filled")


def infer_roles(df: DataFrame) -> DataFrame:
    """(column, role). Names propose; an id must be filled and nearly unique,
    a status must repeat. One column each for id, name and status."""
    unique = F.col("distinct") >= (1 - 3 * DISTINCT_ERROR) * F.col("n")
    single = {
        "id": (ID_NAMES, (F.col("filled") == F.col("n")) & unique),
        "name": (NAME_NAMES, F.col("filled") > 0),
        "status": (STATUS_NAMES, F.col("distinct") * 2 <= F.col("n")),
    }
    column = F.col("column")
    votes = []
    for role, (names, holds) in single.items():
        for rank, name in enumerate(candidates(df.columns, names)):
            vote = F.struct(F.lit(role).alias("role"), F.lit(rank).alias("rank"))
            votes.append(F.when((column == name) & holds, vote))
    for role, parts in (("timestamp", TIME_PARTS), ("numeric", NUMBER_PARTS), ("text", TEXT_PARTS)):
        for name in df.columns:
            if _has_part(name, parts):
                vote = F.struct(F.lit(role).alias("role"), F.lit(0).alias("rank"))
                votes.append(F.when(column == name, vote))
    # One row per column and role from here on.
    voted = profile(df).select("column", F.explode(F.array_compact(F.array(*votes))).alias("v"))
    best = W.partitionBy("v.role").orderBy("v.rank")
    return (
        voted.withColumn("place", F.rank().over(best))
        .filter("place = 1")
        .select("column", F.col("v.role").alias("role"))
    )


def extended_roles(df: DataFrame) -> DataFrame:
    """(role, column): first listed column name that exists and holds any value."""
    listed = [
        (role, rank, name)
        for role, names in EXTENDED_NAMES.items()
        for rank, name in enumerate(names)
        if name in df.columns
    ]
    rules = F.array(
        *[
            F.struct(F.lit(r).alias("role"), F.lit(k).alias("rank"), F.lit(n).alias("name"))
            for r, k, n in listed
        ]
    )
    return (
        profile(df)
        .filter("filled > 0")
        .select("column", F.explode(F.filter(rules, lambda r: r["name"] == F.col("column"))).alias("r"))
        .groupBy(F.col("r.role").alias("role"))
        .agg(F.min_by("column", "r.rank").alias("column"))
    )


def field_types(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """(column, type): timestamp, numeric or text by what nearly all values are."""
    forced = [c for c in (roles.name, roles.status) if c] if roles else []
    kind = (
        F.when(F.col("column").isin(forced), "text")
        .when(F.col("filled") == 0, "unknown")
        .when(_mostly("dated"), "timestamp")
        .when(_mostly("numeric"), "numeric")
        .otherwise("text")
    )
    return profile(df).select("column", kind.alias("type"))


def field_classes(df: DataFrame) -> DataFrame:
    """(column, class): empty, numeric, date, boolean or text, first match wins."""
    kind = (
        F.when(F.col("filled") == 0, "empty")
        .when(_mostly("numeric"), "numeric")
        .when(_mostly("dated"), "date")
        .when(_mostly("boolean"), "boolean")
        .otherwise("text")
    )
    return profile(df).select("column", kind.alias("class"))


def is_count_column(name: str) -> bool:
    return name.lower().startswith("count") or name.lower().endswith("count")


def is_time_column(name: str) -> bool:
    return name.lower().endswith(("_dt", "_at"))


def log_column_types(df: DataFrame) -> DataFrame:
    """(column, sql_type) for a cleaned log: name rules first, then the values."""
    counts = [c for c in df.columns if is_count_column(c)]
    times = [c for c in df.columns if is_time_column(c)]
    maybe = [c for c in df.columns if _has_part(c, LOG_TIME_PARTS)]
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType)]
    stamped = [f.name for f in df.schema if isinstance(f.dataType, TIMES)]
    column = F.col("column")
    kind = (
        F.when(column.isin(counts), "INTEGER")
        .when(column.isin(times), "TIMESTAMP")
        .when(column.isin(maybe) & (F.col("filled") > 0) & _mostly("dated"), "TIMESTAMP")
        .when(column.isin(whole), "INTEGER")
        .when(column.isin(real), "REAL")
        .when(column.isin(stamped), "TIMESTAMP")
        .otherwise("TEXT")
    )
    return profile(df).select("column", kind.alias("sql_type"))


def text_fields(df: DataFrame, roles: Roles | None = None, longer_than: int = 5) -> DataFrame:
    """Columns worth embedding: declared texts, else longer strings, name and status."""
    if roles and roles.texts:
        return profile(df).filter(F.col("column").isin(list(roles.texts))).select("column")
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    always = [c for c in (roles.name, roles.status) if c in df.columns] if roles else []
    long = F.col("column").isin(strings) & (F.col("longest") > longer_than)
    return profile(df).filter(long | F.col("column").isin(always)).select("column")


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """Distinct top-level keys over all JSON texts."""
    keys = df.select(F.explode_outer(F.json_object_keys(column)).alias("field"))
    return keys.filter("field is not null").distinct()


def analyze(df: DataFrame) -> DataFrame:
    """(column, n, filled, kind): size and completeness of every column."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    lookup = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return profile(df).select("column", "n", "filled", F.element_at(lookup, F.col("column")).alias("kind"))


def analyze_source(df: DataFrame, roles: Roles) -> DataFrame:
    """(item, name, value): what a table holds, by one scan.

    ``total`` is the number of rows; ``role`` gives the columns declared as id,
    name and status; ``role_count`` how many times, numbers and texts are declared;
    ``field`` the type of every column; ``sample`` the values, as text, of the
    row with the smallest id. Columns whose names start with ``_`` are private and
    left out of the sample. Of rows that repeat the smallest id any may be the
    sample; without any id there is none.
    """
    text = lambda value: F.lit(value).cast("string")

    def row(item: str, name: str | None, value: Column) -> Column:
        return F.struct(F.lit(item).alias("item"), text(name).alias("name"), value.alias("value"))

    public = [c for c in df.columns if not c.startswith("_")]
    record = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(public)])
    seen = df.agg(F.count("*").alias("total"), F.min_by(record, F.col(f"`{roles.id}`")).alias("record"))
    single = {"id": roles.id, "name": roles.name, "status": roles.status}
    several = {"timestamp": roles.timestamps, "numeric": roles.numerics, "text": roles.texts}
    known = [
        row("total", None, F.col("total").cast("string")),
        *[row("role", role, text(column)) for role, column in single.items()],
        *[row("role_count", role, text(str(len(columns)))) for role, columns in several.items()],
        *[row("field", f.name, text(f.dataType.simpleString())) for f in df.schema],
    ]
    sample = F.array(*[row("sample", c, F.col("record").getField(f"c{i}")) for i, c in enumerate(public)])
    rows = F.array(*known)
    if public:
        rows = F.when(F.col("record").isNull(), rows).otherwise(F.concat(rows, sample))
    return seen.select(F.inline(rows))
