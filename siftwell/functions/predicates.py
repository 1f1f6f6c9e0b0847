"""Conditions -> boolean Columns.

Numbers are compared on the column's own type, so the filter reaches the Parquet
scan; only text is case-folded. Unknown fields raise before anything runs.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.terms import Condition, as_number
from siftwell.functions.text import whole
from siftwell.roles import Roles

NUMERIC = {
    "gt": operator.gt,
    "lt": operator.lt,
    "gte": operator.ge,
    "lte": operator.le,
    "eq": operator.eq,
    "neq": operator.ne,
}
#: Prefix of the lower-cased companions that ``sinks.write_searchable`` stores beside texts.
FOLDED = "_folded_"
# Fixed value: the column whose fields filters may name directly.
WRAPPER = "job_details"
# Days per unit; a month is 30 days, a year 365.
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
# Words that stand for a status or a priority.
STATUS_WORDS = ("failed", "success", "running", "completed", "pending")
PRIORITY_WORDS = ("high", "medium", "low", "critical")


def both(preds: Iterable[Column]) -> Column:
    return reduce(operator.and_, preds, F.lit(True))


def either(preds: Iterable[Column]) -> Column:
    return reduce(operator.or_, preds, F.lit(False))


def data_type(df: DataFrame, field: str) -> T.DataType:
    """Type of a column or dotted path; raises on unknown fields."""
    kind: T.DataType = df.schema
    for part in field.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            raise ValueError(f"unknown field {field!r}; columns are {df.columns}")
        kind = kind[part].dataType
    return kind


def resolve(df: DataFrame, field: str) -> str:
    """``field`` itself, else the same field inside the wrapped record."""
    if field in df.columns or "." in field or WRAPPER not in df.columns:
        return field
    inner = df.schema[WRAPPER].dataType
    known = isinstance(inner, T.StructType) and field in inner.fieldNames()
    return f"{WRAPPER}.{field}" if known else field


def is_companion(name: str, names: Sequence[str]) -> bool:
    return name.startswith(FOLDED) and name.removeprefix(FOLDED) in names


def text_columns(df: DataFrame) -> list[str]:
    names = df.columns
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not is_companion(f.name, names)]


def atomic_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    names = df.columns
    return [f.name for f in df.schema if not isinstance(f.dataType, nested) and not is_companion(f.name, names)]


def equal(df: DataFrame, field: str, value: Any) -> Column:
    """Numeric equality on numeric columns, case-insensitive equality on text.

    Where the table holds the text's folded companion, that is compared instead: a plain
    column, so the scan can pass over row groups by statistics, dictionary or Bloom filter.
    """
    kind, c = data_type(df, field), F.col(field)
    if isinstance(kind, T.StringType):
        if FOLDED + field in df.columns:
            return F.col(f"`{FOLDED}{field}`") == str(value).lower()
        return F.lower(c) == str(value).lower()
    if isinstance(kind, T.NumericType):
        if isinstance(value, str) and not re.fullmatch(r"-?\d+(\.\d+)?", value):
            return F.lit(False)
        return c == F.lit(as_number(value) if isinstance(value, str) else value)
    return c == F.lit(value).cast(kind)


def compare(df: DataFrame, field: str, op: str, value: Any) -> Column:
    """Ordered comparison; text is read as a number row by row, nulls never match."""
    kind, c = data_type(df, field), F.col(field)
    if not isinstance(value, str) and not isinstance(kind, (T.NumericType, T.StringType)):
        raise ValueError(f"field {field!r} is {kind.simpleString()} and holds no numbers")
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        c = c.try_cast("double")
        return NUMERIC[op](c, F.lit(value)) & ~F.isnan(c)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return NUMERIC[op](c, F.lit(value)) & ~F.isnan(c)
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return NUMERIC[op](c, F.lit(value).cast(kind))
    return NUMERIC[op](c, F.lit(value))


def condition(df: DataFrame, cond: Condition) -> Column:
    if cond.op == "is":
        return equal(df, cond.field, cond.value)
    return compare(df, cond.field, cond.op, cond.value)


def as_text(c: Column) -> Column:
    """A value as text; doubles in plain notation, never with an exponent below 1e20."""
    text = c.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0*$", "$1")
    # The type is known while planning, so other columns keep the plain cast only.
    is_double = F.typeof(c).isin("double", "float")
    return F.when(is_double & F.contains(text, F.lit("E")), F.coalesce(plain, text)).otherwise(text)


def contains(c: Column, text: str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(as_text(c)), F.lit(text.lower()))


def any_word(df: DataFrame, words: Sequence[str], fields: Sequence[str] | None = None) -> Column:
    """Any word inside any text column."""
    fields = fields or text_columns(df)
    return either(F.coalesce(contains(F.col(f), w), F.lit(False)) for f in fields for w in words)


def phrase_anywhere(df: DataFrame, phrase: str, fields: Sequence[str] | None = None) -> Column:
    """The whole phrase inside any column, numbers and dates read as text."""
    fields = fields or atomic_columns(df)
    return either(F.coalesce(contains(F.col(f), phrase), F.lit(False)) for f in fields)


def any_token(df: DataFrame, words: Sequence[str], fields: Sequence[str] | None = None) -> Column:
    """Any word as a whole word of any text column."""
    pattern = whole("|".join(re.escape(w.lower()) for w in words))
    fields = fields or text_columns(df)
    return either(
        F.coalesce(F.regexp_like(F.lower(F.col(f)), F.lit(pattern)), F.lit(False)) for f in fields
    )


def structured(
    df: DataFrame,
    conditions: Sequence[Condition],
    words: Sequence[str] = (),
    *,
    connective: str = "AND",
    whole_words: bool = False,
) -> Column:
    """All conditions and the keyword group, joined by one connective."""
    preds = [condition(df, c) for c in conditions]
    if words:
        preds.append(any_token(df, words) if whole_words else any_word(df, words))
    if not preds:
        return F.lit(True)
    return either(preds) if connective.upper() == "OR" else both(preds)


def operator_map(df: DataFrame, field: str, ops: Mapping[str, Any]) -> Column:
    """``{"gt": 5, "contains": "x", "in": [...]}`` on one field."""

    def one(op: str, value: Any) -> Column:
        if op == "contains":
            is_text = isinstance(data_type(df, field), T.StringType)
            return contains(F.col(field), str(value)) if is_text else F.lit(False)
        if op == "in":
            data_type(df, field)
            return F.col(field).isin(list(value))
        return compare(df, field, op, value)

    return both(one(op, v) for op, v in ops.items())


def criteria(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """Plain values match when contained in the field, case-insensitively."""

    def one(field: str, want: Any) -> Column:
        if isinstance(want, Mapping):
            return operator_map(df, field, want)
        data_type(df, field)
        return contains(F.col(field), str(want))

    return both(one(resolve(df, f), v) for f, v in filters.items())


def record_filter(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """Plain values must equal the field; operator maps as in :func:`operator_map`."""
    return both(
        operator_map(df, f, v) if isinstance(v, Mapping) else equal(df, f, v)
        for f, v in filters.items()
    )


def with_id(df: DataFrame, field: str, value: str | int) -> Column:
    """Identity on the id column; the literal is cast, never the column."""
    kind = data_type(df, field)
    if isinstance(kind, T.IntegralType):
        # As texts: "007" and "+7" are other ids than "7".
        whole_number = re.fullmatch(r"-?[1-9][0-9]*|0", str(value))
        return F.col(field) == int(value) if whole_number else F.lit(False)
    return F.col(field).cast("string") == str(value)


def within_last(
    c: Column, amount: int, unit: str, as_of: Column | datetime | str | None = None
) -> Column:
    """``c`` no older than ``amount`` units before ``as_of``, by default now."""
    days = amount * DAYS[unit.lower().rstrip("s")]
    if as_of is None:
        as_of = F.localtimestamp()
    if not isinstance(as_of, Column):
        as_of = F.lit(str(as_of)).cast("timestamp_ntz")
    return c >= as_of - F.make_dt_interval(F.lit(days))


def seconds_of(df: DataFrame, column: str) -> Column:
    """A time or number as seconds that rise with it, whatever the session time zone."""
    kind, c = data_type(df, column), F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1_000_000
    if isinstance(kind, T.DateType):
        return (F.unix_date(c) * 86400).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return clock_seconds(c)
    return c.cast("double")


def clock_seconds(c: Column) -> Column:
    """Seconds since 1970 on the clock of a timestamp without time zone."""
    day = F.unix_date(c.cast("date")).cast("long") * 86400
    return (day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)).cast("double")


def status_words(query: str, roles: Roles, priority: str | None = None) -> dict[str, str]:
    """Filters meant by bare words such as ``failed`` or ``high``."""
    found: dict[str, str] = {}
    said = set(re.findall(r"\w+", query.lower()))
    for words, column in ((STATUS_WORDS, roles.status), (PRIORITY_WORDS, priority)):
        if column:
            found.update({column: w for w in words if w in said})
    return found


def with_phrases(df: DataFrame, query: str) -> dict[str, str]:
    """``with FIELD VALUE`` where FIELD is the longest matching column name."""
    found: dict[str, str] = {}
    for rest in re.findall(r"\bwith\s+(.+?)(?=\s+with\b|$)", query.lower()):
        for name in sorted(df.columns, key=len, reverse=True):
            m = re.match(re.escape(name.lower()).replace("_", r"[_\s]") + r"\s+(.+)", rest)
            if m:
                found[name] = m[1].strip(" ?.,")
                break
    return found
