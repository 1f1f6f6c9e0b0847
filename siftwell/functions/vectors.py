"""Vector arithmetic on array columns and the embedding function."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.predicates import clock_seconds
from siftwell.functions.scores import NAME_WEIGHT, STATUS_WEIGHT
from siftwell.roles import Roles

DEFAULT_DIM = 768

# Functions that run in tasks travel with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def with_unit(df: DataFrame, column: str, kind: str = "float") -> DataFrame:
    """Scale ``column`` to unit length, as numbers of ``kind``; all-zero vectors stay as they are.

    The length sits in its own column, read twice, so Spark computes it once per
    row instead of once per element.
    """
    size = F.col("_norm")
    scaled = F.transform(column, lambda x: (x.cast("double") / size).cast(kind))
    return (
        df.withColumn("_norm", norm(F.col(column)))
        .withColumn(column, F.when(size > 0, scaled).otherwise(F.col(column).cast(f"array<{kind}>")))
        .drop("_norm")
    )


def literal_vector(values: Sequence[float]) -> Column:
    """One unit-length query vector as a literal, in double."""
    v = np.asarray(values, dtype=np.float64)
    size = np.linalg.norm(v)
    unit = v / size if size > 0 else v
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in unit)})")


def embed_text(text: str, dim: int = DEFAULT_DIM) -> list[float]:
    """Deterministic stand-in embedding of one string."""
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little")
    v = np.random.RandomState(seed).randn(dim).astype(np.float32)
    return (v / np.linalg.norm(v)).tolist()


Batch = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Model:
    """An embedding model of the caller's.

    ``load`` returns a function from a list of texts to one row of ``dim`` numbers
    per text. It runs where texts are embedded, once per worker process and
    ``name``, so weights are read there and never travel with a task. Texts come
    ``batch`` at a time; null texts are not embedded and stay null.
    """

    name: str
    dim: int
    load: Callable[[], Batch]
    batch: int = 1024

    def column(self, c: Column) -> Column:
        """The vectors of a text column, as array<float>."""
        load, name, dim, size = self.load, self.name, self.dim, self.batch

        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # A module of its own outlives the task, but not the worker.
            loaded = sys.modules.setdefault("_loaded_models", ModuleType("_loaded_models")).__dict__
            for texts in batches:
                if (name, dim) not in loaded:
                    loaded[name, dim] = load()
                # A run of texts at a time: a batch of Spark's may hold ten thousand long ones.
                for start in range(0, len(texts), size):
                    yield vectors(loaded[name, dim], texts.slice(start, size))

        def vectors(run: Batch, texts: pa.Array) -> pa.Array:
            given = texts.is_valid().to_numpy(zero_copy_only=False)
            present = texts.drop_null().to_pylist()
            flat = _checked(run, present, dim).ravel() if present else np.zeros(0, np.float32)
            ends = np.concatenate([[0], np.cumsum(given) * dim]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()), mask=pa.array(~given))

        return F.arrow_udf(embed, "array<float>")(c)

    def one(self, text: str, dim: int | None = None) -> list[float]:
        """The vector of one search string, by the same function."""
        if dim not in (None, self.dim):
            raise ValueError(f"the model gives {self.dim} numbers, not {dim}")
        return _checked(self.load(), [text], self.dim)[0].tolist()


def _checked(run: Batch, texts: list[str], dim: int) -> np.ndarray:
    found = np.asarray(run(texts), dtype=np.float32)
    if found.shape != (len(texts), dim):
        raise ValueError(f"the model returned {found.shape} for {len(texts)} texts of {dim} numbers")
    return found


def stand_in(dim: int = DEFAULT_DIM) -> Model:
    """:func:`embed_text` as a model: for tests, and where no model is at hand."""

    def load() -> Batch:
        def run(texts: list[str]) -> np.ndarray:
            out = np.empty((len(texts), dim), np.float32)
            for row, text in zip(out, texts):
                seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little")
                v = np.random.RandomState(seed).randn(dim).astype(np.float32)
                row[:] = v / np.linalg.norm(v)
            return out

        return run

    return Model("stand-in", dim, load)


def embedding(c: Column, dim: int = DEFAULT_DIM, model: Model | None = None) -> Column:
    """Vectors of a text column by the caller's model, else by the stand-in."""
    return (model or stand_in(dim)).column(c)


def row_text(df: DataFrame, fields: Sequence[str], weights: Mapping[str, float]) -> Column:
    """``field: value`` once per whole unit of weight, blanks and zero weights left out."""
    default = weights.get("default", 1.0)
    parts = []
    for field in fields:
        weight = weights.get(field, default)
        if weight > 0:
            value = F.col(field).cast("string")
            part = F.when(value != "", F.concat(F.lit(f"{field}: "), value))
            parts += [part] * max(1, int(weight))
    return F.concat_ws(" ", *parts)


def embedding_weights(roles: Roles) -> dict[str, float]:
    named = {roles.name: NAME_WEIGHT, roles.status: STATUS_WEIGHT}
    return {f: w for f, w in named.items() if f}


def row_text_typed(
    df: DataFrame, fields: Sequence[str], weights: Mapping[str, float], as_of: Column
) -> Column:
    """``field:value`` with the age of timestamps and kinds in place of nested values."""
    default = weights.get("default", 1.0)
    parts = []
    for field in fields:
        weight, kind, c = weights.get(field, default), df.schema[field].dataType, F.col(field)
        if weight <= 0:
            continue
        if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
            now = clock_seconds(as_of.cast("timestamp_ntz"))
            age = F.floor((now - clock_seconds(c.cast("timestamp_ntz"))) / 86400)
            shown = F.concat_ws(" ", F.date_format(c, "yyyy-MM-dd HH:mm:ss"), age, F.lit("days ago"))
            shown = F.when(c.isNotNull(), shown)
        elif kind.typeName() in ("struct", "map"):
            shown = F.when(c.isNotNull(), F.lit("object"))
        elif kind.typeName() == "array":
            shown = F.when(c.isNotNull(), F.lit("array"))
        elif kind.typeName() == "string":
            shown = (
                F.when(F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}")), "object")
                .when(F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]")), "array")
                .otherwise(c)
            )
        else:
            shown = c.cast("string")
        parts += [F.concat(F.lit(f"{field}:"), shown)] * max(1, int(weight))
    return F.concat_ws(" ", *parts)
