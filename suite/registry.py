"""Name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]
CASES: dict[str, tuple[Query, str | None]] = {}


class Tables:
    """The Parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]


def case(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if query.__name__ in CASES:
            raise ValueError(f"{query.__name__} is registered twice")
        CASES[query.__name__] = (query, sql)
        return query

    return add
