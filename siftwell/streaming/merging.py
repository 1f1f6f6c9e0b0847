"""Merging the batch folders of a streamed index, level by level.

A stream leaves one folder ``batch=N`` per micro-batch. :func:`merge_batches` brings
finished ones together in runs, newest entry per id. A run of level k holds about
``fan`` runs of level k - 1, so an entry is written again once per level, not once per
merge, and few runs are live at any time. Which runs are live stands in a manifest:
every merge appends one file to it, and the greatest version counts. That file appears
at once or not at all, so a merge that is killed before leaves the index as it was; its
run is never read.

Folders of merged batches and replaced runs stay where they are, for readers that still
hold the older manifest. Nothing reads them afterwards and they may be deleted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ENTRIES = "id string, embedding array<float>, version long, batch long"
MANIFEST = "manifest long, run string, level int, first long, last long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet below ``path``; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def live_runs(spark: SparkSession, out: str) -> list[Row]:
    """The runs of the newest manifest, oldest first: fewer than ``fan`` of each level."""
    rows = _read(spark, f"{out}/_merged/manifest", MANIFEST)
    newest = rows.agg(F.max("manifest")).scalar()
    # Two merges at a time may name one version twice; their runs hold the same entries.
    return rows.filter(F.col("manifest") == newest).orderBy("first", "run").collect()


def open_batches(spark: SparkSession, out: str, runs: list[Row]) -> DataFrame:
    """Entries of batches that no run holds; merged folders are left out by their names."""
    merged = max((r["last"] for r in runs), default=-1)
    return _read(spark, out, ENTRIES).filter(F.col("batch") > merged)


def newest_entries(entries: DataFrame) -> DataFrame:
    """Newest entry of every id; the batch number decides between equal versions."""
    entry = F.max_by(F.struct("embedding", "version", "batch"), F.struct("version", "batch"))
    return entries.groupBy("id").agg(entry.alias("e")).select("id", "e.*")


def _of_runs(spark: SparkSession, runs: list[Row]) -> list[DataFrame]:
    return [spark.read.schema(ENTRIES).parquet(r["run"]) for r in runs]


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(id, embedding, version): live runs and open batches, newest entry per id."""
    runs = live_runs(spark, out)
    return newest_entries(_together([open_batches(spark, out, runs), *_of_runs(spark, runs)])).drop("batch")


def merge_batches(spark: SparkSession, out: str, fan: int = 8) -> bool:
    """Merge finished batches once there are ``fan`` of them; says whether it did.

    Where that makes ``fan`` runs of a level, they go into the same merge, level after
    level, so each merge writes one run. The last batch is never taken, as a stream may
    still be writing it; a later one shows that those before are whole. Meant for one
    caller at a time; two at once write the same entries twice, which readers and later
    merges bring down to one.
    """
    if fan < 2:
        raise ValueError("fan is at least 2")
    runs = live_runs(spark, out)
    waiting = open_batches(spark, out, runs)
    last = waiting.agg(F.max("batch")).scalar()
    if last is None:
        return False
    finished = waiting.filter(F.col("batch") < last)
    found = finished.agg(F.count_distinct("batch").alias("n"), F.min("batch").alias("a"), F.max("batch").alias("b")).first()
    if found["n"] < fan:
        return False
    level, taken = 0, []
    while len(same := [r for r in runs if r["level"] == level]) >= fan - 1:
        taken += same
        level += 1
    path = f"{out}/_merged/runs/{uuid.uuid4().hex}"
    newest_entries(_together([finished, *_of_runs(spark, taken)])).write.parquet(path)
    first = min([found["a"], *(r["first"] for r in taken)])
    number = max((r["manifest"] for r in runs), default=0) + 1
    kept = [(number, r["run"], r["level"], r["first"], r["last"]) for r in runs if r not in taken]
    rows = [*kept, (number, path, level, first, found["b"])]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/_merged/manifest")
    return True
