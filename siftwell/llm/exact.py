"""Exact duplicates by recipes of content-defined chunks.

Texts are cut where their own bytes say so, each distinct chunk travels once per
task to be compared byte by byte with the chunks that share its digest, and from
then on documents are compared by their short ordered lists of identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart, merged, texts_of, words_at, written

LEAST, MOST = 2048, 65536
#: One position in 4096 is a cut.
CUT_BITS = 12
MARK = np.uint64(0x9FB21C651E98DF25)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; a function of the content alone, so equal texts are cut alike."""
    n = len(data)
    if n <= LEAST:
        return [n]
    found = np.flatnonzero((words_at(data) * MARK) >> np.uint64(64 - CUT_BITS) == 0) + 8
    ends, start = [], 0
    for end in [*found.tolist(), n]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end == n or end - start >= LEAST:
            if end > start:
                ends.append(end)
            start = end
    return ends


def chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def recipe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        yield pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                "text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                "recipe": pa.array([[digest(c) for c in chunks(x)] for x in texts], pa.list_(pa.binary())),
            }
        )


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk once per task."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, contents = [], []
        for text in texts_of(batch.column(0)):
            for chunk in chunks(text):
                key = digest(chunk)
                if key not in seen:
                    seen.add(key)
                    digests.append(key)
                    contents.append(chunk)
        yield pa.record_batch({"digest": pa.array(digests, pa.binary()), "content": pa.array(contents, pa.binary())})


def shared_digests(docs: DataFrame, text: str) -> DataFrame:
    """Digests under which different chunks were found: empty unless the hash failed."""
    sent = docs.select(text).mapInArrow(chunk_rows, "digest binary, content binary")
    distinct = sent.repartition("digest").groupBy("digest", "content").agg(F.lit(1).alias("one"))
    return distinct.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the document of equal text that stays.

    Columns: doc_id, keep_id (largest id of the group), group_size, kept,
    text_sha256, n_bytes, n_chunks, row (a number of its own for each row).
    Null texts count as empty, and empty texts are equal. A null id is smaller
    than any other. Where one id repeats with the same text, exactly one of
    these rows is kept. Other columns are ignored; an empty table gives none.
    """
    picked = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, text_sha256 string, recipe array<binary>"
    recipes = picked.mapInArrow(recipe_rows, schema).withColumn("row", F.monotonically_increasing_id())
    recipes = written(recipes, "recipes").withColumn("apart", F.lit(None).cast("binary"))
    unsure = written(shared_digests(picked, "text"), "unsure-chunks")
    if not unsure.isEmpty():
        recipes = told_apart(recipes, picked, unsure)
    same = ["recipe", "apart"]
    groups = recipes.groupBy(*same).agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    )
    groups = groups.select(*[F.col(c).alias(f"g_{c}") for c in same], "keep", "group_size")
    matched = recipes.join(merged(groups, recipes.count()), F.expr("recipe = g_recipe AND apart <=> g_apart"))
    return matched.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.size("recipe").alias("n_chunks"),
        "row",
    )


def told_apart(recipes: DataFrame, docs: DataFrame, unsure: DataFrame) -> DataFrame:
    """Documents with a chunk whose digest is ambiguous are compared by their whole text as well."""
    affected = (
        recipes.select("doc_id", "row", "text_sha256", F.explode("recipe").alias("digest"))
        .join(unsure, "digest", "left_semi")
        .select("doc_id", "row", "text_sha256")
        .distinct()
    )
    whole = docs.select(F.col("doc_id").alias("t_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t_text"))
    whole = whole.withColumn("t_sha", F.sha2("t_text", 256))
    found = affected.join(merged(whole), F.expr("doc_id <=> t_id AND text_sha256 = t_sha")).select(
        F.col("row").alias("t_row"), "t_text"
    )
    found = found.groupBy("t_row").agg(F.max("t_text").alias("t_text"))
    return recipes.drop("apart").join(merged(found), F.col("row") == F.col("t_row"), "left").select(
        *[c for c in recipes.columns if c != "apart"], F.col("t_text").alias("apart")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; texts do not travel unless an id repeats.

    Of equal texts the largest id stays, a null one only if there is no other; null
    texts count as empty. Of rows with one id and equal texts one stays. An empty
    table gives no rows; other columns may have any names and types.
    """
    k_id, k_sha, k_text = (apart(docs, c) for c in ("k_id", "k_sha", "k_text"))
    own = docs.select("doc_id", "text")
    kept = exact_groups(own).filter("kept")
    times = written(kept.select(F.col("doc_id").alias(k_id)).distinct(), "kept-ids")
    repeated = own.groupBy(F.col("doc_id").alias(k_id)).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.select(k_id), "repeated-ids")
    same = F.col("doc_id").eqNullSafe(F.col(k_id))
    stay = docs.join(merged(times, times.count()), same, "left_semi")
    if repeated.isEmpty():
        return stay
    repeated = merged(repeated, repeated.count())
    # One row of every text whose kept id repeats; equal texts under one id are one document.
    chosen = exact_groups(own).filter("kept").select(F.col("doc_id").alias(k_id), F.col("text_sha256").alias(k_sha))
    both = same & (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col(k_sha))
    once = stay.join(repeated, same, "left_semi").join(merged(chosen), both, "left_semi")
    once = once.withColumn(k_text, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", k_text]).drop(k_text)
    return stay.join(repeated, same, "left_anti").unionByName(once)
