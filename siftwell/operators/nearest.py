"""Exact nearest neighbours of many queries: items dealt to centres once, queries sent where they may find more."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import shared_folder

#: Scores held at a time.
SCORES_AT_ONCE = 4_000_000
#: Most centres, and the bytes that their vectors may take on the driver and in every task.
MOST_CENTRES, CENTRE_BYTES = 1024, 32 << 20
#: Lots go to this many groups at least, and a group holds about so many bytes of vectors.
LOT_GROUPS, HELD_BYTES = 24, 32 << 20
#: Added to every reach: rounding must not lose a neighbour.
SLACK = 1e-6
#: More than the products of unit vectors differ by rounding.
NOISE = 1e-12

# Functions that run in tasks travel with them, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def as_matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows; one with nulls or numbers that are not finite counts as a zero vector."""
    if not len(column):
        return np.zeros((0, 0))
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1).copy()
    m[~np.isfinite(m).all(axis=1)] = 0
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=m, where=size > 0)


@dataclass
class Block:
    """Distinct unit vectors that queries are compared with, and the ids of each in order."""

    vectors: np.ndarray
    #: First place of each vector in ``ids``, and one past the last.
    starts: np.ndarray
    ids: pa.Array
    id_rank: np.ndarray


def block_of(ids: pa.Array, rows: np.ndarray, k: int) -> Block:
    """Equal vectors share a place, with the ``k`` smallest ids: no more of them can be found."""
    by_id = np.argsort(np.asarray(ids.to_pylist()), kind="stable").tolist()
    members: dict[bytes, list[int]] = {}
    for place, row in enumerate(by_id):
        own = members.setdefault((rows[row] + 0.0).tobytes(), [])
        if len(own) < k:
            own.append(place)
    places = np.array([x for own in members.values() for x in own], np.int64)
    starts = np.cumsum([0, *map(len, members.values())])
    kept = np.array(by_id, np.int64)[places]
    return Block(rows[kept[starts[:-1]]], starts, ids.take(pa.array(kept)), places)


def best_of(query_ids: pa.Array, queries: np.ndarray, block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """Best k items of the block for each query; ties go to the smaller id.

    Products of matrices vary in their last bits with the shape of the block, so
    they only choose: scores are summed anew pair by pair, alike in every block.
    """
    n, dim = len(block.vectors), max(1, queries.shape[1])
    step = max(1, SCORES_AT_ONCE // max(n, 1))
    for start in range(0, len(queries) if n else 0, step):
        some = queries[start : start + step]
        rough = some @ block.vectors.T
        edge = np.partition(rough, n - k, axis=1)[:, n - k, None] - NOISE if n > k else -np.inf
        q, i = np.nonzero(rough >= edge)
        at_once = max(1, SCORES_AT_ONCE // dim)
        scores = np.concatenate(
            [(some[q[a : a + at_once]] * block.vectors[i[a : a + at_once]]).sum(axis=1) for a in range(0, len(q), at_once)]
        )
        times = block.starts[i + 1] - block.starts[i]
        item = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - block.starts[i], times)
        q, scores = np.repeat(q, times), np.repeat(scores, times)
        by = np.lexsort((block.id_rank[item], -scores, q))
        q = q[by]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, by = q[kept], by[kept]
        columns = [query_ids.take(pa.array(q + start)), block.ids.take(pa.array(item[by])), pa.array(scores[by])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "_score"])


@dataclass
class Centres:
    """Unit vectors of the centres; per centre the farthest item, the number of items and of lots."""

    vectors: np.ndarray
    radius: np.ndarray
    items: np.ndarray
    lots: np.ndarray

    def distances(self, queries: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (queries @ self.vectors.T)))


def first_visits(centres: Centres, distance: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, centre and lot: one lot each of the nearest centres, until k items may be expected there."""
    order = np.argsort(np.where(centres.items > 0, distance, np.inf), axis=1, kind="stable")
    expected = (centres.items / np.maximum(centres.lots, 1))[order]
    wanted = (np.cumsum(expected, axis=1) - expected < k) & (expected > 0)
    q, place = np.nonzero(wanted)
    centre = order[q, place]
    return q, centre, spread[q] % centres.lots[centre]


def other_visits(
    centres: Centres, distance: np.ndarray, spread: np.ndarray, bound: np.ndarray, zero: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All other lots that may hold an item as near as the k-th found so far (``bound``, a score or NaN).

    By the triangle inequality no item of a centre is nearer than the centre's
    distance less its radius. To a zero vector all items are alike.
    """
    reach = np.sqrt(np.maximum(0, 2 - 2 * bound)) + SLACK
    reach[zero | np.isnan(bound)] = np.inf
    q, centre = np.nonzero((distance - centres.radius <= reach[:, None]) & (centres.items > 0))
    times = centres.lots[centre]
    lot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    q, centre = np.repeat(q, times), np.repeat(centre, times)
    width, lots = len(centres.lots), int(centres.lots.max(initial=1))
    number = lambda a, b, c: (a * width + b) * lots + c
    new = ~np.isin(number(q, centre, lot), number(*first_visits(centres, distance, spread, k)))
    return q[new], centre[new], lot[new]


@dataclass
class Places:
    """All lots in a row, the one of the zero vectors last (centre -1); neighbours there share a group."""

    #: Number of each centre's first lot.
    first: np.ndarray
    centre: np.ndarray
    lot: np.ndarray
    group: np.ndarray
    #: Number of each group's first lot, and the most lots of a group.
    start: np.ndarray
    width: int

    def sent(self, q: np.ndarray, centre: np.ndarray, lot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Visits put together: query, group, and a bit for every lot of the group, set for those asked."""
        place = np.where(centre < 0, len(self.centre) - 1, self.first[centre] + lot)
        group = self.group[place]
        pairs, row = np.unique(q * len(self.start) + group, return_inverse=True)
        asked = np.zeros((len(pairs), self.width), bool)
        asked[row, place - self.start[group]] = True
        return pairs // len(self.start), pairs % len(self.start), [x.tobytes() for x in np.packbits(asked, axis=1)]


def places_of(centres: Centres, held_rows: int) -> Places:
    """Groups of about as many items each, of about ``held_rows`` at most."""
    first = np.cumsum(centres.lots) - centres.lots
    centre = np.repeat(np.arange(len(centres.lots)), centres.lots)
    rows = centres.items[centre] / centres.lots[centre]
    total = int(centres.items.sum())
    n = max(1, math.ceil(total / held_rows), min(len(centre), LOT_GROUPS))
    group = np.minimum(((np.cumsum(rows) - rows) * n / max(total, 1)).astype(np.int64), n - 1)
    group = np.append(group, n - 1)
    lot = np.append(np.arange(len(centre)) - first[centre], 0)
    start = np.searchsorted(group, np.arange(n))
    return Places(first, np.append(centre, -1), lot, group, start, int(np.bincount(group).max()))


def blocks_of(places: np.ndarray, ids: pa.Array, rows: np.ndarray, k: int) -> list[tuple[int, Block]]:
    """A block for each place."""
    order = np.argsort(places, kind="stable")
    heads = np.flatnonzero(np.diff(places[order], prepend=-1))
    return [
        (int(places[some[0]]), block_of(ids.take(pa.array(some)), rows[some], k)) for some in np.split(order, heads[1:])
    ]


def best_in_group(part: pa.RecordBatch, blocks: list[tuple[int, Block]], k: int) -> Iterator[pa.RecordBatch]:
    """Best k items for each query among those blocks whose bit its ``lots`` has set."""
    step = max(1, SCORES_AT_ONCE // (k * len(blocks)))
    for start in range(0, part.num_rows, step):
        some = part.slice(start, step)
        queries = as_matrix(some["embedding"])
        asked = np.frombuffer(b"".join(some["lots"].to_pylist()), np.uint8).reshape(len(queries), -1)
        found = []
        for place, block in blocks:
            asks = np.flatnonzero(asked[:, place // 8] & (128 >> place % 8))
            found += best_of(pa.array(asks), queries[asks], block, k)
        if found:
            near = pa.Table.from_batches(found)
            near = near.sort_by([("query_id", "ascending"), ("_score", "descending"), ("id", "ascending")])
            query = near["query_id"].to_numpy()
            near = near.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k)).combine_chunks()
            for batch in near.to_batches():
                columns = [some["query_id"].take(batch["query_id"]), batch["id"], batch["_score"]]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "_score"])


def near_by_lots(items: DataFrame, queries: DataFrame, k: int, lot_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Exact ``k`` best items per query by cosine, as (query_id, id, _score), and the visits (query_id, centre, lot).

    ``items`` (id, embedding) with unique ids and ``queries`` (query_id, embedding),
    nothing null. Items go to the nearest of some of them, at most ``MOST_CENTRES``,
    drawn by a hash; the items of a centre are cut into lots of about ``lot_bytes``,
    so a crowded centre is no large task. Items are written once with their centre
    and never copied. A query asks one lot first; the k-th score found there bounds
    what it may still find, and it then visits only lots within that reach. Lots
    share groups of about ``HELD_BYTES``: a task holds one group at a time, queries
    stream past it, and a query goes once to a group, however many lots it visits there.
    """
    spark = items.sparkSession
    id_kind, query_kind = items.schema["id"].dataType, queries.schema["query_id"].dataType
    vector = T.ArrayType(T.FloatType())
    schema = T.StructType().add("query_id", query_kind).add("id", id_kind).add("_score", "double")
    seen = items.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not seen.n:
        return spark.createDataFrame([], schema), spark.createDataFrame([], T.StructType().add("query_id", query_kind).add("centre", "integer").add("lot", "integer"))
    lot_rows = max(1, lot_bytes // (4 * seen.dim + 8))
    wanted = max(math.isqrt(seen.n), math.ceil(seen.n / lot_rows))
    wanted = max(1, min(wanted, MOST_CENTRES, CENTRE_BYTES // (8 * max(seen.dim, 1))))
    drawn = items.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toArrow()
    chosen = as_matrix(drawn["embedding"].combine_chunks())

    def to_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch["embedding"])
            centre, distance = np.full(len(rows), -1, np.int32), np.zeros(len(rows))
            step = max(1, SCORES_AT_ONCE // len(chosen))
            for a in range(0, len(rows), step):
                scores = rows[a : a + step] @ chosen.T
                centre[a : a + step] = scores.argmax(axis=1)
                distance[a : a + step] = np.sqrt(np.maximum(0, 2 - 2 * scores.max(axis=1)))
            centre[~rows.any(axis=1)] = -1
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["embedding"], pa.array(centre), pa.array(distance)], names=["id", "embedding", "centre", "distance"]
            )

    dealt_schema = T.StructType().add("id", id_kind).add("embedding", vector).add("centre", "integer").add("distance", "double")
    path = shared_folder(spark, "near-items")
    items.mapInArrow(to_centres, dealt_schema).write.parquet(path)
    dealt = spark.read.schema(dealt_schema).parquet(path)
    # One row per centre comes to the driver.
    sizes = dealt.groupBy("centre").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()
    held = np.zeros(wanted, np.int64)
    radius = np.zeros(wanted)
    for row in sizes:
        if row.centre >= 0:
            held[row.centre], radius[row.centre] = row.n, row.r
    centres = Centres(chosen, radius, held, -(-held // lot_rows))
    places = places_of(centres, max(1, HELD_BYTES // (4 * seen.dim + 8)))
    n_groups = len(places.start)
    of_centre = [(i, int(a), int(m), places.group[a : a + m].tolist()) for i, (a, m) in enumerate(zip(places.first, centres.lots))]
    lots = spark.createDataFrame(of_centre, "centre int, first int, lots int, groups array<int>")
    lot = F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")
    own = [F.get("groups", lot).alias("group"), (F.col("first") + lot).alias("place")]
    nonzero = dealt.filter("centre >= 0").join(F.broadcast(lots), "centre").select("id", "embedding", *own)
    # All zero vectors score 0, so only those with the smallest ids can be found.
    zeros = dealt.filter("centre = -1").orderBy("id").limit(k).select("id", "embedding", F.lit(n_groups - 1).alias("group"), F.lit(len(places.lot) - 1).alias("place"))
    some_zero = any(row.centre == -1 for row in sizes)
    known = nonzero.unionByName(zeros) if some_zero else nonzero

    def visits(first: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, SCORES_AT_ONCE // max(len(chosen), len(places.lot)))
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    rows = as_matrix(part["embedding"])
                    spread = part["spread"].to_numpy(zero_copy_only=False)
                    distance = centres.distances(rows)
                    if first:
                        q, centre, at = first_visits(centres, distance, spread, k)
                    else:
                        bound = part["bound"].to_numpy(zero_copy_only=False).astype(np.float64)
                        q, centre, at = other_visits(centres, distance, spread, bound, ~rows.any(axis=1), k)
                        if some_zero:
                            everyone = np.arange(len(rows))
                            q, centre, at = (np.concatenate(x) for x in ((q, everyone), (centre, everyone * 0 - 1), (at, everyone * 0)))
                    q, group, asked = places.sent(q, centre, at)
                    for b in range(0, len(q), 10_000):
                        took = pa.array(q[b : b + 10_000])
                        columns = [part["query_id"].take(took), part["embedding"].take(took)]
                        columns += [pa.array(group[b : b + 10_000].astype(np.int32)), pa.array(asked[b : b + 10_000], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "group", "lots"])

        return go

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("group", "side")])
            heads = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
                part, group = batch.slice(a, b - a), keys[0, a]
                if group != now:
                    now, held, blocks = group, [], []
                if keys[1, a] == 0:
                    place = part["place"].to_numpy(zero_copy_only=False).astype(np.int64) - places.start[group]
                    held.append((place, part["id"], as_matrix(part["embedding"])))
                    continue
                if held:
                    at, ids, rows = zip(*held)
                    held, blocks = [], blocks_of(np.concatenate(at), pa.concat_arrays(ids), np.concatenate(rows), k)
                if blocks:
                    yield from best_in_group(part, blocks, k)

    def asked(sent: DataFrame) -> DataFrame:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        left = known.select("group", F.lit(0).alias("side"), "place", "id", none(query_kind, "query_id"), "embedding", none("binary", "lots"))
        right = sent.select("group", F.lit(1).alias("side"), none("int", "place"), none(id_kind, "id"), "query_id", "embedding", "lots")
        together = left.unionByName(right).repartitionById(n_groups, "group").sortWithinPartitions("group", "side")
        return together.mapInArrow(meet, schema)

    def each_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                bits = np.unpackbits(np.frombuffer(batch["lots"][a].as_py(), np.uint8))
                place = places.start[batch["group"][a].as_py()] + np.flatnonzero(bits)
                columns = [batch["query_id"].take(pa.array(place * 0 + a))]
                columns += [pa.array(x[place].astype(np.int32)) for x in (places.centre, places.lot)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "centre", "lot"])

    visit = T.StructType().add("query_id", query_kind).add("embedding", vector).add("group", "integer").add("lots", "binary")
    spread = queries.withColumn("spread", F.pmod(F.xxhash64("query_id"), F.lit(1 << 31)))
    to_first = spread.mapInArrow(visits(True), visit)
    path = shared_folder(spark, "near-first")
    asked(to_first).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    order = W.partitionBy("query_id").orderBy(F.desc("_score"), F.asc("id"))
    kth = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    bounds = kth.select(F.col("query_id").alias("asked"), F.col("_score").alias("bound"))
    bounded = spread.join(bounds, F.col("query_id") == F.col("asked"), "left").drop("asked")
    to_others = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("nan")))).mapInArrow(visits(False), visit)
    every_schema = T.StructType().add("query_id", query_kind).add("centre", "integer").add("lot", "integer")
    every = to_first.unionByName(to_others).select("query_id", "group", "lots").mapInArrow(each_lot, every_schema)
    return found.unionByName(asked(to_others)), every
