"""Nearest neighbours by beam search over pruned directed graphs, one per shard.

Each shard links its vectors in a graph that a greedy search can walk: searches
propose neighbours, and relaxed pruning keeps a near one only where no kept one
already leads there. Queries walk every shard's graph; exact distances decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import written


@dataclass(frozen=True)
class Settings:
    """Edges kept by pruning and room for more, beam widths for building and searching, relaxation, nodes per shard."""

    degree: int = 24
    spare: int = 12
    build_beam: int = 48
    search_beam: int = 80
    relax: float = 1.2
    shard: int = 6000
    together: int = 256
    steps: int = 4
    entries: int = 16
    block: int = 1000


class Graph:
    """Directed graph over the rows of ``x``; missing edges are -1."""

    def __init__(self, x: np.ndarray, settings: Settings = Settings()):
        self.x = x.astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.x, self.x)
        self.settings = settings
        n = len(x)
        rng = np.random.default_rng(n)
        middle = int(np.argmin(self.norms - 2 * self.x @ self.x.mean(axis=0)))
        count = n if n <= settings.search_beam else settings.entries
        others = rng.permutation(n)[:count]
        self.entries = np.unique(np.append(others, middle))
        self.edges = np.full((n, settings.degree + settings.spare), -1, np.int64)
        if n > 1:
            picked = rng.integers(0, n, (n, min(settings.degree // 2, n - 1)))
            self.edges[:, : picked.shape[1]] = np.where(picked == np.arange(n)[:, None], -1, picked)
            for relax in (1.0, settings.relax):
                for nodes in np.array_split(rng.permutation(n), -(-n // settings.together)):
                    self._insert(nodes, relax)

    def _insert(self, nodes: np.ndarray, relax: float) -> None:
        near, _ = self.search(self.x[nodes], self.settings.build_beam)
        self.edges[nodes] = self._pruned(nodes, np.concatenate((near, self.edges[nodes]), axis=1), relax)
        # The way back: edges are appended while there is room; full nodes choose again.
        to = self.edges[nodes]
        source = np.repeat(nodes, to.shape[1])[to.ravel() >= 0]
        target = to.ravel()[to.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        place = np.arange(len(target)) - np.repeat(heads, np.diff(heads, append=len(target)))
        room = self.edges.shape[1] - self.settings.degree
        for low in range(0, int(place.max(initial=-1)) + 1, room):
            some = (place >= low) & (place < low + room)
            who = np.unique(target[some])
            used = (self.edges[who] >= 0).sum(axis=1)
            full = who[used + np.bincount(np.searchsorted(who, target[some]), minlength=len(who)) > self.edges.shape[1]]
            for part in np.array_split(full, -(-len(full) // self.settings.together)) if len(full) else []:
                self.edges[part] = self._pruned(part, self.edges[part], relax)
            used = (self.edges[who] >= 0).sum(axis=1)
            self.edges[target[some], used[np.searchsorted(who, target[some])] + place[some] - low] = source[some]

    def _pruned(self, nodes: np.ndarray, found: np.ndarray, relax: float) -> np.ndarray:
        """The nearest first; each one kept drops those that are much nearer to it than to the node."""
        x, norms = self.x[found], self.norms[found]
        dot = lambda other: np.matmul(x, other[:, :, None])[:, :, 0]
        far = np.maximum(norms + self.norms[nodes][:, None] - 2 * dot(self.x[nodes]), 0)
        far[(found < 0) | (found == nodes[:, None])] = np.inf
        out = np.full((len(nodes), self.edges.shape[1]), -1, np.int64)
        rows = np.arange(len(nodes))
        alive = far.copy()
        for place in range(self.settings.degree):
            best = alive.argmin(axis=1)
            some = np.isfinite(alive[rows, best])
            if not some.any():
                break
            out[some, place] = found[rows[some], best[some]]
            between = norms + norms[rows, best][:, None] - 2 * dot(x[rows, best])
            alive[(relax * relax * between <= far) & some[:, None]] = np.inf
            alive[rows, best] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes met by each walk and their squared distances less the query's norm."""
        q = queries.astype(np.float32)
        n, rows = len(q), np.arange(len(q))[:, None]
        met = np.zeros((n, len(self.x) + 1), bool)
        ids = np.repeat(self.entries[None], n, axis=0)
        far = self.norms[ids] - 2 * np.einsum("brd,bd->br", self.x[ids], q)
        met[rows, ids] = True
        done = np.zeros(ids.shape, bool)
        ids, far, done = self._best(ids, far, done, beam)
        while True:
            rank = np.cumsum(~done & (ids >= 0), axis=1)
            going = ~done & (ids >= 0) & (rank <= self.settings.steps)
            active = np.flatnonzero(going.any(axis=1))
            if not len(active):
                return ids, far
            steps = np.argsort(~going[active], axis=1, kind="stable")[:, : self.settings.steps]
            nodes = np.where(np.take_along_axis(going[active], steps, 1), np.take_along_axis(ids[active], steps, 1), -1)
            done |= going
            new = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(active), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            at = active[:, None]
            new[met[at, new]] = -1
            met[at, new] = True
            met[:, -1] = False
            away = self.norms[new] - 2 * np.einsum("brd,bd->br", self.x[new], q[active])
            away[new < 0] = np.inf
            merged = self._best(
                np.concatenate((ids[active], new), axis=1),
                np.concatenate((far[active], away), axis=1),
                np.concatenate((done[active], np.zeros(new.shape, bool)), axis=1),
                beam,
            )
            if merged[0].shape[1] > ids.shape[1]:
                grow = merged[0].shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                far = np.pad(far, ((0, 0), (0, grow)), constant_values=np.inf)
                done = np.pad(done, ((0, 0), (0, grow)))
            ids[active], far[active], done[active] = merged

    @staticmethod
    def _best(ids, far, done, beam):
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        take = np.take_along_axis
        return take(ids, order, 1), take(far, order, 1), take(done, order, 1)


def usable(vector: np.ndarray | None) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(vector.any())


def distinct_vectors(df: DataFrame, id: str, vector: str, ids_kept: int, queries: int) -> DataFrame:
    """One row per distinct vector: vec (doubles as bytes), dim, its smallest ids, its queries' ids.

    Of equal vectors only the smallest ids can be among the nearest, as ties go
    to them; every task keeps that many before anything is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for own, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own is None or not values.is_valid or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if usable(x):
                    found.setdefault(x.tobytes(), []).append(own)
            ids = [sorted(set(x)) for x in found.values()]
            yield pa.record_batch(
                {
                    "vec": pa.array(list(found), pa.binary()),
                    "ids": pa.array([x[:ids_kept] for x in ids], pa.list_(pa.int64())),
                    "asking": pa.array([[i for i in x if i % queries == 0] for x in ids], pa.list_(pa.int64())),
                }
            )

    sent = df.select(F.col(id).cast("long"), vector).mapInArrow(rows, "vec binary, ids array<long>, asking array<long>")
    # Lists of one task are short; the least of them are taken again over all tasks.
    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids_kept)
    return sent.groupBy("vec").agg(least.alias("ids")).withColumn("dim", (F.octet_length("vec") / 8).cast("int")), sent


def nearest(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, queries: int = 100, settings: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row whose id ``queries`` divides.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows with a null id, take no part. Vectors are compared with those of
    equal length. Rows that repeat an id with the same vector are one. Ties go to
    the smaller id; a query's own id is never among its results. All rows are
    indexed; an empty table gives no rows; other columns are ignored.
    """
    grouped, sent = distinct_vectors(df, id, vector, k + 1, queries)
    nodes = written(grouped, "vectors")
    shards = max(1, -(-nodes.count() // settings.shard))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    asking = sent.select("vec", F.explode("asking").alias("query_id")).distinct()
    asking = asking.withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
    places = nodes.select("dim", "shard").distinct()
    lots = max(1, -(-asking.count() // settings.block))
    lot = F.pmod(F.xxhash64("query_id", "vec"), F.lit(lots))
    packed = asking.groupBy("dim", lot.alias("lot")).applyInArrow(_lot, "dim int, ids binary, vecs binary")
    there = packed.join(places.select(F.col("dim").alias("d"), "shard"), F.col("dim") == F.col("d")).select(
        F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), "ids", "vecs"
    )

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v, "<f8") for v in own.column("vec").to_pylist()])
        order = np.lexsort(x.T[::-1])
        x, held = x[order], own.column("ids").take(pa.array(order)).to_pylist()
        graph = Graph(x, settings)
        out: list[tuple[int, int, float]] = []
        for ids, vecs in zip(asked.column("ids").to_pylist(), asked.column("vecs").to_pylist()):
            ids = np.frombuffer(ids, "<i8")
            q = np.frombuffer(vecs, "<f8").reshape(len(ids), -1)
            for a in range(0, len(ids), settings.together):
                near, _ = graph.search(q[a : a + settings.together], settings.search_beam)
                for i, found in enumerate(near):
                    found = found[found >= 0]
                    exact = np.sqrt(((x[found] - q[a + i]) ** 2).sum(axis=1))
                    mine, best = int(ids[a + i]), []
                    for j in np.argsort(exact, kind="stable"):
                        if len(best) >= k and exact[j] > best[k - 1][0]:
                            break
                        best += [(float(exact[j]), v) for v in held[found[j]] if v != mine]
                        best.sort()
                    out += [(mine, v, d) for d, v in best[:k]]
        columns = list(zip(*out)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, kinds)})

    found = (
        nodes.groupBy("dim", "shard")
        .cogroup(there.groupBy("q_dim", "q_shard"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    # An id that repeats with other vectors counts with the nearest of them.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lot(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Queries of one lot as two blobs."""
    ids = table.column("query_id").to_numpy().astype("<i8").tobytes()
    vecs = b"".join(table.column("vec").to_pylist())
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids], pa.binary()), "vecs": pa.array([vecs], pa.binary())})
