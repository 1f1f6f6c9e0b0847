"""A Merkle manifest of a table: a tree of digests per group, one over the groups, and a proof for every row.

Trees are worked off in blocks of whole subtrees. In a block nodes are labelled
so that children come before parents; an external priority queue ordered by
label carries each digest forward to the time of its parent. A second sweep, by
falling labels, carries what a proof has above a node down to its children. The
roots of blocks are the leaves of the next round, so a round takes five levels,
and no task ever sees more than one block.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator, Mapping
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.llm.common import written

#: Children of a node, and levels that one block takes.
FAN, LEVELS = 8, 5
#: Bytes of messages that a queue holds in memory.
QUEUE_BYTES = 32 << 20
#: Rows given out at a time.
ROWS = 1024
#: Columns of a leaf, in the order in which its digest takes them.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
HEAD = "<qqI"


class LabelQueue:
    """Messages in the order of their labels; those beyond the memory allowed lie in sorted runs on disk.

    Equal labels keep the order of ``place``. The runs belong to the task and go
    with it.
    """

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held, self.spilled = limit, 0, 0
        self.heap: list[tuple[int, int, bytes, int]] = []
        self.runs: list = []

    def put(self, label: int, place: int, message: bytes) -> None:
        heappush(self.heap, (label, place, message, -1))
        self.held += len(message)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile(prefix="labels-")
        mine = sorted(x for x in self.heap if x[3] < 0)
        for label, place, message, _ in mine:
            run.write(struct.pack(HEAD, label, place, len(message)))
            run.write(message)
        run.seek(0)
        self.runs.append(run)
        self.heap = [x for x in self.heap if x[3] >= 0]
        heapify(self.heap)
        self.spilled, self.held = self.spilled + self.held, 0
        self._refill(len(self.runs) - 1)

    def _refill(self, run: int) -> None:
        head = self.runs[run].read(struct.calcsize(HEAD))
        if head:
            label, place, size = struct.unpack(HEAD, head)
            heappush(self.heap, (label, place, self.runs[run].read(size), run))
        else:
            self.runs[run].close()

    def take(self, label: int) -> list[bytes]:
        """All messages of the least label, which must be this one."""
        found = []
        while self.heap and self.heap[0][0] == label:
            _, _, message, run = heappop(self.heap)
            found.append(message)
            if run >= 0:
                self._refill(run)
            else:
                self.held -= len(message)
        return found


class Block:
    """The shape of one subtree: its leaves, its levels, and its nodes in an order that puts children first."""

    def __init__(self, leaves: int, levels: int, fan: int = FAN):
        self.leaves, self.levels, self.fan = leaves, levels, fan

    def nodes(self) -> Iterator[tuple[int, int]]:
        """Level and place of every node; the n-th has label n."""
        for i in range(self.leaves):
            yield 0, i
            width = 1
            for level in range(1, self.levels + 1):
                width *= self.fan
                if (i + 1) % width and i + 1 != self.leaves:
                    break
                yield level, i // width

    def label(self, level: int, place: int) -> int:
        """How many nodes stand before this one: those that end with or before it, without its ancestors."""
        end = min((place + 1) * self.fan**level, self.leaves)
        below = sum(-(-end // self.fan**k) for k in range(level + 1))
        return below + sum(place // self.fan**k for k in range(1, self.levels - level + 1)) - 1


def levels_of(size: int, levels: int = LEVELS, fan: int = FAN) -> int:
    """Levels that a round takes of a tree of so many nodes."""
    found = 0
    while found < levels and size > fan**found:
        found += 1
    return found


def sweep_up(shape: Block, digests: Iterator[bytes], limit: int = QUEUE_BYTES) -> tuple[bytes, dict[int, list[bytes]]]:
    """The block's root and, by label, the children that every inner node got."""
    queue, children, digest = LabelQueue(limit), {}, b""
    for label, (level, place) in enumerate(shape.nodes()):
        if level:
            children[label] = queue.take(label)
            digest = sha256(b"".join(children[label])).hexdigest().encode()
        else:
            digest = next(digests)
        if level < shape.levels:
            queue.put(shape.label(level + 1, place // shape.fan), place, digest)
    return digest, children


def sweep_down(
    shape: Block, children: dict[int, list[bytes]], above: bytes, limit: int = QUEUE_BYTES
) -> Iterator[tuple[int, bytes]]:
    """Place of every leaf, the last first, and its path: what each level above has beside it.

    A level of a path is two bytes, place in the run and length of the run, and
    the digests of the run's other nodes.
    """
    queue = LabelQueue(limit)
    queue.put(-shape.label(shape.levels, 0), 0, above)
    for level, place in reversed([*shape.nodes()]):
        label = shape.label(level, place)
        path = queue.take(-label)[0]
        if not level:
            yield place, path
            continue
        run = children[label]
        for k, _ in enumerate(run):
            step = bytes([k, len(run)]) + b"".join(run[:k]) + b"".join(run[k + 1 :])
            at = place * shape.fan + k
            queue.put(-shape.label(level - 1, at), at, step + path)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """Place in the run and the other digests of the run, from the leaf up."""
    at = 0
    while at < len(path):
        end = at + 2 + 64 * (path[at + 1] - 1)
        yield path[at], path[at + 2 : end]
        at = end


def proof_of(path: bytes) -> str:
    """Digest of all siblings on the way up."""
    return sha256(b"".join(others for _, others in steps(path))).hexdigest()


def fold(leaf: bytes, path: bytes) -> str:
    """The root that a leaf and its siblings lead to."""
    digest = leaf
    for k, others in steps(path):
        digest = sha256(others[: 64 * k] + digest + others[64 * k :]).hexdigest().encode()
    return digest.decode()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` within the ``key`` by the order given, and ``size``, the rows of the key.

    Rows are sorted by ranges; gathered are only counts per range and key. Rows
    alike in key and order take any order.
    """
    rows = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    same = Window.partitionBy("key")
    before = F.sum("n").over(same.orderBy("part")) - F.col("n")
    starts = counts.select("part", "key", (F.col("first") - before).alias("shift"), F.sum("n").over(same).alias("size"))
    return ranged.join(starts, ["part", "key"]).withColumn("pos", F.col("at") - F.col("shift")).drop("part", "at", "shift")


class Forest:
    """One tree per ``key`` over rows of key, pos, size, digest; further columns ride along."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS, limit: int = QUEUE_BYTES):
        self.levels, self.limit, self.span = levels, limit, FAN**levels
        self.rounds = [nodes]
        while (self.rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
            self.rounds.append(written(self._up(self.rounds[-1]), "merkle-nodes"))

    @property
    def roots(self) -> DataFrame:
        """key and digest of every tree's root."""
        return self.rounds[-1].select("key", "digest")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")

    def _shapes(self):
        span, levels = self.span, self.levels
        return lambda block, size: Block(min(span, size - block * span), levels_of(size, levels))

    def _up(self, nodes: DataFrame) -> DataFrame:
        levels, limit, span, shape_of = self.levels, self.limit, self.span, self._shapes()

        def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            out: list[tuple] = []
            for row in rows:
                key, block, _, size, digest = row
                shape = shape_of(block, size)

                def digests(first=digest):
                    yield first.encode()
                    for other in rows:
                        yield other[4].encode()

                # The sweep takes exactly the leaves of its block from the stream.
                root, _ = sweep_up(shape, digests(), limit)
                left = 1 if size <= span else -(-size // FAN**levels)
                out.append((key, block, left, root.decode()))
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(("key", "pos", "size", "digest"), x)) for x in out], NODE)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "pos", "size", "digest"), x)) for x in out], NODE)

        block = F.expr(f"pos div {span}").alias("block")
        return self._dealt(nodes.select("key", block, "pos", "size", "digest")).mapInArrow(up, NODE_SCHEMA)

    def down(self, above: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """Every first row's path, with what ``above`` (key, path, root, subroot) says of its tree.

        Returns key, path, root, subroot, digest and the carried columns.
        """
        above = above.withColumn("pos", F.lit(0).cast("long"))
        for k in range(len(self.rounds) - 2, -1, -1):
            above = self._down(self.rounds[k], above, () if k else carried)
            if k:
                above = written(above.drop("digest"), "merkle-paths")
        if len(self.rounds) == 1:
            # Trees of one row each: the row is the root.
            rows = self.rounds[0].select("key", "digest", *carried)
            return above.drop("pos").join(rows, "key")
        return above

    def _down(self, nodes: DataFrame, above: DataFrame, carried: tuple[str, ...]) -> DataFrame:
        limit, shape_of, span = self.limit, self._shapes(), self.span
        none = F.lit(None)
        kinds = {f.name: f.dataType for f in nodes.schema}
        rows = nodes.select(
            "key", F.expr(f"pos div {span}").alias("block"), "pos", "size", "digest", none.cast("binary").alias("path"),
            none.cast("string").alias("root"), none.cast("string").alias("subroot"), *carried,
        )
        heads = above.select(
            "key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"),
            none.cast("string").alias("digest"), "path", "root", "subroot", *[none.cast(kinds[c]).alias(c) for c in carried],
        )
        schema = rows.select("key", "pos", "digest", "path", "root", "subroot", *carried).schema

        def spread(head: tuple, leaves: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, block, _, _, _, path, root, subroot = head[:8]
            shape = shape_of(block, leaves[0][3])
            _, children = sweep_up(shape, (x[4].encode() for x in leaves), limit)
            out = []
            names = ["key", "pos", "digest", "path", "root", "subroot", *carried]
            for place, own in sweep_down(shape, children, path, limit):
                leaf = leaves[place]
                out.append((key, leaf[2], leaf[4], own, root, subroot, *leaf[8:]))
                if len(out) == ROWS or not place:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    out = []

        arrow = [to_arrow_type(f.dataType) for f in schema]

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, leaves = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[2] >= 0:
                        leaves.append(row)
                        continue
                    if leaves:
                        yield from spread(head, leaves)
                    head, leaves = row, []
            if leaves:
                yield from spread(head, leaves)

        return self._dealt(rows.unionByName(heads)).mapInArrow(down, schema)


NODE_SCHEMA = "key string, pos long, size long, digest string"
NODE = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def manifest(
    docs: DataFrame,
    presented: Mapping[str, Column] | None = None,
    columns: tuple[str, ...] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    levels: int = LEVELS,
    limit: int = QUEUE_BYTES,
) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified of every row.

    ``presented`` holds columns as somebody presents them: their leaf is folded
    along the siblings of the true one, and ``verified`` says whether that leads to
    the root. ``path`` holds the siblings themselves, see ``steps``.

    Groups come null first, then by UTF-8 bytes; rows by ``order``, null first, then
    by leaf. Repeated rows are leaves of their own; equal ones may swap places,
    which changes no result but which of them has which path. A null is ``-`` in a
    leaf and differs from an empty text. An empty table gives no rows. Columns
    other than those named are ignored; columns that are neither text nor whole
    numbers count as Spark prints them.
    """
    presented = presented or {}
    own = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("key"),
        F.col(f"`{order}`").alias("row_id"),
        leaf_digest(own).alias("digest"),
        leaf_digest([presented.get(c, v) for c, v in zip(columns, own)]).alias("shown"),
    )
    trees = Forest(placed(rows, ["row_id", "digest"]), levels, limit)
    groups = trees.roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    top = Forest(placed(groups, ["name"]), levels, limit)
    whole = top.roots.select(
        "key", F.lit(b"").alias("path"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot")
    )
    above = top.down(whole, ("name",)).select(F.col("name").alias("key"), "path", "root", F.col("digest").alias("subroot"))
    found = trees.down(written(above, "merkle-groups"), ("row_id", "shown"))
    kind = found.schema["row_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(5).to_pylist()
            folded = [fold(x.encode(), p) for x, p in zip(batch.column(4).to_pylist(), paths)]
            proofs = [proof_of(p) for p in paths]
            root = batch.column(3)
            same = [a == b for a, b in zip(folded, root.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(5), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(same)],
                names=["doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"],
            )

    shown = found.select("row_id", F.col("digest").alias("leaf"), "subroot", "root", "shown", "path")
    return shown.mapInArrow(
        finish,
        f"doc_id {kind}, leaf string, subroot string, root string, path binary, proof_sha256 string, folded_root string, verified boolean",
    )
