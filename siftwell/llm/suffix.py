"""Removal of long strings that an earlier document holds, by sorted suffixes.

Every 50-byte string has an anchor, the least hash of the 24-byte strings inside
it; equal strings have equal anchors. Anchors of one document alone are set
aside. Around the others the stretches with one anchor go to the shard of that
anchor, each distinct stretch once per block of documents, and each shard sorts
the suffixes of its stretches by induction: neighbours that share 50 bytes are
equal strings, and the smallest document among them goes back to the blocks.

A 24-byte string that would bring more than a shard's bytes to its shard is hot,
as a footer's at whose border every document has a stretch of its own. A hot one
is an anchor only where all others in the string are hot too, so such stretches
go by what surrounds the footer; which ones are hot, a sample may say, as any
choice that all blocks share keeps equal strings together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import mix, nullable, nullable_arrow, parts_for, texts_of, words_at
from siftwell.llm.induce import suffix_order

WIDTH = 50
ANCHOR = 24
#: Text per block and per shard; more than ``MOST_PARTS`` parts make them larger, up to eight times.
PART_BYTES, MOST_PARTS = 6 << 20, 2000
#: Anchors are sought in so many strings at a time: longer texts are cut, shorter ones taken together.
PIECE = 1 << 15
#: Odd multipliers of the three words of an anchor.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LAST = np.iinfo(np.int64).max
#: Bytes of stretches that one task sorts at a time; those of one anchor stay together.
SORT_BYTES = 4 << 20
#: Windows in which hot anchors are counted, and how often one at the limit is expected in the sample.
WINDOW, SEEN = 4096, 16
#: Hashes of anchors have 63 bits; the highest one marks the hot, which come last.
HOT = np.uint64(1 << 63)
NOT_HOT = np.zeros(0, np.uint64)


def hashes(data: bytes) -> np.ndarray:
    """A 63-bit hash of every string of ``ANCHOR`` bytes."""
    words = np.ascontiguousarray(words_at(data))
    m = max(len(data) - ANCHOR + 1, 0)
    low = words[:m] * SPREAD[0]
    low += words[8 : 8 + m] * SPREAD[1]
    low += words[16 : 16 + m] * SPREAD[2]
    low = mix(low)
    low >>= np.uint64(1)
    return low


def least(values: np.ndarray, reach: int) -> np.ndarray:
    """Smallest of every ``reach`` neighbours."""
    span = 1
    while span < reach:
        step = min(span, reach - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.searchsorted(known, values)
    place[place == len(known)] = 0
    return known[place] == values


def anchors_of(texts: list[bytes], width: int = WIDTH, hot: np.ndarray = NOT_HOT) -> tuple[np.ndarray, ...]:
    """Stretches of neighbouring strings with one anchor: number of the text, anchor, first string, number of strings."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, int]] = []
    held = 0
    for i, data in enumerate(texts):
        strings = len(data) - width + 1
        for begin in range(0, strings, PIECE):
            n = min(PIECE, strings - begin)
            if held + n > PIECE and group:
                found.append(_anchors(texts, group, width, hot))
                group, held = [], 0
            group.append((i, begin, n))
            held += n + width - 1
    if group:
        found.append(_anchors(texts, group, width, hot))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(texts: list[bytes], group: list[tuple[int, int, int]], width: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for pieces (text, first string, number of strings), laid end to end so that short texts share the work."""
    document, begin, strings = np.array(group, np.int64).T
    every = hashes(b"".join(texts[i][a : a + n + width - 1] for i, a, n in group))
    base = np.cumsum(strings + width - 1) - (strings + width - 1)
    low = least(every, width - ANCHOR + 1)

    def cut_at(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends[base] = True
        at = np.flatnonzero(ends)
        piece = np.searchsorted(base, at, side="right") - 1
        own = at - base[piece]
        # Strings that run into the next piece are none.
        real = own < strings[piece]
        return at[real], piece[real], own[real]

    changes = np.concatenate(([True], low[1:] != low[:-1]))
    at, piece, own = cut_at(changes)
    if among(low[at], hot).any():
        every[among(every, hot)] |= HOT
        low = least(every, width - ANCHOR + 1)
        # Stretches of hot anchors also end where the text says so, or both borders of a short passage would multiply.
        ends = (low[1:] != low[:-1]) | ((low[1:] >= HOT) & (every[1 : len(low)] & np.uint64(3) == 0))
        at, piece, own = cut_at(np.concatenate(([True], ends)))
    until = np.where(np.append(piece[1:] == piece[:-1], False), np.append(own[1:], 0), strings[piece])
    return document[piece], low[at], own + begin[piece], until - own


def anchors(data: bytes, width: int = WIDTH, hot: np.ndarray = NOT_HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one text: anchor, first string, number of strings."""
    return anchors_of([data], width, hot)[1:]


def short(key: np.ndarray, parts: int) -> np.ndarray:
    """Part in the upper, 32 bits of the anchor in the lower half; parts grow with the data and so do the bits."""
    return ((key >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def by_part(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Part and borders of each part's stretch of sorted short keys."""
    part = keys >> np.uint64(32)
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else []
    for a, b in zip(heads, [*heads[1:], len(keys)]):
        yield int(part[a]), int(a), int(b)


@dataclass
class Block:
    """Documents of one block in a fixed order: by id, then by text."""

    ids: np.ndarray
    texts: list[bytes]
    order: list[int]


def block_of(table: pa.Table) -> Block:
    ids = table.column("id").to_numpy().tolist()
    texts = texts_of(table.column("body"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return Block(np.array([ids[i] for i in order], np.int64), [texts[i] for i in order], order)


def shared_by_part(table: pa.Table) -> np.ndarray:
    """Sorted short keys that a block shares, from its rows of part and keys."""
    found = [
        np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(p << 32)
        for p, k in zip(table.column("part").to_pylist(), table.column("keys").to_pylist())
    ]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class Stretches:
    """Occurrences of shared stretches in a block and, per part, its distinct contents."""

    document: np.ndarray
    start: np.ndarray
    strings: np.ndarray
    part: np.ndarray
    content: np.ndarray
    contents: dict[int, dict[bytes, int]]
    first: dict[int, list[int]]
    #: Lowest byte of the anchor of each content.
    lowest: dict[int, bytearray]


def stretches(block: Block, shared: np.ndarray, parts: int, width: int, hot: np.ndarray = NOT_HOT) -> Stretches:
    contents: dict[int, dict[bytes, int]] = {}
    first: dict[int, list[int]] = {}
    lowest: dict[int, bytearray] = {}
    document, key, start, strings = anchors_of(block.texts, width, hot)
    wanted = short(key, parts)
    hit = among(wanted, shared)
    document, wanted, start, strings = (x[hit] for x in (document, wanted, start, strings))
    part = (wanted >> np.uint64(32)).astype(np.int64)
    low = (wanted & np.uint64(0xFF)).tolist()
    numbers = []
    for i, p, a, n, b in zip(document.tolist(), part.tolist(), start.tolist(), strings.tolist(), low):
        known = contents.get(p)
        if known is None:
            known, first[p], lowest[p] = contents.setdefault(p, {}), [], bytearray()
        piece = block.texts[i][a : a + n + width - 1]
        number = known.get(piece)
        if number is None:
            number = known[piece] = len(known)
            first[p].append(int(block.ids[i]))
            lowest[p].append(b)
        numbers.append(number)
    return Stretches(document, start, strings, part, np.array(numbers, np.int64), contents, first, lowest)


def earliest(pieces: list[bytes], first: np.ndarray, width: int, **memory) -> list[np.ndarray]:
    """For every string of every piece the smallest id of a piece that holds an equal string."""
    lengths = np.array([len(x) for x in pieces], np.int64)
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(lengths + 1) - 1
    flat[ends] = 1
    text = np.append(flat, np.uint16(0))
    order, shared = suffix_order(text, **memory)
    heads = np.flatnonzero(shared < width)
    del shared
    counts = lengths - width + 1
    at = spread(ends - lengths, counts)
    id_at = np.full(len(text), LAST)
    id_at[at] = np.repeat(first, counts)
    least = np.minimum.reduceat(id_at[order], heads)
    id_at[order] = np.repeat(least, np.diff(heads, append=len(text)))
    return np.split(id_at[at], np.cumsum(counts)[:-1])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``count`` steps, of every row one behind the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def covered(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings from these sorted starts cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return starts[np.concatenate(([0], gap + 1))], starts[np.concatenate((gap, [len(starts) - 1]))] + width


def on_borders(data: bytes, begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The spans drawn in to whole UTF-8 characters; none is left where nothing whole is covered."""
    out = []
    for a, b in zip(begins, ends):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(data[at:a])
        at = b
    pieces.append(data[at:])
    return b"".join(pieces)


def smallest_ids(rows: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]], width: int) -> list[list[np.ndarray]]:
    """Per row of pieces, lengths, ids and lowest bytes of anchors: :func:`earliest` of every piece.

    Strings with different anchors differ, so anchors are taken in turns of about ``SORT_BYTES``.
    """
    turns = min(256, max(1, -(-sum(len(r[0]) for r in rows) // SORT_BYTES)))
    found = [[None] * len(r[1]) for r in rows]
    ends = [np.cumsum(r[1], dtype=np.int64) for r in rows]
    turn_of = [r[3].astype(np.int64) * turns >> 8 for r in rows]
    for turn in range(turns):
        numbers: dict[bytes, int] = {}
        first: list[int] = []
        own = []
        for k, (pieces, lengths, ids, _) in enumerate(rows):
            at = np.flatnonzero(turn_of[k] == turn)
            end = ends[k][at]
            for i, a, b, id in zip(at.tolist(), (end - lengths[at]).tolist(), end.tolist(), ids[at].tolist()):
                number = numbers.setdefault(pieces[a:b], len(numbers))
                if number == len(first):
                    first.append(id)
                elif id < first[number]:
                    first[number] = id
                own.append((k, i, number))
        if not own:
            continue
        best = earliest(list(numbers), np.array(first, np.int64), width)
        for k, i, number in own:
            found[k][i] = best[number]
    return found


def hot_anchors(named: DataFrame, limit: int) -> np.ndarray:
    """Sorted hashes of the 24-byte strings that occur about ``limit`` times or more in ``body``.

    Counted in windows drawn by a hash, so few that one at the limit is seen
    ``SEEN`` times: the sample has some kilobytes for every part.
    """
    rate = max(1, limit // SEEN)
    drawn = F.filter(
        F.sequence(F.lit(0), F.floor(F.octet_length("body") / WINDOW).cast("int")),
        lambda k: F.pmod(F.xxhash64("seed", k), F.lit(rate)) == 0,
    )
    seeded = named.select("body", F.xxhash64("id", "body").alias("seed")).select("body", drawn.alias("drawn")).filter(F.size("drawn") > 0)
    windows = seeded.select(
        F.explode(F.transform("drawn", lambda k: F.substring("body", k * WINDOW + 1, F.lit(WINDOW + ANCHOR - 1)))).alias("window")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(x) for x in batch.column(0).to_pylist()]
            if found:
                unique, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"anchor": unique.astype(np.int64), "times": times.astype(np.int64)})

    times = windows.mapInArrow(counted, "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times"))
    table = times.filter(F.col("times") >= max(2, limit // rate)).select("anchor").toArrow()
    return np.sort(table.column("anchor").to_numpy()).astype(np.uint64)


def found_repeats(docs: DataFrame, parts: int, width: int, whole_characters: bool, carried: T.StructType, hot: np.ndarray) -> DataFrame:
    """Rows of id, body, block, rest -> n_bytes, n_removed, n_spans, kept_sha256, spans, kept, rest.

    One plan, so the exchange that deals texts into blocks is written once and read three times.
    """

    def keys_of(table: pa.Table) -> pa.Table:
        block = block_of(table)
        document, key, _, _ = anchors_of(block.texts, width, hot)
        key = short(key, parts)
        # Documents that repeat an id count as one: they never remove each other's strings.
        groups = same_ids(block.ids)
        heads = np.searchsorted(document, [g.start for g in groups] + [len(block.texts)])
        by_id = [np.unique(key[a:b]) for a, b in zip(heads, heads[1:])]
        every = np.concatenate(by_id) if by_id else np.zeros(0, np.uint64)
        unique, times = np.unique(every, return_counts=True)
        rows = {"part": [], "keys": [], "twice": []}
        for part, a, b in by_part(unique):
            rows["part"].append(part)
            rows["keys"].append(unique[a:b].astype("<u4").tobytes())
            rows["twice"].append(np.packbits(times[a:b] > 1).tobytes())
        number = table.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array(rows["part"], pa.int32()),
                "block": pa.array([number] * len(rows["part"]), pa.int32()),
                "keys": pa.array(rows["keys"], pa.binary()),
                "twice": pa.array(rows["twice"], pa.binary()),
            }
        )

    def shared_keys(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("twice").to_pylist(), lists)]
        unique, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[at[np.concatenate(twice) > 0]] = True
        flags = np.split(shared[at], np.cumsum([len(x) for x in lists])[:-1])
        found = [k[f].tobytes() for k, f in zip(lists, flags)]
        out = pa.table({"block": table.column("block"), "part": table.column("part"), "keys": pa.array(found, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in found]))

    def contents(key, table: pa.Table, shared: pa.Table) -> pa.Table:
        found = stretches(block_of(table), shared_by_part(shared), parts, width, hot) if table.num_rows else None
        keys = dict(zip(shared.column("part").to_pylist(), shared.column("keys").to_pylist()))
        rows = []
        for part, known in (found.contents if found else {}).items():
            lengths = np.array([len(x) for x in known], "<u4")
            rows.append((key[0].as_py(), part, keys[part], b"".join(known), lengths.tobytes(), np.array(found.first[part], "<i8").tobytes(), bytes(found.lowest[part])))
        names = ("block", "part", "keys", "pieces", "lengths", "first", "lowest")
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, list(zip(*rows)) or [()] * 7, kinds)})

    def smallest(table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("pieces", "lengths", "first", "lowest"))
        rows = [(p, np.frombuffer(n, "<u4"), np.frombuffer(i, "<i8"), np.frombuffer(b, np.uint8)) for p, n, i, b in zip(*columns)]
        ids, times = [], []
        for own in smallest_ids(rows, width):
            values = np.concatenate(own)
            heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            ids.append(values[heads].astype("<i8").tobytes())
            times.append(np.diff(heads, append=len(values)).astype("<u4").tobytes())
        return table.select(["block", "part", "keys"]).append_column("ids", pa.array(ids, pa.binary())).append_column(
            "times", pa.array(times, pa.binary())
        )

    def removed(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = block_of(table)
        starts_of = [np.zeros(0, np.int64)] * len(block.texts)
        if answers.num_rows and block.texts:
            found = stretches(block, shared_by_part(answers), parts, width, hot)
            values, offset, base = [], {}, 0
            for part, ids, times in zip(*(answers.column(c).to_pylist() for c in ("part", "ids", "times"))):
                own = np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(times, "<u4"))
                lengths = np.array([len(x) - width + 1 for x in found.contents[part]], np.int64)
                offset[part] = base + np.cumsum(lengths) - lengths
                values.append(own)
                base += len(own)
            values = np.concatenate(values)
            begin = np.empty(len(found.part), np.int64)
            for part, at in places(found.part):
                begin[at] = offset[part][found.content[at]]
            least = values[spread(begin, found.strings)]
            document = np.repeat(found.document, found.strings)
            place = spread(found.start, found.strings)
            hit = least < block.ids[document]
            document, place = document[hit], place[hit]
            heads = np.searchsorted(document, np.arange(len(block.texts) + 1))
            starts_of = [np.sort(place[a:b]) for a, b in zip(heads, heads[1:])]
        rows = []
        for data, starts in zip(block.texts, starts_of):
            begins, ends = (x.tolist() for x in covered(starts, width))
            spans = on_borders(data, begins, ends) if whole_characters else list(zip(begins, ends))
            kept = cut(data, spans)
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if whole_characters else None))
        carried_rows = table.column("rest").combine_chunks().take(pa.array(block.order))
        carried_rows = carried_rows.cast(nullable_arrow(carried_rows.type))
        columns = list(zip(*rows)) or [()] * 6
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        spans = [[{"begin": a, "end": b} for a, b in s] for s in columns[4]]
        return pa.table(
            {
                "id": pa.array(block.ids),
                "n_bytes": pa.array(columns[0], pa.int64()),
                "n_removed": pa.array(columns[1], pa.int64()),
                "n_spans": pa.array(columns[2], pa.int64()),
                "kept_sha256": pa.array(columns[3], pa.string()),
                "spans": pa.array(spans, span),
                "kept": pa.array([x if x is None else x.decode("utf-8", "replace") for x in columns[5]], pa.string()),
                "rest": carried_rows,
            }
        )

    asked = docs.groupBy("block").applyInArrow(keys_of, "part int, block int, keys binary, twice binary")
    shared = asked.groupBy("part").applyInArrow(shared_keys, "block int, part int, keys binary")
    sent = (
        docs.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInArrow(contents, "block int, part int, keys binary, pieces binary, lengths binary, first binary, lowest binary")
    )
    answers = sent.groupBy("part").applyInArrow(smallest, "block int, part int, keys binary, ids binary, times binary")
    span = T.StructType().add("begin", "long").add("end", "long")
    schema = T.StructType().add("id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema = schema.add("kept_sha256", "string").add("spans", T.ArrayType(span)).add("kept", "string").add("rest", nullable(carried))
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, schema)


def same_ids(ids: np.ndarray) -> list[range]:
    """Places of each run of equal ids in a sorted list."""
    heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return [range(a, b) for a, b in zip(heads, [*heads[1:], len(ids)])]


def places(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every distinct value with the places that hold it."""
    by = np.argsort(values, kind="stable")
    ordered = values[by]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(values) else []
    for a, b in zip(heads, [*heads[1:], len(values)]):
        yield int(ordered[a]), by[a:b]


def blocks(docs: DataFrame, rest: Column, parts: int) -> DataFrame:
    """id (null: after all others), body, block, rest."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    named = docs.select(id.alias("id"), body.alias("body"), rest.alias("rest"))
    return named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def parts_of(docs: DataFrame, width: int = WIDTH) -> tuple[int, int]:
    """Number of parts, and how many of the longest stretches have the bytes of one."""
    total, parts = parts_for(docs, "text", PART_BYTES)
    parts = min(parts, max(MOST_PARTS, -(-total // (8 * PART_BYTES))))
    return parts, max(1, -(-total // parts) // (2 * width - ANCHOR))


def hot_of(named: DataFrame, parts: int, limit: int) -> np.ndarray:
    """:func:`hot_anchors`; a single part has nothing to spread."""
    return hot_anchors(named, limit) if parts > 1 else NOT_HOT


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Bytes of each document that a document with a smaller id holds within equal strings of ``width`` bytes.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end).
    A null text is empty. Rows with one id do not remove each other's strings. A
    null id counts as the largest. Shorter texts than ``width`` stay whole; an
    empty table gives no rows; other columns are ignored.
    """
    parts, limit = parts_of(docs, width)
    rest = F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    dealt = blocks(docs, rest, parts)
    found = found_repeats(dealt, parts, width, False, T.StructType().add("doc_id", "long"), hot_of(dealt, parts, limit))
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents and columns, the texts without the repeated bytes and ``n_chars`` counted anew.

    Removed spans are drawn in to whole characters, so every text stays valid; a
    text of which nothing is left stays as an empty one, and a null text becomes
    one. A null id counts as the largest; rows of one id do not remove each other's
    passages, so repeated rows stay as they are. Other columns come back as they
    were, whatever their names and types. An empty table gives no rows.
    """
    parts, limit = parts_of(docs, width)
    others = [f for f in docs.schema if f.name != "text"]
    names = {f.name: f"c{i}" for i, f in enumerate(others)}
    kind = T.StructType([T.StructField(names[f.name], f.dataType) for f in others])
    rest = F.struct(*[F.col(f"`{f.name}`").alias(names[f.name]) for f in others])
    dealt = blocks(docs, rest, parts)
    found = found_repeats(dealt, parts, width, True, kind, hot_of(dealt, parts, limit))
    columns = {f.name: F.col("rest").getField(names[f.name]) for f in others} | {"text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])
