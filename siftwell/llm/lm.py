"""Language-model scores from quantised n-gram counts in a log-frequency Bloom filter.

Token counts are exact: blocks of documents ask the part that counts a token and
get its count back. Pairs of tokens are counted the same way, but what is kept of
them is a Bloom filter: a pair seen c times is entered once for every power of two
up to c, and its count is read back by asking for one power after another until
one is missing. Smoothing discounts what the filter says and gives the rest to
the token's own probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import mix, parts_for, texts_of, written
from siftwell.llm.minhash import WordHashes, words_of

PART_BYTES, MOST_PARTS = 8 << 20, 2000
#: Bits for each entry and probes for each question: about 2 % of unseen pairs are taken for seen ones.
ENTRY_BITS, PROBES = 8, 5
#: A filter up to this size is broadcast; a larger one stays in its parts and the questions travel.
MOST_BROADCAST = 128 << 20
#: No word holds white space, so these stand for themselves.
START, END = b"\t", b" "
ADDED = 0.1
LEVELS = 48


def trains(id) -> bool:
    """Whether a document is learned from: nine of ten, by the checksum of its id as text."""
    return zlib.crc32(b"" if id is None else str(id).encode()) % 10 != 0


@dataclass
class Tokens:
    """All tokens of a block in one array: documents one behind the other, each closed by the end token."""

    ids: list
    keys: np.ndarray
    ends: np.ndarray
    learned: np.ndarray
    distinct: np.ndarray
    at: np.ndarray

    @property
    def before(self) -> np.ndarray:
        """Key of the token before each one, the start mark at the head of a document."""
        out = np.empty_like(self.keys)
        out[1:] = self.keys[:-1]
        out[np.concatenate(([0], self.ends[:-1]))] = MARKS[START]
        return out


MARKS = WordHashes()
MARKS[START], MARKS[END]  # noqa: B018  computed once


def tokens_of(table: pa.Table) -> Tokens:
    """Rows in a fixed order, so that every pass over a block sees the same arrays."""
    ids, texts = table.column("doc_id").to_pylist(), texts_of(table.column("body"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    hashes = WordHashes()
    keys, ends, learned = [], [], []
    total = 0
    for i in order:
        words = words_of(texts[i])
        words.append(END)
        keys.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        total += len(words)
        ends.append(total)
        learned.append(trains(ids[i]))
    joined = np.concatenate(keys)
    ends = np.array(ends, np.int64)
    distinct, at = np.unique(joined, return_inverse=True)
    return Tokens([ids[i] for i in order], joined, ends, np.repeat(learned, np.diff(ends, prepend=0)), distinct, at)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by part and keeps the rest, and the borders of all parts."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(0x51)) ^ token)


def short(pairs: np.ndarray, parts: int) -> np.ndarray:
    """Part above, 32 bits of the pair below: what the filter and its questions know of a pair."""
    return (part_of(pairs, parts).astype(np.uint64) << np.uint64(32)) | (pairs & np.uint64(0xFFFFFFFF))


def bits_of(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Bit positions (probes x keys) of the entries ``(key, level)`` in a filter of ``size`` bits."""
    h = mix(keys.astype(np.uint64) ^ np.uint64(level * 0x9E3779B9 + 1))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.asarray(size, np.uint64) for i in range(PROBES)])


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 for a count of one, 2 from two on, 3 from four on, and so forth."""
    return np.frexp(counts.astype(np.float64))[1]


def build_slice(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one part: every key entered at each level up to its own."""
    level = quantised(counts)
    size = max(64, int(level.sum()) * ENTRY_BITS)
    found = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        found[bits_of(keys[level >= j], j, size)] = True
    return np.packbits(found, bitorder="little").tobytes()


@dataclass
class Filter:
    """Slices one behind the other; asks for levels until one is missing."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, slices: list[bytes]) -> Filter:
        sizes = np.array([len(x) for x in slices], np.int64)
        return cls(np.frombuffer(b"".join(slices), np.uint8), np.cumsum(sizes) - sizes, sizes * 8)

    def levels(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        left = np.flatnonzero(self.size[part] > 0)
        for j in range(1, LEVELS):
            if not len(left):
                break
            bits = bits_of(keys[left], j, self.size[part[left]]).astype(np.int64)
            held = (self.data[self.begin[part[left]] + (bits >> 3)] >> (bits & 7).astype(np.uint8)) & 1
            left = left[held.all(axis=0)]
            out[left] = j
        return out


@dataclass
class Smoothing:
    """Totals of the training tokens; per power of two of the history's count, discount and rest."""

    tokens: int
    types: int
    discount: np.ndarray
    rest: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.types + 1))

    def pair(self, base: np.ndarray, history: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Probability of a token after a history seen ``history`` times; unseen histories say nothing."""
        k = quantised(np.maximum(history, 1))
        seen = np.where(level > 0, np.ldexp(1.0, level.astype(np.int64) - 1), 0.0)
        seen = np.minimum(seen, history)
        known = np.maximum(seen - self.discount[k], 0) / np.maximum(history, 1) + self.rest[k] * base
        return np.where(history > 0, known, base)


def counts_of(tokens: Tokens, answers: pa.Table, parts: int) -> tuple[np.ndarray, int]:
    """Training count of every distinct token of the block, and of the start mark."""
    order, borders = dealt(part_of(tokens.distinct, parts), parts)
    out = np.zeros(len(order), np.int64)
    for part, counts in zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist()):
        out[order[borders[part] : borders[part + 1]]] = np.frombuffer(counts, "<u8")
    end = np.searchsorted(tokens.distinct, np.uint64(MARKS[END]))
    return out, int(out[end])


def count_tokens(docs: DataFrame, parts: int) -> DataFrame:
    """block, part, counts (of the block's distinct tokens in the part, by key), tokens and types of the part."""

    def ask(table: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        own = np.bincount(tokens.at[tokens.learned], minlength=len(tokens.distinct)).astype("<u8")
        order, borders = dealt(part_of(tokens.distinct, parts), parts)
        keys, own = tokens.distinct[order], own[order]
        pieces = list(zip(borders, borders[1:]))
        return pa.table(
            {
                "part": pa.array(range(parts), pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * parts, pa.int32()),
                "keys": pa.array([keys[a:b].astype("<u8").tobytes() for a, b in pieces], pa.binary()),
                "counts": pa.array([own[a:b].tobytes() for a, b in pieces], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        own = [np.frombuffer(x, "<u8") for x in table.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate(own).astype(np.int64))
        found = np.split(total[at], np.cumsum([len(x) for x in keys])[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "counts": pa.array([x.astype("<u8").tobytes() for x in found], pa.binary()),
                "tokens": pa.array([int(total.sum())] * len(keys), pa.int64()),
                "types": pa.array([int((total > 0).sum())] * len(keys), pa.int64()),
            }
        )

    asked = docs.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "block int, part int, counts binary, tokens long, types long")


def count_pairs(docs: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """part, slice of the filter, and how many pairs each level holds by the level of their history."""

    def ask(table: pa.Table, own: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        counts, starts = counts_of(tokens, own, parts)
        history, pairs = histories(tokens, counts, starts)
        learned = np.flatnonzero(tokens.learned)
        keys, first, times = np.unique(short(pairs[learned], parts), return_index=True, return_counts=True)
        level = quantised(history[learned][first]).astype(np.uint8)
        borders = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1).astype(np.uint64))
        pieces = [(p, a, b) for p, (a, b) in enumerate(zip(borders, borders[1:])) if a < b]
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in pieces], pa.int32()),
                "keys": pa.array([keys[a:b].astype("<u4").tobytes() for _, a, b in pieces], pa.binary()),
                "counts": pa.array([times[a:b].astype("<u4").tobytes() for _, a, b in pieces], pa.binary()),
                "level": pa.array([level[a:b].tobytes() for _, a, b in pieces], pa.binary()),
            }
        )

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()])
        own = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        level = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("level").to_pylist()])
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, own.astype(np.int64))
        cells = {}
        k, j = level[first].astype(np.int64), quantised(total)
        pair, where, types = np.unique(k * 64 + j, return_inverse=True, return_counts=True)
        sums = np.bincount(where, total, len(pair))
        twos = np.bincount(where, total == 2, len(pair))
        for p, n, s, t in zip(pair.tolist(), types.tolist(), sums.tolist(), twos.tolist()):
            cells[p] = {"history": p // 64, "level": p % 64, "types": n, "tokens": int(s), "twos": int(t)}
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("history", "level", "types", "tokens", "twos")]))
        return pa.table(
            {
                "part": table.column("part").slice(0, 1),
                "slice": pa.array([build_slice(distinct, total)], pa.binary()),
                "cells": pa.array([list(cells.values())], kind),
            }
        )

    asked = docs.groupBy("block").cogroup(answers.groupBy("block"))
    asked = asked.applyInArrow(ask, "part int, keys binary, counts binary, level binary")
    cell = "struct<history: long, level: long, types: long, tokens: long, twos: long>"
    return asked.groupBy("part").applyInArrow(build, f"part int, slice binary, cells array<{cell}>")


def histories(tokens: Tokens, counts: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count of what stands before each token, and the key of the pair."""
    count = counts[tokens.at]
    history = np.empty_like(count)
    history[1:] = count[:-1]
    history[np.concatenate(([0], tokens.ends[:-1]))] = starts
    return history, pair_keys(tokens.before, tokens.keys)


def smoothing_of(answers: DataFrame, slices: DataFrame) -> Smoothing:
    """Sums over all parts: two totals and one row per pair of levels."""
    totals = answers.groupBy("part").agg(F.max("tokens").alias("tokens"), F.max("types").alias("types"))
    tokens, types = totals.agg(F.sum("tokens"), F.sum("types")).first()
    cells = slices.select(F.inline("cells")).groupBy("history", "level")
    cells = cells.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("twos").alias("twos"))
    ones, twos, all_tokens = np.zeros(64), np.zeros(64), np.zeros(64)
    held = np.zeros((64, 64))
    for c in cells.collect():
        held[c.history, c.level] = c.types
        all_tokens[c.history] += c.tokens
        twos[c.history] += c.twos
        ones[c.history] += c.types if c.level == 1 else 0
    discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
    values = np.ldexp(1.0, np.arange(64) - 1)
    mass = (held * np.maximum(values[None, :] - discount[:, None], 0))[:, 1:].sum(axis=1)
    rest = 1 - np.where(all_tokens > 0, mass / np.maximum(all_tokens, 1), 0)
    return Smoothing(tokens or 0, types or 0, discount, np.clip(rest, 1e-6, 1))


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scored(table: pa.Table, own: pa.Table, levels_of, smoothing: Smoothing, parts: int) -> pa.Table:
    tokens = tokens_of(table)
    counts, starts = counts_of(tokens, own, parts)
    history, pairs = histories(tokens, counts, starts)
    count = counts[tokens.at]
    # A token or history that training never saw is in no pair, so the filter is not asked.
    asked = np.flatnonzero((count > 0) & (history > 0))
    keys, at = np.unique(short(pairs[asked], parts), return_inverse=True)
    level = np.zeros(len(count), np.uint8)
    level[asked] = levels_of(keys)[at]
    base = smoothing.base(count)
    heads = np.concatenate(([0], tokens.ends[:-1]))
    add = lambda x: np.add.reduceat(x, heads)
    return pa.table(
        {
            "doc_id": pa.array(tokens.ids, pa.int64()),
            "held_out": pa.array([not trains(x) for x in tokens.ids]),
            "n_tokens": np.diff(tokens.ends, prepend=0),
            "n_known": add((count > 0).astype(np.int64)),
            "train_tokens": np.full(len(heads), smoothing.tokens, np.int64),
            "base_score": add(np.log10(base)),
            "score": add(np.log10(smoothing.pair(base, history, level))),
        }
    )


def score_broadcast(docs: DataFrame, answers: DataFrame, slices: DataFrame, smoothing: Smoothing, parts: int) -> DataFrame:
    """Every task holds the whole filter, whose size was checked before."""
    held = {r.part: bytes(r.slice) for r in slices.select("part", "slice").toLocalIterator()}
    sent = docs.sparkSession.sparkContext.broadcast([held.get(p, b"") for p in range(parts)])
    made: dict[int, Filter] = {}

    def levels(keys: np.ndarray) -> np.ndarray:
        if 0 not in made:
            made[0] = Filter.of(sent.value)
        return made[0].levels((keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF))

    def score(table: pa.Table, own: pa.Table) -> pa.Table:
        return scored(table, own, levels, smoothing, parts)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)


def score_routed(docs: DataFrame, answers: DataFrame, slices: DataFrame, smoothing: Smoothing, parts: int) -> DataFrame:
    """The slices stay in their parts; blocks send their distinct pairs and get the levels back."""

    def ask(table: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        keys = np.unique(short(pair_keys(tokens.before, tokens.keys), parts))
        borders = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1).astype(np.uint64))
        pieces = [(p, a, b) for p, (a, b) in enumerate(zip(borders, borders[1:])) if a < b]
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in pieces], pa.int32()),
                "block": pa.array([block] * len(pieces), pa.int32()),
                "keys": pa.array([keys[a:b].astype("<u4").tobytes() for _, a, b in pieces], pa.binary()),
            }
        )

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        filter = Filter.of([own.column("slice")[0].as_py()] if own.num_rows else [b""])
        found = []
        for keys in asked.column("keys").to_pylist():
            keys = np.frombuffer(keys, "<u4").astype(np.uint64)
            found.append(filter.levels(np.zeros(len(keys), np.int64), keys).tobytes())
        return asked.append_column("levels", pa.array(found, pa.binary())).select(["block", "part", "keys", "levels"])

    def score(table: pa.Table, own: pa.Table) -> pa.Table:
        first = own.filter(pa.compute.is_valid(own.column("counts")))
        told = own.filter(pa.compute.is_valid(own.column("levels")))
        known = [
            np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(p << 32)
            for p, k in zip(told.column("part").to_pylist(), told.column("keys").to_pylist())
        ]
        keys = np.concatenate(known)
        values = np.frombuffer(b"".join(told.column("levels").to_pylist()), np.uint8)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        return scored(table, first, lambda x: values[np.searchsorted(keys, x)], smoothing, parts)

    asked = docs.groupBy("block").applyInArrow(ask, "part int, block int, keys binary")
    told = slices.select(F.col("part"), "slice").groupBy("part").cogroup(asked.groupBy("part"))
    told = told.applyInArrow(answer, "block int, part int, keys binary, levels binary")
    none = F.lit(None).cast("binary")
    both = answers.select("block", "part", "counts", none.alias("keys"), none.alias("levels")).unionByName(
        told.select("block", "part", none.alias("counts"), "keys", "levels")
    )
    return docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, SCORES)


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    body: Column = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    # Rows without an id are spread by their text.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("body")).otherwise(F.xxhash64("doc_id"))
    return named.withColumn("block", F.pmod(spread, F.lit(parts)).cast("int"))


def score_documents(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is the end token alone. A document with a null id is
    held out. Repeated rows count as often as they stand there. An empty table
    gives no rows; other columns are ignored. Below ``most_broadcast`` bytes the
    filter is broadcast, beyond that questions travel to its slices; the scores
    are the same.
    """
    total, parts = parts_for(docs, "text", PART_BYTES)
    parts = min(parts, max(MOST_PARTS, -(-total // (8 * PART_BYTES))))
    texts = blocks(docs, parts)
    answers = written(count_tokens(texts, parts), "token-counts")
    slices = written(count_pairs(texts, answers, parts), "filter")
    smoothing = smoothing_of(answers, slices)
    size = slices.agg(F.sum(F.octet_length("slice"))).first()[0] or 0
    score = score_broadcast if size <= most_broadcast else score_routed
    return score(texts, answers, slices, smoothing, parts)
