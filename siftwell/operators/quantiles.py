"""Exact quantiles that no single task has to hold."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a pass settles; four passes settle a double.
BITS = 16
BINS = 1 << BITS
TOP_BIT = np.uint64(1 << 63)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles: -inf first, then by value (-0 is 0), inf, NaN last."""
    plain = values + 0.0
    plain[np.isnan(plain)] = np.nan
    bits = plain.view(np.uint64)
    return np.where(bits & TOP_BIT, ~bits, bits | TOP_BIT)


def value_of(key: int) -> float:
    """The double of a key."""
    bits = np.uint64(key)
    return float((bits ^ TOP_BIT if bits & TOP_BIT else ~bits).view(np.float64))


def histogram(values: DataFrame, wanted: Sequence[Sequence[int]], done: int) -> dict[tuple[int, int], np.ndarray]:
    """Counts of the next 16 bits of all keys that start with a wanted prefix of ``done`` bits, by column and prefix.

    One scan for all columns. Tasks give out one histogram each, which Spark adds
    up; the driver gets at most 65,536 counts for each column and prefix.
    """
    shift = 64 - BITS - done

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(i, p): np.zeros(BINS, np.int64) for i, prefixes in enumerate(wanted) for p in prefixes}
        for batch in batches:
            for i, prefixes in enumerate(wanted):
                keys = keys_of(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                heads = keys >> np.uint64(64 - done) if done else None
                for p in prefixes:
                    own = keys if heads is None else keys[heads == np.uint64(p)]
                    bins = ((own >> np.uint64(shift)) & np.uint64(BINS - 1)).astype(np.int64)
                    sums[i, p] += np.bincount(bins, minlength=BINS)
        for (i, p), counts in sums.items():
            held = np.flatnonzero(counts)
            yield pa.record_batch(
                {
                    "i": pa.array(np.full(len(held), i, np.int32)),
                    "p": pa.array(np.full(len(held), p, np.uint64).astype(np.int64)),
                    "bin": pa.array(held.astype(np.int32)),
                    "n": pa.array(counts[held]),
                }
            )

    found = values.mapInArrow(count, "i int, p long, bin int, n long").groupBy("i", "p", "bin").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    i, p, bin_, n = (table.column(c).to_numpy() for c in ("i", "p", "bin", "n"))
    sums = {(c, q): np.zeros(BINS, np.int64) for c, prefixes in enumerate(wanted) for q in prefixes}
    for (c, q), counts in sums.items():
        mine = (i == c) & (p == np.uint64(q).astype(np.int64))
        counts[bin_[mine]] = n[mine]
    return sums


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, value) with linear interpolation between neighbours.

    Radix selection: doubles become 64-bit keys of the same order, and each of four
    scans, for all columns together, settles 16 bits of the keys at the wanted
    ranks. Nothing depends on how values are spread. Nulls do not count; NaN is the
    largest value, as in Spark's order; between two infinities or beside a NaN there
    is nothing to interpolate and the result is that value or NaN. A column without
    values gives no rows.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    first = histogram(values, [[0]] * len(columns), 0)
    sizes = [int(first[i, 0].sum()) for i in range(len(columns))]
    #: Column and rank -> prefix of the key, and how many keys with that prefix are smaller.
    places = {
        (i, rank): (0, rank)
        for i, n in enumerate(sizes)
        for prob in probs
        for rank in (math.floor((n - 1) * prob), math.ceil((n - 1) * prob))
        if n
    }
    for done in range(0, 64, BITS):
        wanted = [sorted({p for (c, _), (p, _) in places.items() if c == i}) for i in range(len(columns))]
        counts = histogram(values, wanted, done) if done else first
        upto = {key: np.cumsum(n) for key, n in counts.items()}
        for (i, rank), (prefix, inside) in places.items():
            bin_ = int(np.searchsorted(upto[i, prefix], inside, side="right"))
            below = int(upto[i, prefix][bin_ - 1]) if bin_ else 0
            places[i, rank] = (prefix << BITS | bin_, inside - below)
    rows = []
    for i, (column, n) in enumerate(zip(columns, sizes)):
        for prob in probs if n else ():
            rank = (n - 1) * prob
            low, high = (value_of(places[i, k][0]) for k in (math.floor(rank), math.ceil(rank)))
            between = low if low == high else low + (high - low) * (rank - math.floor(rank))
            rows.append((column, float(prob), between))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
