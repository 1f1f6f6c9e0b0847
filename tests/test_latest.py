import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwell.plans.relational import latest

SCHEMA = "k long, d date, t timestamp_ntz, z timestamp, i int, b long, v double, s string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rank_of(x):
    return (x is not None, x if x is not None else 0)


@pytest.fixture(scope="module")
def facts(spark):
    draw = random.Random(7)
    some = lambda xs: draw.choice([None, *xs])
    days = [dt.date(1900, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29)]
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 5, 6, 7, 8, 9, 10), dt.datetime(2024, 5, 6, 7, 8, 9, 11)]
    ends = [-(2**63), -1, 0, 1, 2**63 - 1]
    rows = [
        (draw.choice([1, 2, 3, 3, 3, None, n]), some(days), some(times), some(times[1:]), some([-(2**31), 0, 2**31 - 1]), some(ends), float(n), f"s{n}")
        for n in range(600)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("order", [["d", "b"], ["t"], ["z", "i"], ["b"], ["i", "d"]])
def test_latest_hashes_and_agrees(facts, order):
    rows, df = facts
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    places = [names.index(c) for c in order]
    best = {}
    for row in rows:
        rank = tuple(rank_of(row[p]) for p in places)
        best[row[0]] = max(best.get(row[0], rank), rank)
    want = {k: [r for r in rows if r[0] == k and tuple(rank_of(r[p]) for p in places) == rank] for k, rank in best.items()}
    got = latest(df, "k", order, ["v", "i", "b"])
    assert "SortAggregate" not in plan(got) and "HashAggregate" in plan(got)
    found = got.collect()
    assert len(found) == len(want)
    # One whole row, out of those that are the latest.
    assert all((r.v, r.i, r.b) in {(w[6], w[4], w[5]) for w in want[r.k]} for r in found)


def test_other_types_and_widths_keep_whole_rows(facts):
    rows, df = facts
    for order, columns in ((["b", "z"], ["v"]), (["v"], ["b"]), (["b", "v"], ["s", "v"])):
        got = {r[0]: r[1:] for r in latest(df, "k", order, columns).collect()}
        both = dict.fromkeys([*order, *columns])
        whole = df.groupBy("k").agg(F.max(F.struct(*both)).alias("m")).select("k", *[f"m.{c}" for c in columns])
        if "v" in order:  # no ties: v is there once
            assert got == {r[0]: r[1:] for r in whole.collect()}
        assert set(got) == {r[0] for r in rows}


def test_latest_of_nothing(facts):
    assert latest(facts[1].filter("false"), "k", ["d"], ["v"]).collect() == []
