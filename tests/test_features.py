"""Similarity joins, radix quantiles, model slot, CSV edges, spans on the vector side, repeated names."""

import datetime as dt
import itertools
import math
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell import Roles
from siftwell.functions import vectors as V
from siftwell.operators import columns, quality, textjobs
from siftwell.operators.quantiles import exact_quantiles, keys_of, value_of
from siftwell.operators.vectorindex import index_table, knn
from siftwell.plans import ask, relational
from siftwell.session import shared_folder
from siftwell.sources import scans, sinks
from tests.conftest import day

SPECIAL = [math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0000000000000002]


def overlaps(rows, threshold):
    sets = {}
    for i, text in rows:
        own = frozenset((text or "").split())
        if own and i is not None:
            sets.setdefault(own, []).append(i)
    named = sorted((min(ids), own, len(ids)) for own, ids in sets.items())
    out = []
    for (a, x, n), (b, y, m) in itertools.combinations(named, 2):
        if len(x & y) / len(x | y) >= threshold - 1e-9:
            out.append((a, b, len(x & y), round(len(x & y) / len(x | y), 9), n, m))
    return sorted(out)


@pytest.mark.parametrize("threshold,block", [(0.8, 2000), (0.5, 3), (1.0, 1), (0.3, 2)])
def test_similar_pairs_equal_brute_force(spark, threshold, block):
    rng = random.Random(7)
    words = [f"wort{a}" for a in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(70):
        base = rng.sample(words, rng.randint(1, 12))
        rows.append((4 * i, " ".join(base)))
        rows += [(4 * i + k, " ".join(rng.sample(words, 1) + base[rng.randint(0, 1) :])) for k in (1, 2, 3) if rng.random() < 0.6]
    rows += [(9000 + i, "alle teilen worta wortb wortc wortd") for i in range(30)]
    rows += [(9100 + i, f"alle teilen worta wortb wortc wortd {w}") for i, w in enumerate(words)]
    rows += [(8000, None), (8001, ""), (None, "worta wortb"), (8002, "! ?")]
    docs = spark.createDataFrame(rows, "id long, t string")
    found = textjobs.similar_pairs(docs, "id", "t", threshold, block).collect()
    real = [(i, t if t != "! ?" else "") for i, t in rows]
    assert sorted((r[0], r[1], r[2], round(r[3], 9), r[4], r[5]) for r in found) == overlaps(real, threshold)


def test_signatures_rule_out_sets_that_meet_in_a_rare_token(spark):
    """Large sets that share only their rarest token make no pairs; near ones of unlike signature length do."""
    rng = random.Random(3)
    words = [f"w{a}" for a in range(6000)]
    rows = [(i, f"rarest{i // 120} " + " ".join(rng.sample(words, rng.randint(400, 1400)))) for i in range(120)]
    rows += [(1000 + i, " ".join(t.split(" ")[: 1 + int(0.85 * t.count(" "))])) for i, t in rows[:40]]
    rows += [(2000 + i, t.replace("w1", "v1", 9)) for i, t in rows[:40]]
    docs = spark.createDataFrame(rows, "id long, t string")
    found = textjobs.similar_pairs(docs, "id", "t", 0.8).collect()
    wanted = overlaps(rows, 0.8)
    assert len(wanted) > 40 and sorted((r[0], r[1], r[2], round(r[3], 9), r[4], r[5]) for r in found) == wanted

    sets = [sorted({hash(w) for w in t.split(" ")}) for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["item", "hashes"])
    none = np.zeros(0, np.int64)
    made = pa.Table.from_batches(textjobs._rarest(none, none, 0.8)([batch])).to_pandas()
    cell = made.drop_duplicates("item").assign(token=1, a=0, b=0, own=0)
    one = pa.RecordBatch.from_pandas(cell, preserve_index=False)
    met = {p for b in textjobs._meet(0.8)([one.slice(0, 50), one.slice(50)]) for p in zip(*b.to_pydict().values())}
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert met >= {tuple(sorted((place[w[0]], place[w[1]]))) for w in wanted} and len(met) < 2 * len(wanted)


def test_sets_travel_once_to_a_pair_of_lots(spark, tmp_path, monkeypatch):
    """Near copies make very many pairs; each of their sets is sent once to be compared, not once a pair."""
    rng = random.Random(5)
    base = [f"wort{i}" for i in range(80)]
    rows = [(i, " ".join(rng.sample(base, 78) + [f"eigen{i}"])) for i in range(60)] + [(100 + i, f"fremd{i} text{i}") for i in range(20)]
    docs, wanted = spark.createDataFrame(rows, "id long, t string").repartition(3), overlaps(rows, 0.8)
    assert len(wanted) == 60 * 59 // 2
    bundles, folder = textjobs._bundles, str(tmp_path)

    def counted(batches):
        for batch in batches:
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as out:
                out.write(str(batch.num_rows))
            yield from bundles([batch])

    def run():
        found = textjobs.similar_pairs(docs, "id", "t", 0.8, 7).collect()
        return sorted((r[0], r[1], r[2], round(r[3], 9), r[4], r[5]) for r in found)

    monkeypatch.setattr(textjobs, "_bundles", counted)
    assert run() == wanted
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 60
    # Many lots, cuts and parts find the same.
    for name, value in (("LOT", 7), ("GROUP_PAIRS", 5), ("ENTRIES", 100), ("ROWS_AT_ONCE", 11), ("LOOKED_UP", 100)):
        monkeypatch.setattr(textjobs, name, value)
    assert run() == wanted


def test_a_set_goes_once_to_a_part_and_a_pair_is_named_once(spark):
    """The rare tokens of a set lie in one row a part; sets that share a run of them meet at the first."""
    tokens = [[5, 9, 12, 20, 31], [5, 9, 12, 20, 40], [7, 9, 12, 21, 31]]
    flat = pa.array([t for own in tokens for t in own], pa.int64())
    items = pa.array([i for i, own in enumerate(tokens) for _ in own], pa.int64())
    sizes, signature = pa.array([5] * 15, pa.int32()), pa.array([bytes(32)] * 15, pa.binary())
    heads = pa.RecordBatch.from_arrays([flat, items, sizes, signature], names=["token", "item", "size", "signature"])
    none = np.zeros(0, np.int64)
    packed = list(textjobs._packed(none, none, 1)([heads]))
    assert [b["item"].to_pylist() for b in packed] == [[0, 1, 2]]
    met = [p for b in textjobs._meet(0.1)(packed_cells(packed)) for p in zip(*b.to_pydict().values())]
    # 0 and 1 share 5, 9, 12 and 20 in a run; 2 meets both where the token before is another.
    assert sorted(met) == [(0, 1, 5, 5), (0, 2, 5, 5), (0, 2, 5, 5), (1, 2, 5, 5)]
    assert sorted(p for b in textjobs._met(0.1)(packed) for p in zip(*b.to_pydict().values())) == sorted(set(met))


def packed_cells(packed):
    """The rows of a packed part in the order of cells, as they meet."""
    rows = []
    for batch in packed:
        for item, size, signature, entries in zip(*(batch[c].to_pylist() for c in ("item", "size", "signature", "entries"))):
            for token, before, code in np.frombuffer(entries, np.int64).reshape(-1, 3).tolist():
                rows.append((token, 0, 0, 0, item, size, before, code & 1, signature))
    names = ["token", "a", "b", "own", "item", "size", "before", "follows", "signature"]
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*sorted(rows)), kinds)]
    return [pa.RecordBatch.from_arrays(columns, names=names)]


def test_similar_pairs_plan_has_no_cross_join(spark):
    docs = spark.createDataFrame([(1, "eins zwei"), (2, "eins zwei drei")], "id long, t string")
    plan = textjobs.similar_pairs(docs, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        textjobs.similar_pairs(docs, "id", "t", 0)


def test_keys_keep_the_order_of_doubles():
    keys = keys_of(np.array(SPECIAL))
    back = [value_of(int(k)) for k in keys]
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(back, SPECIAL))
    order = sorted(range(len(SPECIAL)), key=lambda i: (math.isnan(SPECIAL[i]), SPECIAL[i] if not math.isnan(SPECIAL[i]) else 0))
    assert [int(keys[i]) for i in order] == sorted(map(int, keys)) and keys[3] == keys[4]


def test_quantiles_of_specials_and_long_tails(spark):
    rng = random.Random(5)
    values = [rng.choice([1, -1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)] + SPECIAL + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
    probs = [i / 510 for i in range(511)][::17] + [1.0]
    for row in exact_quantiles(df, ["v"], probs).collect():
        wanted = ordered[round(510 * row.prob)]
        assert row.value == wanted or (math.isnan(row.value) and math.isnan(wanted))
    assert quality.iqr_outliers(spark.createDataFrame([(1.0,), (2.0,), (math.nan,), (3.0,), (90.0,)], "v double"), "v").count() >= 0
    stats = quality.describe(spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "v double"), ["v"]).first()
    assert stats.p50 == 2.0 and math.isnan(stats["max"])


def test_a_pass_is_one_scan(spark, tmp_path):
    """Four passes read the table four times, whatever the number of columns and quantiles."""
    spark.range(1000).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        reads.add(1)
        return x

    found = {(r.column, r.prob): r.value for r in exact_quantiles(df.select(seen("a").alias("a"), "b"), ["a", "b"], [0.1, 0.5, 0.9]).collect()}
    assert found["a", 0.5] == 499.5 and found["b", 0.5] == -499.5
    assert reads.value == 4 * 1000


def letters():
    return lambda texts: np.array([[t.count("a"), t.count("b"), len(t)] for t in texts], float).reshape(len(texts), 3)


def test_model_of_the_callers(spark):
    model = V.Model("letters", 3, letters, batch=2)
    rows = [(1, "aab"), (2, None), (3, ""), (4, "b" * 300), (5, "abc")]
    df = spark.createDataFrame(rows, "id int, t string")
    found = {r.id: r.v for r in df.select("id", model.column(F.col("t")).alias("v")).collect()}
    assert found == {i: None if t is None else [float(t.count("a")), float(t.count("b")), float(len(t))] for i, t in rows}
    index = index_table(df, Roles(id="id", name=None, status=None), ["t"], 3, model=model)
    best = knn(index.select("id", "embedding"), "id", "embedding", model.one("t: aab"), 1, unit=True).first()
    assert best.id == "1"
    with pytest.raises(ValueError):
        index_table(df, Roles(id="id", name=None, status=None), ["t"], 4, model=model)
    wrong = V.Model("wrong", 3, lambda: lambda texts: np.zeros((1, 2)))
    with pytest.raises(ValueError):
        wrong.one("x")
    loads = V.Model("counted", 1, lambda: __import__("os").getpid() and (lambda texts: np.ones((len(texts), 1))))
    assert df.select(loads.column(F.col("t")).alias("v")).filter("v is not null").count() == 4


EDGES = [(1, " x ", ""), (2, "", None), (3, None, " "), (4, 'a "b" , c\n\\n', "\tq\t"), (5, "\\", "ü\r\n"), (6, "null", '""')]


def test_csv_there_and_back(spark):
    df = spark.createDataFrame(EDGES, "id int, a string, b string")
    path, out, state = (shared_folder(spark, x) for x in ("csv", "out", "state"))
    sinks.write_csv(df.repartition(2), path)
    read = scans.read_csv(spark, path, "b string, id int, a string", escaped_breaks=True)
    assert sorted(map(tuple, read.select("id", "a", "b").collect())) == EDGES
    stream = scans.stream_csv(spark, path, "b string, a string, more string, id int", escaped_breaks=True)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out)
    assert sorted(map(tuple, found.select("id", "a", "b").collect())) == EDGES
    assert found.filter("more is not null").count() == 0


def test_time_span_holds_for_vectors(spark):
    rows = [(1, "backup of disks", day(30)), (2, "weekly backup", dt.datetime(2000, 1, 1)), (3, "backup again", day(29))]
    df = spark.createDataFrame(rows, "id long, text string, at timestamp_ntz")
    roles = Roles(id="id", name=None, status=None, timestamps=("at",), texts=("text",))
    index = index_table(df, roles, ["text"], 16)
    found = ask.hybrid_search(df, index, "backup from the last 7 days", roles, 16, as_of="2023-01-31 00:00:00")
    assert {r.id for r in found.collect()} == {"1", "3"}


def test_repeated_and_odd_names_of_results(spark):
    result = relational.sql_result(spark, "SELECT 1 AS a, 2 AS a, 3 AS `x y`, 4 AS `b.c`")
    assert result.success and result.data.columns == ["a", "a", "x y", "b.c"]
    assert [tuple(r) for r in result.data.collect()] == [(1, 2, 3, 4)]


def test_source_analysis_of_hard_tables(spark):
    df = spark.createDataFrame([(2, "b", [1], None), (None, "n", None, "x"), (1, "a", None, "p")], "`my.id` long, `x y` string, l array<int>, _private string")
    roles = Roles(id="my.id", name="x y")
    found = [tuple(r) for r in columns.analyze_source(df, roles).collect()]
    assert ("total", None, "3") in found and ("role", "status", None) in found and ("role_count", "text", "0") in found
    assert [r[1:] for r in found if r[0] == "sample"] == [("my.id", "1"), ("x y", "a"), ("l", None)]
    assert [r[1:] for r in found if r[0] == "field"][2:] == [("l", "array<int>"), ("_private", "string")]
    nothing = [tuple(r) for r in columns.analyze_source(df.limit(0), roles).collect()]
    assert ("total", None, "0") in nothing and not [r for r in nothing if r[0] == "sample"]


def test_texts_are_embedded_a_run_at_a_time(monkeypatch):
    """Only the texts of one run become Python strings, and vectors leave with it; nulls stay in place."""
    monkeypatch.setattr(V.F, "arrow_udf", lambda run, kind: lambda c: run)
    model = V.Model("lengths", 2, lambda: lambda texts: np.array([[len(t), 1] for t in texts]), batch=10)
    texts = [None if i % 7 == 3 or 20 <= i < 30 else "x" * i for i in range(45)]
    made = list(model.column(None)(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, made)) == 10
    assert [v for run in made for v in run.to_pylist()] == [None if t is None else [len(t), 1] for t in texts]
