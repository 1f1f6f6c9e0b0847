"""Operators with their own distribution logic, against brute force on skewed data."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell import Roles
from siftwell.functions import vectors as V
from siftwell.operators import nearest, quality, textjobs
from siftwell.operators import vectorindex as I
from siftwell.operators.nearest import near_by_lots
from siftwell.operators.quantiles import exact_quantiles
from siftwell.plans import ask
from siftwell.plans import relational as R
from suite import CASES, Tables
from tests.conftest import DATA


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows, values repeat, some keys and values are null."""
    rng = np.random.RandomState(3)
    n = 6000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(rng.rand(n) < 0.5, "hot", rng.randint(0, 40, n).astype(str)),
            "v": np.round(np.exp(rng.randn(n) * 3), 1),
            "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.randint(0, 500, n), unit="h"),
        }
    )
    pdf.loc[rng.rand(n) < 0.02, "k"] = None
    pdf.loc[0, "v"] = 1e12
    df = spark.createDataFrame(pdf.astype({"k": object}), "id long, k string, v double, t timestamp_ntz")
    return pdf, df.withColumn("v", F.when(F.col("id") % 50 != 7, F.col("v")))


@pytest.mark.parametrize("hot_rows", [0, 500, 1_000_000])
def test_ranks(skewed, hot_rows):
    pdf, df = skewed
    pdf = pdf.assign(v=pdf.v.where(pdf.id % 50 != 7))
    out = R.ranks(df, "k", "v", hot_rows).toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf)
    for _, group in pdf.groupby("k", dropna=False):
        want = group.v.rank(method="min", ascending=False, na_option="bottom").astype(int)
        dense = group.v.rank(method="dense", ascending=False, na_option="bottom").astype(int)
        assert (out.loc[group.id, "rank"].values == want.values).all()
        assert (out.loc[group.id, "dense_rank"].values == dense.values).all()


@pytest.mark.parametrize("hot_rows", [0, 500, 1_000_000])
def test_running_total(skewed, hot_rows):
    pdf, df = skewed
    ones = df.withColumn("v", F.lit(1.25))
    out = R.running_total(ones, "k", "t", "id", "v", hot_rows=hot_rows).toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf)
    for _, group in pdf.groupby("k", dropna=False):
        group = group.sort_values(["t", "id"])
        assert (out.loc[group.id, "running"].values == np.arange(1, len(group) + 1) * 1.25).all()


def test_hot_keys_are_not_dealt_by_key(spark):
    """Rows of a hot key are told apart where they are; a join by key would send them all to one task."""
    from siftwell.operators.ordered import hot_keys, parted

    rows = spark.range(4000).selectExpr("nullif(id % 3, 1) AS k", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for part, keys in zip(parted(rows, "k", hot_keys(rows, "k", 0)), ({0, 2, None}, set())):
            assert {r.k for r in part.select("k").distinct().collect()} == keys
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_streamed_files_grow_in_number_not_in_size(spark):
    from suite.io import dealt

    rows, per_batch = dealt(spark.range(1000), 3, 100, "id")
    assert per_batch == 4 and rows.rdd.getNumPartitions() == 12 and rows.count() == 1000
    few, one = dealt(spark.range(100), 3, 100, "id")
    assert one == 1 and few.rdd.getNumPartitions() == 3


def test_one_time_for_all_rows(spark):
    """Ties are cut by the tie column, so no slice holds all rows."""
    rows = spark.range(3000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), "id", F.lit(2).alias("v"))
    out = R.running_total(rows, "k", "t", "id", "v", hot_rows=10)
    assert [r.running for r in out.orderBy("id").collect()] == [2.0 * (i + 1) for i in range(3000)]
    from siftwell.operators.ordered import in_slices

    sizes = in_slices(rows, [F.col("k"), F.col("t"), F.col("id")], "s").groupBy("s").count().collect()
    assert max(r["count"] for r in sizes) < 1500


def test_ranks_of_texts_and_dates(spark):
    rows = spark.range(500).selectExpr("'k' AS k", "id", "concat('n', id % 7) AS n", "date_add('2024-01-01', int(id % 5)) AS d")
    for column, distinct in (("n", 7), ("d", 5)):
        out = R.ranks(rows, "k", column, hot_rows=0).collect()
        assert len(out) == 500 and {r.dense_rank for r in out} == set(range(1, distinct + 1))


def test_quantiles(skewed):
    _, df = skewed
    values = df.select("v", F.col("id").cast("double").alias("w"), F.lit(3.0).alias("same")).cache()
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    pdf = values.toPandas()
    for r in exact_quantiles(values, ["v", "w", "same"], probs).collect():
        assert r.value == pytest.approx(pdf[r.column].quantile(r.prob), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, ["v"], [0.5]).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_knn_batch_both_ways(spark, broadcast_bytes):
    rng = np.random.RandomState(5)
    items = rng.randn(700, 16).astype("float32")
    items[10:40] = items[10]  # ties go to the smaller id
    queries = np.vstack([items[10], rng.randn(20, 16).astype("float32")])
    as_rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    schema = "id long, embedding array<float>"
    got = I.knn_batch(
        spark.createDataFrame(as_rows(items), schema).repartition(5),
        spark.createDataFrame(as_rows(queries), schema),
        6, broadcast_bytes=broadcast_bytes, block_bytes=700,
    ).toPandas()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(queries.astype(float)) @ unit(items.astype(float)).T
    for q in range(len(queries)):
        want = sorted(range(len(items)), key=lambda i: (-round(scores[q, i], 12), i))[:6]
        assert got[got.query_id == q].sort_values("rank").id.tolist() == want


def test_lots_visited_are_few_and_hold_all_neighbours(spark):
    """Clustered vectors, a third of them equal, zero vectors and ones with no number; half of the queries are items."""
    rng = np.random.RandomState(9)
    items = np.concatenate([rng.randn(1, 12) + 0.05 * rng.randn(100, 12) for _ in range(20)]).astype("float32")
    items = np.concatenate([items, np.repeat(items[:1], 1000, axis=0), np.zeros((30, 12), "float32")])
    items[5] = np.nan
    queries = np.concatenate([items[::20], rng.randn(40, 12).astype("float32"), np.zeros((1, 12), "float32"), -items[:3]])
    as_rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    items_table = spark.createDataFrame(as_rows(items), "id long, embedding array<float>").repartition(7)
    queries_table = spark.createDataFrame(as_rows(queries), "query_id long, embedding array<float>").repartition(3)
    found, visits = near_by_lots(items_table, queries_table, 5, 5000)
    best = {}
    for r in found.collect():
        best.setdefault(r.query_id, []).append((-r._score, r.id))
    unit = lambda m: m / np.maximum(np.linalg.norm(np.nan_to_num(m), axis=1, keepdims=True), 1e-30)
    scores = np.nan_to_num(unit(queries.astype(float))) @ np.nan_to_num(unit(items.astype(float))).T
    for q in range(len(queries)):
        want = sorted(range(len(items)), key=lambda i: (-round(scores[q, i], 12), i))[:5]
        assert [i for _, i in sorted((round(s, 12), i) for s, i in best[q])[:5]] == want, q
    own = visits.filter(f"query_id < {len(items[::20])}")
    lots = visits.select("centre", "lot").distinct().count()
    assert own.count() == own.distinct().count() < 0.4 * lots * len(items[::20])


def test_a_query_goes_once_to_the_lots_of_a_group(spark):
    """Vectors without clusters, so that queries visit most lots; rows shuffled grow with groups, not with lots."""
    df = spark.range(3000).select("id", F.array(*[F.randn(i) for i in range(12)]).cast("array<float>").alias("embedding"))
    queries = df.withColumnRenamed("id", "query_id")
    found, visits = near_by_lots(df, queries, 3, 700)
    lots = visits.groupBy("query_id").count().agg(F.min("count")).first()[0]
    assert lots > 2 * nearest.LOT_GROUPS
    # Each of the two rounds gives a query at most k rows from every group.
    assert found.count() <= 3000 * 3 * (nearest.LOT_GROUPS + 3)


def test_items_are_not_copied_for_lots(spark):
    df = spark.range(500).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).cast("array<float>").alias("embedding"))
    near = I.knn_batch(df, df, 2, broadcast_bytes=0, block_bytes=500)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Cross" not in plan and "CoGroup" not in plan
    assert I.knn_batch(df.limit(0), df, 2, broadcast_bytes=0).count() == 0
    assert I.knn_batch(df, df.limit(3), 2, broadcast_bytes=0).count() == 6


def test_knn_keeps_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7, 0.7])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = I.knn_batch(df, df, 1, broadcast_bytes=0, block_bytes=20).collect()
    assert sorted((r.query_id, r.id) for r in got) == [("a", "a"), ("b", "b"), ("c", "c")]


def test_index_keeps_latest_version_and_zero_vectors(spark):
    rows = [(1, [3.0, 4.0], 1), (1, [0.0, 2.0], 2), (2, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "id long, e array<float>, v long")
    got = {r.id: r.embedding for r in I.build_index(df, "id", "e", "v").collect()}
    assert got == {"1": [0.0, 1.0], "2": [0.0, 0.0]}


def test_verify_finds_faults(spark):
    rows = [("1", [1.0, 0.0], ("1",)), ("1", [1.0], ("1",)), ("2", [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, data struct<id: string>")
    row = I.verify_index(df, 2).first()
    assert (row["items"], row.wrong_dim, row.no_data, row.repeated, row.valid) == (3, 1, 1, 1, False)


def test_embedding_matches_numpy(spark):
    df = spark.createDataFrame([("Schön 1",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(V.embedding(F.col("t"), 32)).collect()]
    assert got[0] == pytest.approx(V.embed_text("Schön 1", 32), abs=1e-7) and got[1] is None
    assert np.linalg.norm(got[2]) == pytest.approx(1.0, abs=1e-6)


def test_norm_is_computed_once_per_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "id long, e array<float>")
    plan = V.with_unit(df, "e")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1


def test_keywords_move_no_rows(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "b a b c a b"), (2, None), (3, "")], "id long, t string").write.parquet(path)
    out = textjobs.keywords(spark.read.parquet(path), "id", "t", 2, ["c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    assert out.collect() == []  # single letters are no tokens


def test_spikes_need_a_full_window(spark):
    counts = [5, 6, 5, 6, 5, 6, 5, 40, 5]
    rows = [(f"2024-01-{d + 1:02d}", "x") for d, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "day string, k string").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    assert [(str(r.day), r.n) for r in quality.spikes(df, "ts", "k").collect()] == [("2024-01-08", 40)]


def test_hybrid_scores_in_double(spark):
    """Scores over a double index equal those of the vectors given, to all places; every id is searched."""
    rng = np.random.RandomState(5)
    vectors, target = rng.randn(30, 8), rng.randn(8).tolist()
    docs = spark.createDataFrame([(i, 950 if i % 2 else 100) for i in range(30)], "doc_id long, n_chars long")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    built = I.build_index(items, "vec_id", "embedding", kind="double")
    found = ask.hybrid_rows(
        docs, built, "n_chars>900", Roles(id="doc_id"), 8, 30, weight=1.0, embed=lambda text, dim: target
    ).collect()
    cosine = vectors @ target / np.linalg.norm(vectors, axis=1) / np.linalg.norm(target)
    held = {i: cosine[i] for i in range(30) if i % 2}
    top = max(held.values())
    assert {r.doc_id for r in found} == set(held)
    for r in found:
        assert r._vector_score == pytest.approx(held[r.doc_id] / top, abs=1e-12)


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data not present")
def test_hybrid_rows_search_every_id(spark):
    found = CASES["hybrid_rows"][0](Tables(spark, DATA)).select(F.col("doc_id") % 3).distinct().collect()
    assert {r[0] for r in found} == {0, 1, 2}


def daily(spark, counts):
    rows = [(str(np.datetime64("2024-01-01") + d), "x") for d, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "day string, k string").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    return [(str(r.day), r.n, round(r.mean, 4), round(r.sd, 4)) for r in quality.spikes(df, "ts", "k").collect()]


def test_spikes_across_days_without_rows(spark):
    """A day without rows is 0 in the bands and a day judged."""
    counts = dict(enumerate([5, 6, 5, 6, 5, 6, 5, 0, 5, 6, 60]))
    expected = []
    for d in range(7, 11):
        band = np.array([counts[e] for e in range(d - 7, d)])
        if abs(counts[d] - band.mean()) > 2 * band.std(ddof=1):
            expected.append((f"2024-01-{d + 1:02d}", counts[d], round(band.mean(), 4), round(band.std(ddof=1), 4)))
    assert [e[1] for e in expected] == [0, 60]
    assert sorted(daily(spark, counts)) == expected


@pytest.mark.parametrize("gap", [1, 6, 7, 8, 13, 14, 15, 16, 40])
def test_spikes_of_gaps_of_any_length(spark, gap):
    """Days made for the ends of a gap find what all of its days would."""
    seen = {**dict(enumerate([5, 6, 5, 6, 5, 6, 5, 6])), 8 + gap: 3, 9 + gap: 4}
    expected = []
    for d in range(7, 10 + gap):
        n, band = seen.get(d, 0), np.array([seen.get(e, 0) for e in range(d - 7, d)])
        if abs(n - band.mean()) > 2 * band.std(ddof=1):
            day = str(np.datetime64("2024-01-01") + d)
            expected.append((day, n, round(band.mean(), 4), round(band.std(ddof=1), 4)))
    assert sorted(daily(spark, seen)) == expected


def test_share_of_total_in_no_single_task(spark):
    facts = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), (None, 4.0)], "s string, v double")
    out = R.share_of_total(facts, "s", "v")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.s, r.share) for r in out.collect()} == {("a", 0.125), ("b", 0.375), (None, 0.5)}
