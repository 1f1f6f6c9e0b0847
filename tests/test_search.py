"""Search semantics on small tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import predicates as P
from siftwell.functions.scores import FIELD_WEIGHTS
from siftwell.functions.terms import Condition, last_span, read_terms, wanted_id, without_counting
from siftwell.operators import aggregates as A
from siftwell.operators import search as S
from siftwell.plans.ask import ask, is_structured, query_weight
from tests.conftest import JOBS, PRODUCTS, ids


def test_terms():
    conds, words = read_terms('status:failed name="a b" size>=2.5 n=5 k!=3 AND old Things')
    assert conds == [
        Condition("status", "is", "failed"), Condition("name", "is", "a b"), Condition("n", "eq", 5),
        Condition("size", "gte", 2.5), Condition("k", "neq", 3),
    ]
    assert words == ["old", "Things"]


def test_record_filter_and_lookup(jobs3):
    assert ids(jobs3.filter(P.record_filter(jobs3, {"status": "Failed"})), "job_id") == ["2"]
    assert ids(jobs3.filter(P.record_filter(jobs3, {"duration_minutes": {"gt": 15}})), "job_id") == ["2", "3"]
    assert S.by_id(jobs3, "job_id", 2).first().job_name == "job2"
    assert A.count_rows(jobs3).first()[0] == 3


def test_structured(jobs5):
    assert ids(S.filter_rows(jobs5, "status:failed"), "job_id") == ["2", "5"]
    assert ids(S.filter_rows(jobs5, "duration_minutes>15"), "job_id") == ["2", "3", "5"]
    assert ids(S.filter_rows(jobs5, "database status:success"), "job_id") == ["1", "4"]
    assert ids(S.filter_rows(jobs5, "status:running OR duration_minutes<12", connective="OR"), "job_id") == ["1", "3"]


def test_text_scores(jobs5, products):
    found = {r.job_id: r._score for r in S.text_search(jobs5, "database", JOBS).collect()}
    assert found == {"1": 20.0, "4": 15.0}
    organic = {r.product_id: r._score for r in S.text_search(products, "organic", PRODUCTS).collect()}
    assert organic == {"P001": 20.0, "P002": 5.0, "P004": 20.0, "P007": 20.0}
    in_stock = S.text_search(products, "in_stock", PRODUCTS).collect()
    assert len(in_stock) == 8 and {r._score for r in in_stock} == {20.0}
    bakery = {r.product_id: r._score for r in S.text_search(products, "bakery", PRODUCTS).collect()}
    assert bakery == {"P003": 10.0, "P005": 10.0, "P009": 10.0}


def test_weights_by_field_name(products):
    renamed = products.withColumnsRenamed({"product_name": "name"})
    found = S.text_search(renamed, "organic", weights=FIELD_WEIGHTS).collect()
    assert {r.product_id: r._score for r in found} == {"P001": 17.5, "P002": 7.5, "P004": 17.5, "P007": 17.5}


def test_shared_word_scores_one(products):
    found = S.text_search(products, "tea oil", PRODUCTS, fields=["product_name"]).collect()
    assert {r.product_id: r._score for r in found} == {"P002": 3.0, "P010": 3.0}


def test_products(products):
    assert ids(S.filter_rows(products, "price>10"), "product_id") == ["P002", "P008"]
    assert ids(S.filter_rows(products, "category:Bakery"), "product_id") == ["P003", "P005", "P009"]
    assert A.count_matching(products, "status:in_stock").first()[0] == 8
    assert S.by_id(products, "product_id", "P001").first().product_name == "Organic Apples"


def test_unknown_field_raises_before_running(jobs5):
    for query in ("nosuch:1", "nosuch>1"):
        with pytest.raises(ValueError, match="unknown field"):
            S.filter_rows(jobs5, query)


def test_bad_numbers_only_lose_their_row(spark):
    df = spark.createDataFrame([("1", "5"), ("2", "x"), ("3", None), ("4", "nan"), ("5", "9")], "id string, n string")
    assert ids(S.filter_rows(df, "n>4"), "id") == ["1", "5"]
    assert ids(S.filter_rows(df, "n!=5"), "id") == ["5"]


def test_like_signs_are_literal(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "100 of")], "id long, t string")
    assert ids(df.filter(P.phrase_anywhere(df, "0%")), "id") == [1]


def test_contains_on_numbers_needs_text(jobs5):
    assert jobs5.filter(P.operator_map(jobs5, "duration_minutes", {"contains": "1"})).count() == 0
    assert ids(jobs5.filter(P.operator_map(jobs5, "job_name", {"contains": "DATA"})), "job_id") == ["1", "2", "4"]


def test_time_span_and_words(jobs5):
    assert ids(S.in_last(jobs5, "created_at", 2, "days", "2023-01-05 12:00:00"), "job_id") == ["4", "5"]
    assert last_span("jobs from last 7 days") == (7, "day") and last_span("jobs within the last 2 Weeks") == (2, "week")
    assert P.status_words("critical failed jobs", JOBS, "priority") == {"status": "failed", "priority": "critical"}
    assert P.with_phrases(jobs5, "how many with job name backup with status failed") == {"job_name": "backup", "status": "failed"}


def test_time_span_inside_a_search(jobs5):
    found = S.search(jobs5, "status:failed from last 2 days", JOBS, as_of="2023-01-05 12:00:00")
    assert [r.job_id for r in found.collect()] == ["5"]
    found = S.search(jobs5, "database in the last 2 days", JOBS, as_of="2023-01-05 12:00:00")
    assert [r.job_id for r in found.collect()] == ["4"]
    with pytest.raises(ValueError, match="timestamp role"):
        S.filter_rows(jobs5, "status:failed from last 2 days")
    with pytest.raises(ValueError, match="no numbers"):
        S.filter_rows(jobs5, "created_at>2022")


def test_statistics_and_histogram(jobs5):
    row = A.field_statistics(jobs5, "duration_minutes").first()
    assert (row["count"], row["min"], row["max"], row["sum"], row["avg"], row["median"]) == (5, 10, 30, 100, 20, 20)
    assert {r.value: r["count"] for r in A.count_by(jobs5, "status").collect()} == {"success": 2, "failed": 2, "running": 1}


def test_count_queries_are_exact(jobs5):
    out = A.count_query(jobs5, "how many jobs have status:failed?", JOBS).first()
    assert out["count"] == 2 and out.sample == ["2", "5"]
    assert without_counting("How many database are there in the last 2 days? group by status") == "database"
    groups = A.count_query_groups(jobs5, "count database in the last 30 days group by status", JOBS, "2023-01-05")
    assert {r.value: r["count"] for r in groups.collect()} == {"success": 2}


def test_id_first_and_fallback(products):
    assert [r._match_type for r in S.id_first(products, "P003", "organic", PRODUCTS).collect()] == ["exact_id"]
    rows = S.id_first(products, "P999", "organic", PRODUCTS, k=2).collect()
    assert [r.product_id for r in rows] == ["P001", "P004"]


def test_ties_break_by_id(products):
    top = S.search(products, "in_stock", PRODUCTS, 3).collect()
    assert [r.product_id for r in top] == ["P001", "P002", "P003"]


def test_settings(products):
    scored = S.text_search(products, "organic", PRODUCTS)
    out = S.with_settings(scored, "product_id", {"min_score": 10, "sort_by": "price", "sort_order": "asc", "exclude_fields": ("stock",)})
    assert [r.product_id for r in out.collect()] == ["P004", "P001", "P007"] and "stock" not in out.columns


def test_nested_field(spark):
    df = spark.createDataFrame([(1, ("failed", 3)), (2, ("ok", 9))], "id long, job_details struct<status: string, n: long>")
    assert ids(df.filter(P.criteria(df, {"job_details.status": "FAIL"})), "id") == [1]
    assert ids(df.filter(P.criteria(df, {"status": "FAIL"})), "id") == [1]
    assert ids(df.filter(P.criteria(df, {"job_details.n": {"gte": 4}})), "id") == [2]


def test_native_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id"), (F.col("id") * 1.5).alias("x")).write.parquet(path)
    plan = S.filter_rows(spark.read.parquet(path), "id>90 x<=140")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "LessThanOrEqual(x,140.0)" in plan


def test_ask_chooses_the_way(jobs5):
    assert [r._match_type for r in ask(jobs5, "item id 3", JOBS).collect()] == ["exact_id"]
    assert ask(jobs5, "how many jobs have status:failed?", JOBS).first()["count"] == 2
    assert [r.job_id for r in ask(jobs5, "database", JOBS).collect()] == ["1", "4"]
    assert wanted_id("see #12") == "12" and wanted_id("idea 5") is None
    assert is_structured("status:failed") and not is_structured("find status:failed")
    assert query_weight("database backup") == 0.7 and query_weight("latest jobs of the database") == 0.5


def test_counting_words_inside_other_words():
    from siftwell.functions.terms import asks_for_count

    assert asks_for_count("discount widget") and not asks_for_count("discount widget", word_boundary=True)
    assert asks_for_count("how many jobs", word_boundary=True)
