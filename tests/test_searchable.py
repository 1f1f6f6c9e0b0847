import pytest
from pyspark.sql import functions as F

from siftwell.functions.predicates import FOLDED
from siftwell.operators import search as S
from siftwell.operators.output import drop_meta
from siftwell.sources.sinks import write_searchable


def rows_read(found):
    """Rows found, and the rows the Parquet scan gave to the filter."""
    n = len(found.collect())
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    return n, scan.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    """40,000 rows in many row groups of one file; keys in no order, in mixed case, without repeats."""
    path = str(tmp_path_factory.mktemp("searchable") / "t")
    key = F.concat(F.lit("Key"), F.upper(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20)))
    df = spark.range(0, 40000, 1, 1).select("id", key.alias("key"), F.lit("note").alias("note"))
    small = {"parquet.block.size": 100_000, "parquet.enable.dictionary": "false"}
    write_searchable(df, path, ["key"], **small)
    return df, spark.read.parquet(path)


def test_row_groups_are_passed_over(keyed):
    df, stored = keyed
    wanted = df.filter("id = 31234").first()["key"]
    n, read = rows_read(S.filter_rows(stored, f"key:{wanted.swapcase()}"))
    assert n == 1 and 0 < read < 40000 // 4
    # Without the companion every row reaches the filter.
    n, read = rows_read(S.filter_rows(stored.drop(FOLDED + "key"), f"key:{wanted.swapcase()}"))
    assert (n, read) == (1, 40000)


def test_a_missing_value_reads_hardly_anything(keyed):
    n, read = rows_read(S.filter_rows(keyed[1], "key:keynowhere"))
    assert n == 0 and read < 40000 // 4


def test_companions_stay_out_of_keywords_scores_and_output(keyed):
    df, stored = keyed
    assert drop_meta(stored).columns == df.columns
    word = df.filter("id = 7").first()["key"]
    plain, folded = (S.relevance_search(t, word.lower()).filter("id = 7").first() for t in (df, stored))
    assert plain["_score"] == folded["_score"]
    assert S.filter_rows(stored, "note").count() == 40000


def test_nulls_empty_texts_and_odd_letters(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "ÄRGER"), (4, "ärger"), (5, "x y")]
    df = spark.createDataFrame(rows, "id long, t string")
    write_searchable(df, f"{tmp_path}/t", ["t"])
    stored = spark.read.parquet(f"{tmp_path}/t")
    for query in ("t:ärger", "t:Ärger", "t:nothing"):
        want = sorted(r.id for r in S.filter_rows(df, query).collect())
        assert sorted(r.id for r in S.filter_rows(stored, query).collect()) == want
    assert sorted(r.id for r in S.filter_rows(stored, "t:ÄRGER").collect()) == [3, 4]


def test_only_texts_have_companions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    for field in ("id", "missing"):
        with pytest.raises(ValueError):
            write_searchable(df, f"{tmp_path}/t", [field])
