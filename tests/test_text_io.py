"""Text rules, query rules, sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions import querytext as Q
from siftwell.functions import text as X
from siftwell.functions.vectors import row_text, row_text_typed
from siftwell.operators import columns, fusion, output, textjobs
from siftwell.operators.search import structured_search
from siftwell.plans import relational as R
from siftwell.roles import Roles, to_source, to_standard
from siftwell.session import shared_folder
from siftwell.sources import scans, sinks
from siftwell.streaming import jobs
from tests.conftest import JOBS


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_tokens_and_phrases(spark):
    text = "The Schön, SCHÖN día's_x is a1 b!"
    assert one(spark, X.normalize(F.col("t")), t=text) == "the schön schön díasx is a1 b"
    assert one(spark, X.tokens(F.col("t")), t=text) == ["schön", "schön", "díasx", "a1"]
    assert X.query_tokens(text) == ["schön", "schön", "díasx", "a1"]
    assert one(spark, X.tokens(F.col("t"), ["a1"]), t="a1 bb") == ["bb"]
    df = spark.createDataFrame([(1, "a b c d"), (2, "..."), (3, None)], "id long, t string")
    got = {r.id: r.phrases for r in textjobs.phrases(df, "id", "t").collect()}
    assert got == {1: ["a", "a b", "a b c", "b", "b c", "b c d", "c", "c d", "d"], 2: [], 3: []}


def test_keywords_order(spark):
    df = spark.createDataFrame([(1, "bb aa cc aa bb dd the the the")], "id long, t string")
    got = textjobs.keywords(df, "id", "t", 3).orderBy("rank").collect()
    assert [(r.token, r.freq) for r in got] == [("bb", 2), ("aa", 2), ("cc", 1)]


def test_jaccard(spark):
    df = spark.createDataFrame([("red green", "green blue"), ("", "...")], "a string, b string")
    assert [r.similarity for r in textjobs.similarity(df, "a", "b").collect()] == [pytest.approx(1 / 3), 0.0]


def test_highlight(spark):
    text = "Été été étés cafe Cafe, cafeteria"
    assert one(spark, X.highlight(F.col("t"), "été CAFE"), t=text) == (
        "<b>Été</b> <b>été</b> étés <b>cafe</b> <b>Cafe</b>, cafeteria"
    )
    assert one(spark, X.highlight(F.col("t"), "cafe", "$1\\", "]"), t="cafe") == "$1\\cafe]"
    assert one(spark, X.highlight(F.col("t"), "the a"), t="the a") == "the a"


@pytest.mark.parametrize(
    "query, kind",
    [("how many jobs failed", "counting"), ("discount offers", "counting"), ("status:failed", "structured"),
     ("find jobs similar to status:failed", "hybrid"), ("database backups", "semantic")],
)
def test_classify(spark, query, kind):
    assert one(spark, Q.classify(F.col("q")), q=query) == kind


def test_query_rules(spark):
    assert one(spark, Q.classify(F.col("q"), [r"owner\s+\w+"]), q="owner bob") == "structured"
    assert one(spark, Q.is_counting(F.col("q"), word_boundary=True), q="discount account") is False
    assert one(spark, Q.route(F.col("q")), q="status:failed") == "structured"
    assert one(spark, Q.route(F.col("q")), q="find status:failed") == "hybrid"
    assert one(spark, Q.vector_weight(F.col("q"), 0.5), q="database backup") == 0.7
    assert one(spark, Q.vector_weight(F.col("q"), 0.5), q="latest jobs of the database") == 0.5
    assert one(spark, Q.count_target(F.col("q")), q="How many failed jobs are there?") == "failed jobs"
    assert one(spark, Q.count_target(F.col("q")), q="tally the records") == "record"
    assert one(spark, Q.count_target(F.col("q")), q="tally") == "items"
    assert one(spark, Q.id_in_query(F.col("q")), q="show item id: 42 now") == "42"
    assert one(spark, Q.id_in_query(F.col("q")), q="see #7") == "7"
    assert one(spark, Q.id_in_query(F.col("q")), q="job 1234") is None
    assert one(spark, Q.id_in_query(F.col("q"), loose=True), q="job 1234") == "1234"
    assert one(spark, Q.strip_counting(F.col("q")), q="How many failed jobs are there? group by owner") == "failed jobs"
    assert one(spark, Q.group_by_field(F.col("q")), q="count jobs GROUP BY Owner") == "owner"


def test_query_filters(spark):
    as_of = F.lit("2024-03-10").cast("timestamp_ntz")
    got = one(spark, Q.filters(F.col("q"), as_of), q='name:"a b" größe=5 n>=2.5 x=y in the last 1 week')
    assert [tuple(f) for f in got] == [
        ("name", "is", "a b"), ("größe", "eq", "5"), ("x", "is", "y"), ("n", "gte", "2.5"),
        ("timestamp", "gte", "2024-03-03 00:00:00"),
    ]


def test_row_text(spark):
    df = spark.createDataFrame([("n1", "ok", "", None)], "name string, status string, blank string, none string")
    fields = ["name", "status", "blank", "none"]
    text = row_text(df, fields, {"name": 3.0, "status": 0.0})
    assert df.select(text).first()[0] == "name: n1 name: n1 name: n1"
    df = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' as t, '[1]' as a, named_struct('x', 1) as s, 2 as n")
    text = row_text_typed(df, ["t", "a", "s", "n"], {}, F.lit("2024-01-03").cast("timestamp_ntz"))
    assert df.select(text).first()[0] == "t:2024-01-01 12:00:00 1 days ago a:array s:object n:2"


def test_fusion_sides(spark):
    k = spark.createDataFrame([(1, 10.0), (2, 5.0)], "id long, _score double")
    v = spark.createDataFrame([(2, 0.8), (3, 0.4)], "id long, _score double")
    none = k.filter("id < 0")
    got = {r.id: r._score for r in fusion.hybrid(k, v, 0.5, 10).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.25}
    assert {r.id: r._score for r in fusion.hybrid(k, none, 0.5, 10).collect()} == {1: 10.0, 2: 5.0}
    assert {r.id: r._score for r in fusion.hybrid(none, v, 0.5, 10).collect()} == {2: 0.8, 3: 0.4}
    assert fusion.hybrid(none, none, 0.5, 10).count() == 0
    assert [r.id for r in fusion.fuse_sequential(k, v, 10).collect()] == [1, 2, 3]
    assert fusion.fuse_by_rank(k, v, 2).first().id == 2


def test_roles(spark, jobs5):
    roles = {(r.column, r.role) for r in columns.infer_roles(jobs5).collect()}
    assert {("job_id", "id"), ("job_name", "name"), ("created_at", "timestamp"), ("duration_minutes", "numeric")} <= roles
    assert to_source(to_standard(jobs5, JOBS), JOBS).columns == jobs5.columns
    shaped = output.shape(structured_search(jobs5, "status:failed"), JOBS)
    assert shaped.columns[:3] == ["id", "name", "status"] and shaped.columns[-1].startswith("_")


def test_payload(jobs5):
    found = output.shape(structured_search(jobs5, "status:failed"), JOBS)
    doc = json.loads(output.payload(found, "status:failed", 5).first()[0])
    assert doc["result_count"] == 2 and doc["result_types"] == {"failed": 2}
    assert doc["suggested_response"] == (
        "2 matches for 'status:failed' (2 failed), best of all data_processing."
    )
    assert doc["results"][0]["match_type"] == "structured" and doc["results"][0]["duration_minutes"] == 20
    single = output.payload(found.filter("id = '5'"), "x", 5).first()[0]
    assert "One match for 'x': etl_pipeline, id 5, status failed." in single
    empty = json.loads(output.payload(found.filter("id = 'z'"), "x", 5).first()[0])
    assert empty["result_count"] == 0 and empty["suggested_response"].startswith("Nothing matches")


def test_nested_json(spark, tmp_path):
    doc = {"jobs": [{"id": 1, "status": "ok", "metrics": {"accuracy": 0.9}}, None, {"id": 2, "status": "failed"}]}
    (tmp_path / "j.json").write_text(json.dumps(doc, indent=1))
    df = scans.nested_as_json(scans.read_json_records(spark, str(tmp_path / "j.json"), "jobs", multi_line=True))
    assert sorted((r.id, r.status, r.metrics) for r in df.collect()) == [(1, "ok", '{"accuracy":0.9}'), (2, "failed", None)]


def test_mixed_json_records_keep_objects(spark, tmp_path):
    lines = ['{"a":{"b":[5,{"id":1},"x",null,[1],{"id":2}]}}', '{"a":{"b":[{"id":3}]}}', '{"a":5}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    got = scans.read_json_records(spark, str(tmp_path / "m.json"), "a.b", "id long").collect()
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_sql_guards(spark):
    found = R.many_sql(spark, {"bad": "select nosuch from nowhere", "good": "select 1 as x"})
    assert list(found) == ["bad", "good"] and found["bad"].isEmpty() and found["good"].first().x == 1
    assert R.capped_sql(spark, "select id from range(50) where id > ?", 5, [9]).count() == 5
    for command in ("drop table x", "WITH a AS (SELECT 1 AS x) INSERT INTO guarded SELECT x FROM a", "SELECT 1; DROP TABLE guarded"):
        with pytest.raises(ValueError, match="SELECT"):
            R.capped_sql(spark, command, 5)


def test_guard_writes_nothing(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS guarded")
    spark.sql(f"CREATE TABLE guarded (x INT) USING parquet LOCATION '{tmp_path}/guarded'")
    found = R.sql_result(spark, "WITH a AS (SELECT 1 AS x) INSERT INTO guarded SELECT x FROM a")
    assert not found.success and found.error and spark.table("guarded").isEmpty()
    spark.sql("DROP TABLE guarded")


def test_sql_result(spark):
    good = R.sql_result(spark, "SELECT id FROM range(9) ORDER BY id DESC;", max_rows=4)
    assert (good.success, good.row_count, good.columns, good.error) == (True, 4, ("id",), None)
    assert {r.id for r in good.data.collect()} == {5, 6, 7, 8}
    # Fails only while it runs.
    late = R.sql_result(spark, "SELECT raise_error('late') AS x FROM range(3)")
    assert not late.success and late.row_count == 0 and "late" in late.error
    assert R.many_sql(spark, {"late": "SELECT 1 / (id - 1) AS x FROM range(3)"})["late"].isEmpty()


def test_csv_round_trip_keeps_quotes(spark, tmp_path):
    rows = [(1, 'say "hi", now', [1, 2], 0.5), (2, "line\nbreak", None, 1.5)]
    df = spark.createDataFrame(rows, "id long, note string, tags array<int>, _score double")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = scans.read_csv(spark, str(tmp_path / "c"), "id string, note string, tags string", escaped_breaks=True)
    got = {r.id: (r.note, r.tags) for r in back.collect()}
    assert got == {"1": ('say "hi", now', "[1,2]"), "2": ("line\nbreak", None)}
    sinks.write_csv(df, str(tmp_path / "d"), escape_breaks=False)
    whole = scans.read_csv(spark, str(tmp_path / "d"), "id string, note string, tags string", multi_line=True)
    assert {r.id: (r.note, r.tags) for r in whole.collect()} == got


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text("b,c,a\n1,x,2\n")
    row = scans.read_csv(spark, str(tmp_path / "r.csv"), "a int, b int, d string").first()
    assert row.asDict() == {"a": 2, "b": 1, "d": None}


def test_breaks_and_backslashes(spark):
    texts = ["a\nb", "\\n", "\\\n", "\r\n\\b\\\\", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scans.unescaped(scans.escaped(F.col("t")))).collect()] == texts


def test_clean_log(spark):
    rows = [(" a ", "7", "2024-01-02 03:04:05"), ("nan", "x", "01/02/2024"), ("b", None, "31/12/2024"), ("c", "2.9", "soon")]
    out = scans.clean_log(spark.createDataFrame(rows, "name string, retry_count string, created_at string")).collect()
    assert [r.name for r in out] == ["a", None, "b", "c"]
    assert [r.retry_count for r in out] == [7, 0, 0, 2]
    assert [str(r.created_at) for r in out] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-12-31 00:00:00", "None"]


def test_clean_log_judges_unclear_names_by_their_values(spark):
    rows = [("199.5", "2024-01-02"), ("20", "2024-01-03 01:02:03"), (None, "soon")]
    out = scans.clean_log(spark.createDataFrame(rows, "lifetime_value string, run_date string")).collect()
    assert [r.lifetime_value for r in out] == ["199.5", "20", None]
    assert [str(r.run_date) for r in out] == ["2024-01-02 00:00:00", "2024-01-03 01:02:03", "None"]


def test_fetch_reads_all_unless_bounded(spark):
    assert len(list(scans.fetch_rows(spark.range(50), 7))) == 7
    assert len(list(scans.fetch_rows(spark.range(10_050)))) == 10_050


def test_stream_before_anything_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arriving = jobs.arriving(spark, f"{tmp_path}/in", spark.range(1).schema)
    assert jobs.stream_filter(arriving, "id>=9", f"{tmp_path}/out", f"{tmp_path}/cp").count() == 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    base = str(tmp_path)
    schema = spark.range(1).withColumn("kind", F.lit("a")).schema

    def put(start):
        kind = F.when(F.col("id") % 3 == 0, "a").otherwise("b")
        spark.range(start, start + 30).withColumn("kind", kind).write.mode("append").parquet(f"{base}/in")

    put(0)
    for _ in range(2):
        out = jobs.stream_filter(jobs.arriving(spark, f"{base}/in", schema), "kind:a id>=9", f"{base}/out", f"{base}/cp")
        want = spark.read.parquet(f"{base}/in").filter("kind = 'a' and id >= 9").count()
        assert out.count() == want
        put(100)


def test_upsert_keeps_newest(spark, tmp_path):
    base, schema = str(tmp_path), "id long, e array<float>, v long"
    spark.createDataFrame([(1, [3.0, 4.0], 1), (2, [1.0, 0.0], 5)], schema).write.parquet(f"{base}/in")
    stream = lambda: jobs.arriving(spark, f"{base}/in", spark.read.schema(schema).parquet(f"{base}/in").schema)
    jobs.stream_upsert(stream(), "id", "e", "v", f"{base}/ix", f"{base}/cp")
    spark.createDataFrame([(1, [0.0, 2.0], 2), (2, [0.0, 9.0], 4)], schema).write.mode("append").parquet(f"{base}/in")
    got = jobs.stream_upsert(stream(), "id", "e", "v", f"{base}/ix", f"{base}/cp").collect()
    assert {r.id: r.embedding for r in got} == {"1": [0.0, 1.0], "2": [1.0, 0.0]}


def test_shared_folder_follows_the_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_folder(spark, "x")
    assert path != shared_folder(spark, "x")
    assert root is None or path.startswith(root.rstrip("/") + "/x-")


def test_extended_roles(spark):
    df = spark.createDataFrame([(1, "t", None, "c")], "record_id long, title string, status string, content string")
    got = {r.role: r.column for r in columns.extended_roles(df).collect()}
    assert got == {"id": "record_id", "name": "title", "description": "content"}


def test_json_fields(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": 2, "a": 3}',), ("broken",)], "p string")
    assert sorted(r.field for r in columns.json_fields(df, "p").collect()) == ["a", "b"]


def test_standard_names_keep_others():
    roles = Roles(id="k", name=None, extra={"price": "cost"})
    assert roles.standard_to_source() == {"id": "k", "price": "cost"}
