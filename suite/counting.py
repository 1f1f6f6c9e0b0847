"""Counts, histograms, statistics, summaries."""

from pyspark.sql import functions as F

from siftwell.operators import aggregates as A
from siftwell.operators import columns, search
from siftwell.roles import Roles
from suite.registry import case
from suite.scoring import PART, TEXTS, sql_part_score

ORDERS = Roles(id="o_orderkey", name=None, status="o_orderstatus", timestamps=("o_orderdate",))
EVENTS = Roles(id="event_id", name="event_type", timestamps=("ts",))


@case("SELECT count(*) AS count FROM lineitem")
def count_all(t):
    return A.count_rows(t.lineitem)


COUNT_QUERY = "how many orders have o_orderstatus:F and o_totalprice>400000?"


@case(f"""WITH m AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
  SELECT '{COUNT_QUERY}' AS query, count(*) AS count,
    (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)
     FROM (SELECT o_orderkey FROM m ORDER BY o_orderkey LIMIT 5)) AS sample FROM m""")
def count_query(t):
    out = A.count_query(t.orders, COUNT_QUERY, ORDERS)
    return out.withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@case("""SELECT user_id::VARCHAR AS value, count(*) AS count FROM events
  WHERE (contains(lower(event_type), 'click') OR contains(lower(props), 'click'))
    AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY ALL""")
def count_query_groups(t):
    query = "how many click are there in the last 2 weeks? group by user_id"
    return A.count_query_groups(t.events, query, EVENTS, "2024-01-31 00:00:00")


@case("SELECT count(*) AS count FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R'")
def count_structured(t):
    return A.count_matching(t.lineitem, "l_quantity>=25 l_returnflag:r anything")


@case("""SELECT coalesce(nullif(event_type, 'error'), 'unknown') AS value, count(*) AS count
  FROM events GROUP BY 1""")
def count_by(t):
    kinds = t.events.withColumn("kind", F.nullif("event_type", F.lit("error")))
    return A.count_by(kinds, "kind")


STATS = """count({v}) AS count, min({v}) AS min, max({v}) AS max, round(sum({v}), 2) AS sum,
  round(avg({v}), 4) AS avg, median({v}) AS median"""


def rounded(stats):
    return stats.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


@case(f"SELECT {STATS.format(v='l_extendedprice')} FROM lineitem")
def field_stats(t):
    return rounded(A.field_statistics(t.lineitem, "l_extendedprice"))


@case(f"""SELECT {STATS.format(v='k')} FROM
  (SELECT try_cast(CASE event_type WHEN 'signup' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events)""")
def field_stats_text(t):
    mixed = F.when(F.col("event_type") == "signup", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return rounded(A.field_statistics(t.events.select(mixed.alias("k")), "k"))


@case(f"""WITH r AS (SELECT *, {sql_part_score('small')} AS score,
    CASE WHEN p_size > 25 THEN 'structured' ELSE 'vector' END AS rt FROM part WHERE {sql_part_score('small')} > 0)
  SELECT 'total' AS part, (SELECT p_partkey::VARCHAR || ' ' || p_name FROM r ORDER BY score DESC, p_partkey LIMIT 1) AS key, count(*) AS count FROM r
  UNION ALL SELECT 'status', p_type, count(*) FROM r GROUP BY p_type
  UNION ALL SELECT 'result_type', rt, count(*) FROM r GROUP BY rt""")
def summary(t):
    kind = F.when(F.col("p_size") > 25, "structured").otherwise("vector")
    found = search.text_search(t.part, "small", PART, fields=TEXTS).withColumn("_result_type", kind)
    return A.summarize(found, "p_partkey", "p_name", "p_type")


COLUMN_KINDS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}


@case(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS filled, '{k}' AS kind FROM events"
        for c, k in COLUMN_KINDS.items()
    )
)
def analyze(t):
    return columns.analyze(t.events)


CUSTOMER = Roles(id="c_custkey", name="c_name", status="c_mktsegment", numerics=("c_acctbal", "c_nationkey"), texts=("c_name",))
CUSTOMER_KINDS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@case(
    """WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)
  SELECT 'total' AS item, NULL::VARCHAR AS name, count(*)::VARCHAR AS value FROM customer
  UNION ALL SELECT * FROM (VALUES ('role', 'id', 'c_custkey'), ('role', 'name', 'c_name'), ('role', 'status', 'c_mktsegment'),
    ('role_count', 'timestamp', '0'), ('role_count', 'numeric', '2'), ('role_count', 'text', '1'))"""
    + "".join(
        f" UNION ALL SELECT 'field', '{c}', '{k}' UNION ALL SELECT 'sample', '{c}', {c}::VARCHAR FROM s"
        for c, k in CUSTOMER_KINDS.items()
    )
)
def analyze_source(t):
    return columns.analyze_source(t.customer, CUSTOMER)


@case("SELECT p_type AS status, count(*) AS count FROM part GROUP BY 1")
def status_breakdown(t):
    """No column is called status: the one named like a type serves."""
    return A.status_counts(t.part, "status")
