"""Filters and lookups."""

from pyspark.sql import functions as F

from siftwell.functions import predicates as P
from siftwell.operators import search as S
from siftwell.operators.output import drop_meta
from siftwell.roles import Roles
from siftwell.session import shared_folder
from siftwell.sources.sinks import write_searchable
from suite.registry import case

ORDER = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@case("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
         WHERE lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'F'""")
def filter_eq(t):
    return S.filter_rows(t.orders, "o_orderpriority:1-urgent o_orderstatus:f").select(*ORDER)


@case("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
         WHERE lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'F'""")
def filter_eq_folded(t):
    """The same on a table written with folded companions."""
    path = shared_folder(t.spark, "searchable")
    write_searchable(t.orders.select(*ORDER), path, ["o_orderstatus", "o_orderpriority"])
    found = S.filter_rows(t.spark.read.parquet(path), "o_orderpriority:1-urgent o_orderstatus:f")
    return drop_meta(found)


@case("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
         WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_orderkey >= 100""")
def filter_cmp(t):
    return S.filter_rows(t.lineitem, "l_quantity>30 l_discount<=0.05 l_orderkey>=100").select(*LINE)


@case("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
         WHERE l_quantity <> 10 AND l_tax = 0.02""")
def filter_ne(t):
    return S.filter_rows(t.lineitem, "l_quantity!=10 l_tax=0.02").select(*LINE)


@case("""SELECT event_id, event_type FROM events
         WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) < 20.5""")
def filter_cmp_text(t):
    events = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return S.filter_rows(events, "k<20.5").select("event_id", "event_type")


@case("""SELECT p_partkey, p_name, p_brand, p_size FROM part
         WHERE p_size > 45 OR lower(p_brand) = 'brand#7' OR lower(p_name) = 'red widget'""")
def filter_or(t):
    query = 'p_size>45 OR p_brand:Brand#7 OR p_name:"Red Widget"'
    return S.filter_rows(t.part, query, connective="OR").select("p_partkey", "p_name", "p_brand", "p_size")


@case("""SELECT p_partkey, p_name FROM part WHERE p_size < 20 AND (
           contains(lower(p_name), 'widget') OR contains(lower(p_name), 'promo')
           OR contains(lower(p_brand), 'widget') OR contains(lower(p_brand), 'promo')
           OR contains(lower(p_type), 'widget') OR contains(lower(p_type), 'promo'))""")
def filter_keyword(t):
    return S.filter_rows(t.part, "p_size<20 AND Widget promo").select("p_partkey", "p_name")


@case("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(c_custkey::VARCHAR, '99')
           OR contains(lower(c_name), '99') OR contains(c_nationkey::VARCHAR, '99')
           OR contains(c_acctbal::VARCHAR, '99') OR contains(lower(c_mktsegment), '99')""")
def filter_like_any(t):
    customers = t.customer
    return customers.filter(P.phrase_anywhere(customers, "99")).select("c_custkey", "c_name", "c_acctbal")


@case("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
         WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice > 200000
           AND o_totalprice <= 400000""")
def filter_criteria(t):
    orders = t.orders
    want = {"o_orderpriority": "Urgent", "o_totalprice": {"gt": 200000, "lte": 400000}}
    return orders.filter(P.criteria(orders, want)).select(*ORDER)


@case("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
         WHERE lower(o_orderstatus) = 'f' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
           AND o_totalprice < 90000""")
def filter_in(t):
    orders = t.orders
    want = {
        "o_orderstatus": "f",
        "o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]},
        "o_totalprice": {"lt": 90000},
    }
    return orders.filter(P.record_filter(orders, want)).select(*ORDER)


@case("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 77")
def lookup_id(t):
    return S.by_id(t.orders, "o_orderkey", "77").select(*ORDER)


@case("SELECT event_id, event_type FROM (SELECT -event_id AS event_id, event_type FROM events) WHERE event_id = -5")
def lookup_negative_id(t):
    events = t.events.select((-F.col("event_id")).alias("event_id"), "event_type")
    found = [S.by_id(events, "event_id", x) for x in ("-5", "007", "²")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@case("""SELECT o_orderkey, big FROM (SELECT o_orderkey, o_totalprice * 1000 AS big FROM orders)
         WHERE contains(big::DECIMAL(38, 6)::VARCHAR, '1234')""")
def filter_large_doubles(t):
    """Amounts of 1e7 and more are searched in plain notation."""
    big = t.orders.select("o_orderkey", (F.col("o_totalprice") * 1000).alias("big"))
    return big.filter(P.phrase_anywhere(big.select("big"), "1234"))


@case("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50""")
def filter_wrapped(t):
    """A field that lives inside the wrapped record is found by its bare name."""
    events = t.events.withColumn(P.WRAPPER, F.from_json("props", "k long"))
    return events.filter(P.criteria(events, {"k": {"gt": 50}})).select("event_id", F.col(f"{P.WRAPPER}.k").alias("k"))


@case("""SELECT event_id, event_type, value FROM events
         WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY""")
def filter_temporal(t):
    recent = S.in_last(t.events, "ts", 2, "weeks", "2024-01-31 00:00:00")
    return recent.select("event_id", "event_type", "value")


@case("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
         WHERE contains(lower(o_orderpriority), 'high')""")
def filter_status_word(t):
    orders = t.orders
    roles = Roles(id="o_orderkey", name=None, status="o_orderstatus")
    want = P.status_words("find high priority orders", roles, priority="o_orderpriority")
    return orders.filter(P.criteria(orders, want)).select(*ORDER)


@case("""SELECT p_partkey, p_name, p_brand FROM part
         WHERE contains(lower(p_brand), 'brand#2') AND contains(lower(p_name), 'old')""")
def filter_with_phrase(t):
    parts = t.part
    want = P.with_phrases(parts, "parts with p brand Brand#2 with p name old")
    return parts.filter(P.criteria(parts, want)).select("p_partkey", "p_name", "p_brand")


@case("""SELECT doc_id, lang FROM documents
         WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), ['ention', 'nicht'])
            OR list_has_any(regexp_split_to_array(lower(lang), '[^\\p{L}\\p{N}_]+'), ['ention', 'nicht'])
            OR list_has_any(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}_]+'), ['ention', 'nicht'])""")
def filter_token(t):
    return S.filter_rows(t.documents, "ention Nicht", whole_words=True).select("doc_id", "lang")


@case("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events
         WHERE json_extract(props, '$.k')::BIGINT > 50 AND event_type = 'click'""")
def filter_nested(t):
    events = t.events.withColumn("details", F.from_json("props", "k long"))
    want = {"details.k": {"gt": 50}, "event_type": {"in": ["click"]}}
    return events.filter(P.criteria(events, want)).select("event_id", F.col("details.k").alias("k"))
