"""Relational patterns: customers, orders, order lines, products."""

from pyspark.sql import functions as F

from siftwell.plans import relational as R
from suite.registry import case


def latest_order_date(t):
    return t.orders.agg(F.max("o_orderdate")).scalar()


NOW = "(SELECT max(o_orderdate) FROM orders)"


def register(t):
    for name in ("customer", "orders", "lineitem", "part"):
        getattr(t, name).createOrReplaceTempView(name)


STATUS_SQL = """SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
  FROM orders GROUP BY o_orderstatus"""


@case(STATUS_SQL)
def sql_run(t):
    register(t)
    return R.run_sql(t.spark, STATUS_SQL)


CAPPED_SQL = "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > {} ORDER BY c_acctbal DESC, c_custkey"


@case(CAPPED_SQL.format(5000) + " LIMIT 25")
def sql_capped(t):
    register(t)
    return R.capped_sql(t.spark, CAPPED_SQL.format(":low"), 25, {"low": 5000})


@case("""SELECT 'urgent' AS name, count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'large', count(*) FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'""")
def sql_many_counts(t):
    return R.many_counts(
        t.orders,
        {
            "urgent": F.col("o_orderpriority") == "1-URGENT",
            "large": F.col("o_totalprice") > 300000,
            "open": F.col("o_orderstatus") == "O",
        },
    )


@case("""SELECT 'customers' AS name, count(*) AS n FROM customer
  UNION ALL SELECT 'parts', count(*) FROM part""")
def sql_many(t):
    register(t)
    found = R.many_sql(
        t.spark,
        {
            "customers": "SELECT 'customers' AS name, count(*) AS n FROM customer",
            "parts": "SELECT 'parts' AS name, count(*) AS n FROM part",
        },
    )
    return found["customers"].unionByName(found["parts"])


@case("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000
    AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '2-HIGH'""")
def sql_filters(t):
    since = F.lit("1998-01-01").cast("timestamp_ntz")
    high = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)
    rows = t.orders.filter(high & (F.col("o_orderdate") >= since) & (F.col("o_orderpriority") == "2-HIGH"))
    return rows.select("o_orderkey", "o_totalprice")


@case(f"""SELECT count(*) AS count FROM orders WHERE o_orderdate < date_trunc('month', {NOW})
    AND o_orderdate >= date_trunc('month', {NOW}) - INTERVAL 1 MONTH""")
def previous_month(t):
    return R.previous_month_count(t.orders, "o_orderdate", latest_order_date(t))


@case("""SELECT c_custkey, c_name, coalesce(sum(o_totalprice::DECIMAL(18,4)), 0)::DOUBLE AS total
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def totals_per_customer(t):
    customers = t.customer.select("c_custkey", "c_name")
    return R.totals_per_entity(customers, "c_custkey", t.orders, "o_custkey", "o_totalprice", scale=4)


@case("""SELECT c_custkey, c_name, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM customer
  JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY sum(o_totalprice::DECIMAL(18,4)) DESC, 1 LIMIT 5""")
def top_customers(t):
    customers = t.customer.select("c_custkey", "c_name")
    return R.ranked_entities(customers, "c_custkey", t.orders, "o_custkey", R.money("o_totalprice", 4), 5)


@case("""SELECT p_partkey, p_name, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS total FROM part
  JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY sum(l_quantity::DECIMAL(18,4)), 1 LIMIT 10""")
def lowest_selling(t):
    parts = t.part.select("p_partkey", "p_name")
    return R.ranked_entities(parts, "p_partkey", t.lineitem, "l_partkey", R.money("l_quantity", 4), 10, lowest=True)


@case("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1")
def orders_by_month(t):
    return R.by_month(t.orders, "o_orderdate")


@case("""SELECT o_custkey, round(sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*), 8) AS average
  FROM orders GROUP BY 1""")
def average_order_value(t):
    out = R.average_per_key(t.orders, "o_custkey", "o_totalprice", scale=4)
    return out.withColumn("average", F.round("average", 8))


@case("""SELECT p_name, sum((l_quantity * l_extendedprice)::DECIMAL(18,4))::DOUBLE AS sales
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def sales_by_product(t):
    amount = F.col("l_quantity") * F.col("l_extendedprice")
    return R.sales_by_name(t.part, "p_partkey", "p_name", t.lineitem, "l_partkey", amount, scale=4)


@case("""WITH s AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders GROUP BY 1)
  SELECT o_custkey, total FROM s WHERE total > (SELECT avg(total) FROM s)""")
def above_average(t):
    return R.above_average(t.orders, "o_custkey", "o_totalprice", scale=4)


@case(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= {NOW} - INTERVAL 30 DAY")
def last_30_days(t):
    return R.last_days(t.orders, "o_orderdate", latest_order_date(t)).select("o_orderkey", "o_custkey")


@case(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= date_trunc('month', {NOW})")
def this_month(t):
    return R.this_month(t.orders, "o_orderdate", latest_order_date(t)).select("o_orderkey", "o_custkey")


@case("""WITH y AS (SELECT year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders GROUP BY 1),
    z AS (SELECT *, lag(total) OVER (ORDER BY year) AS previous FROM y)
  SELECT year, total, previous, round((total - previous) / previous, 6) AS change FROM z""")
def year_over_year(t):
    out = R.year_over_year(t.orders, "o_orderdate", "o_totalprice", scale=4)
    return out.withColumn("change", F.round("change", 6))


@case("""SELECT c_custkey, c_name FROM customer
  LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL""")
def customers_without_large_orders(t):
    large = t.orders.filter("o_totalprice > 400000")
    return R.without(t.customer, "c_custkey", large, "o_custkey").select("c_custkey", "c_name")


@case("""SELECT p_partkey, p_name FROM part
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def products_never_returned(t):
    returned = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45")
    return R.without(t.part, "p_partkey", returned, "l_partkey").select("p_partkey", "p_name")


@case("""SELECT c_custkey FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def customers_with_urgent(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return R.having(t.customer, "c_custkey", urgent, "o_custkey").select("c_custkey")


@case("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_order(t):
    return R.latest(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@case("""SELECT c_custkey, c_mktsegment, c_acctbal, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)""")
def ranked_in_segment(t):
    out = R.ranks(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    return out.select("c_custkey", "c_mktsegment", "c_acctbal", "rank", "dense_rank")


@case("""SELECT c_custkey, c_mktsegment, c_acctbal, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)""")
def ranked_in_hot_segment(t):
    """Every segment counts as hot, so all go through the slices."""
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.ranks(rows, "c_mktsegment", "c_acctbal", hot_rows=0)


@case("""SELECT c_custkey, c_mktsegment, c_name, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_name DESC)""")
def ranked_texts_in_hot_segment(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    return R.ranks(rows, "c_mktsegment", "c_name", hot_rows=0)


@case("""SELECT o_orderkey, o_orderstatus, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate::DATE DESC)""")
def ranked_dates_in_hot_status(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return R.ranks(rows, "o_orderstatus", "day", hot_rows=0).drop("day")


@case("""SELECT o_custkey, sum(round(o_totalprice * 100)::HUGEINT)::DOUBLE / 10000000 AS total FROM orders GROUP BY 1""")
def tiny_amounts(t):
    """Amounts of a hundred-thousandth keep all their digits."""
    tiny = t.orders.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)") / 100000)
    return R.per_key(tiny, "o_custkey", total=F.sum(R.money("amount", 7)).cast("double"))


@case("""SELECT o_custkey, (sum(round(o_totalprice * 100)::HUGEINT) * 10000000000)::DOUBLE AS total FROM orders GROUP BY 1""")
def huge_amounts(t):
    """Sums beyond 1e16 neither overflow nor lose digits."""
    huge = t.orders.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)") * 1000000000000)
    return R.per_key(huge, "o_custkey", total=F.sum(R.money("amount")).cast("double"))


@case("""SELECT l_returnflag, l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)""")
def ranked_with_ties(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return R.ranks(rows, "l_returnflag", "l_quantity").drop("l_quantity")


@case("""SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders""")
def running_total(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = R.running_total(rows, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", scale=4)
    return out.select("o_custkey", "o_orderkey", "running")


@case("""SELECT l_returnflag, l_orderkey, l_linenumber, sum(l_extendedprice::DECIMAL(18,4)) OVER (PARTITION BY l_returnflag
    ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING)::DOUBLE AS running
  FROM lineitem""")
def running_total_hot(t):
    """Three keys hold all rows; each is summed slice by slice."""
    rows = t.lineitem.select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice",
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_extendedprice").alias("tie"),
    )
    out = R.running_total(rows, "l_returnflag", "l_shipdate", "tie", "l_extendedprice", hot_rows=0, scale=4)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "running")


@case("""SELECT p_partkey, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS size_class,
    coalesce(nullif(p_type, 'PROMO'), 'none') AS type, round(p_retailprice / nullif(p_size - 10, 0), 4) AS unit FROM part""")
def conditional_functions(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        F.when(size < 15, "small").when(size < 35, "medium").otherwise("large").alias("size_class"),
        F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("none")).alias("type"),
        F.round(F.try_divide("p_retailprice", size - 10), 4).alias("unit"),
    )


@case("""SELECT p_partkey, upper(p_name) AS upper, lower(p_type) AS lower, trim('  ' || p_brand || ' ') AS trimmed,
    length(p_name) AS length FROM part WHERE p_name LIKE '%ing%'""")
def string_functions(t):
    return t.part.filter(F.col("p_name").like("%ing%")).select(
        "p_partkey",
        F.upper("p_name").alias("upper"),
        F.lower("p_type").alias("lower"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.length("p_name").cast("long").alias("length"),
    )


@case("""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
    strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, year(l_shipdate)::INT AS year,
    strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month_start FROM lineitem""")
def date_functions(t):
    day = F.to_date("l_shipdate")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.date_format(day, "yyyy-MM-dd").alias("shipped"),
        F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("due"),
        F.year(day).alias("year"),
        F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month_start"),
    )


@case("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity,
    sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue,
    round(avg(l_discount), 6) AS discount, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
  FROM lineitem GROUP BY 1, 2""")
def aggregate_set(t):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.sum(R.money("l_quantity", 4)).cast("double").alias("quantity"),
        F.sum(R.money(revenue, 4)).cast("double").alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"),
    )


@case("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@case(f"""WITH s AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,4)) AS total, max(o_orderdate) AS last FROM orders GROUP BY 1)
  SELECT c_custkey, CASE WHEN total > 1000000 AND last >= {NOW} - INTERVAL 30 DAY THEN 'high-value recent'
    WHEN total > 1000000 THEN 'high-value' WHEN total IS NOT NULL THEN 'active' ELSE 'inactive' END AS segment
  FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def segments(t):
    return R.segments(
        t.customer, "c_custkey", t.orders, "o_custkey", "o_totalprice", "o_orderdate",
        latest_order_date(t), high=1_000_000, scale=4,
    )


@case("""WITH s AS (SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS revenue FROM orders GROUP BY 1)
  SELECT o_orderpriority, revenue, round(revenue / (SELECT sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders), 6) AS share FROM s""")
def share_of_total(t):
    out = R.share_of_total(t.orders, "o_orderpriority", "o_totalprice", scale=4)
    return out.withColumn("share", F.round("share", 6))
