"""Data quality and exploration."""

from pyspark.sql import functions as F

from siftwell.operators import quality as E
from siftwell.operators.quantiles import exact_quantiles
from suite.registry import case

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


def with_gaps(t):
    """Events joined to nothing: error values and signup users count as missing."""
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
    )


GAPS = """g AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN event_type <> 'signup' THEN user_id END AS user_id FROM events)"""


@case(f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls,
        round(count({c}) / count(*), 6) AS complete FROM g"""
    for c in ("event_id", "value", "user_id")
))
def null_profile(t):
    return E.completeness(with_gaps(t)).withColumn("complete", F.round("complete", 6))


@case("SELECT sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_rows(t):
    return E.duplicates(t.documents, ["text"], digest=True)


@case("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return E.duplicates(t.events, ["user_id", "event_type"])


@case(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
      min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
      quantile_cont({c}, 0.75) AS p75 FROM lineitem""" for c in NUMBERS
))
def descriptive_stats(t):
    out = E.describe(t.lineitem, NUMBERS)
    return out.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@case("""SELECT lang AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM documents), 6) AS share
  FROM documents GROUP BY 1""")
def frequency_table(t):
    return E.frequencies(t.documents, "lang").withColumn("share", F.round("share", 6))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]


@case(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in PAIRS
))
def correlation_matrix(t):
    return E.correlations(t.lineitem, NUMBERS).withColumn("corr", F.round("corr", 6))


@case("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F",
    count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS others
  FROM orders GROUP BY 1""")
def cross_tabulation(t):
    return E.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O"])


@case("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
  SELECT event_id, value, round((value - m) / s, 5) AS z FROM events, s WHERE abs((value - m) / s) > 2.5""")
def zscore_outliers(t):
    out = E.zscore_outliers(t.events, "value", 2.5)
    return out.select("event_id", "value", F.round("z", 5).alias("z"))


@case("""WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  SELECT event_id, value FROM events, s WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(t):
    return E.iqr_outliers(t.events, "value").select("event_id", "value")


@case("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
    w AS (SELECT *, count(*) OVER x AS seen, avg(n) OVER x AS mean, stddev_samp(n) OVER x AS sd FROM d
          WINDOW x AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
  SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(mean, 4) AS mean, round(sd, 4) AS sd
  FROM w WHERE seen = 7 AND abs(n - mean) > 2 * sd""")
def time_series_spikes(t):
    out = E.spikes(t.events, "ts", "event_type")
    return out.select(
        "event_type",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "n",
        F.round("mean", 4).alias("mean"),
        F.round("sd", 4).alias("sd"),
    )


@case("""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS vx,
      var_samp(l_extendedprice) AS vy, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, round((vy * (l_quantity - mx) ** 2 - 2 * c * (l_quantity - mx) * (l_extendedprice - my)
      + vx * (l_extendedprice - my) ** 2) / (vx * vy - c * c), 4) AS d2 FROM lineitem, s""")
def mahalanobis(t):
    out = E.mahalanobis(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", F.round("d2", 4).alias("d2"))


@case("""SELECT 'discount in range' AS rule, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.08)) AS violations FROM lineitem
  UNION ALL SELECT 'quantity below 45', count(*) FILTER (NOT (l_quantity < 45)) FROM lineitem
  UNION ALL SELECT 'returned means shipped', count(*) FILTER (NOT (l_returnflag <> 'R' OR l_linestatus = 'F')) FROM lineitem""")
def rule_violations(t):
    rules = {
        "discount in range": F.col("l_discount").between(0, 0.08),
        "quantity below 45": F.col("l_quantity") < 45,
        "returned means shipped": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"),
    }
    return E.violations(t.lineitem, rules)


@case("""WITH v AS (SELECT CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN 'Infinity'::DOUBLE
      WHEN l_quantity < 3 THEN '-Infinity'::DOUBLE WHEN l_linenumber = 5 THEN NULL WHEN l_quantity = 3 THEN -0.0
      ELSE l_extendedprice * power(10, l_linenumber * 4) END AS x, l_discount AS y FROM lineitem),
    q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS prob)
  SELECT 'x' AS "column", prob::DOUBLE AS prob, CASE prob WHEN 0 THEN (SELECT min(x) FROM v) WHEN 1 THEN (SELECT max(x) FROM v)
      WHEN 0.25 THEN (SELECT quantile_cont(x, 0.25) FROM v) WHEN 0.5 THEN (SELECT quantile_cont(x, 0.5) FROM v)
      ELSE (SELECT quantile_cont(x, 0.75) FROM v) END AS value FROM q
  UNION ALL SELECT 'y', prob::DOUBLE, CASE prob WHEN 0 THEN (SELECT min(y) FROM v) WHEN 1 THEN (SELECT max(y) FROM v)
      WHEN 0.25 THEN (SELECT quantile_cont(y, 0.25) FROM v) WHEN 0.5 THEN (SELECT quantile_cont(y, 0.5) FROM v)
      ELSE (SELECT quantile_cont(y, 0.75) FROM v) END FROM q""")
def quantiles_of_specials(t):
    """Exact quantiles of a column with NaN, infinities, signed zeros and a tail over many orders of magnitude."""
    x = F.expr("""CASE WHEN l_linenumber = 7 THEN double('NaN') WHEN l_linenumber = 6 THEN double('Infinity')
        WHEN l_quantity < 3 THEN double('-Infinity') WHEN l_linenumber = 5 THEN NULL WHEN l_quantity = 3 THEN -0.0D
        ELSE l_extendedprice * power(10, l_linenumber * 4) END""")
    rows = t.lineitem.select(x.alias("x"), F.col("l_discount").alias("y"))
    return exact_quantiles(rows, ["x", "y"], [0.0, 0.25, 0.5, 0.75, 1.0])
