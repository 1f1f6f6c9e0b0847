"""Analysis of a search log that is derived from events and conversations."""

from pyspark.sql import functions as F

from siftwell.functions import querytext as Q
from siftwell.operators import querylog as ops
from suite.registry import case

AS_OF = "2024-01-31 00:00:00"
# The same text in both engines: one search string per event.
EVENT_QUERY = """CASE event_type
  WHEN 'view' THEN 'event_type:view value>' || CAST(CAST(value AS DECIMAL(10,2)) AS STRING)
       || ' name="top ' || CAST(user_id AS STRING) || ' items"'
  WHEN 'click' THEN 'How many click events are there in the last ' || CAST(user_id AS STRING)
       || ' days? group by user_id'
  WHEN 'error' THEN 'find errors similar to item id ' || CAST(event_id AS STRING)
  WHEN 'purchase' THEN 'total number of purchases with user_id=' || CAST(user_id AS STRING)
       || ' AND value <= ' || CAST(CAST(value AS DECIMAL(10,2)) AS STRING) || ' from last 2 weeks'
  ELSE 'signup #' || CAST(user_id AS STRING) || ' status:failed' END"""
LOG = f"""log AS (
  SELECT 'e' || CAST(event_id AS STRING) AS qid, {EVENT_QUERY} AS q FROM events
  UNION ALL
  SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations)"""

# The words and patterns of the search-string notation, as the library must read them.
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
COUNTING = ("how many", "count", "total", "number of", "tally", "sum of", "sum up", "calculate", "compute")
STRUCTURED = (
    "status:", "id:", "name:", "by:", "priority:", "started:", "completed:",
    "failed", "success", "running", "pending", ">", "<", ">=", "<=", "=",
)
SEMANTIC = ("like", "similar", "about", "related to", "concerning", "regarding", "find", "search for", "show me")


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + ")"


SQL_COUNTING = f"({any_of(COUNTING)} OR regexp_matches(lower(q), '(^|{NOT_W})(how\\s+many|number\\s+of)($|{NOT_W})'))"
SQL_CLASS = f"""CASE WHEN {SQL_COUNTING} THEN 'counting'
  WHEN {any_of(STRUCTURED)} AND {any_of(SEMANTIC)} THEN 'hybrid'
  WHEN {any_of(STRUCTURED)} THEN 'structured' ELSE 'semantic' END"""
SQL_FORM = f"regexp_matches(q, '(?i){W}[:=<>]|(^|{NOT_W})(and|or)($|{NOT_W})')"
SQL_WORDS = r"list_filter(regexp_split_to_array(lower(q), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '')"
SQL_ROUTE = f"""CASE WHEN {SQL_FORM} AND NOT list_has_any({SQL_WORDS},
  ['like', 'similar', 'about', 'related', 'search', 'find', 'matching']) THEN 'structured' ELSE 'hybrid' END"""
# Fixed values.
TARGETS = (
    r"how\s+many\s+(.*?)(?:\s+are|\s+with|\s+in|\s+is|\s+do|\?|\n?\z)",
    r"count\s+(?:of\s+)?(.*?)(?:\s+in|\s+with|\s+that|\?|\n?\z)",
    r"total\s+(?:number\s+of\s+)?(.*?)(?:\s+in|\s+with|\s+that|\?|\n?\z)",
    r"number\s+of\s+(.*?)(?:\s+in|\s+with|\s+that|\?|\n?\z)",
)
# Fixed values.
ITEMS = ("item", "items", "record", "records", "entry", "entries", "document", "documents", "result", "results")
SQL_TARGET = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN trim(regexp_extract(lower(q), '{p}', 1))" for p in TARGETS)
    + " ".join(f" WHEN contains(lower(q), '{w}') THEN '{w}'" for w in ITEMS)
    + " ELSE 'items' END"
)
SQL_ID = (
    r"nullif(regexp_extract(regexp_extract(lower(q), "
    r"'(?:^|\s)id\s*[:=]?\s*\d+|(?:^|\s)item\s+id\s*[:=]?\s*\d+|(?:^|\s)#\d+'), '(\d+)$', 1), '')"
)
# Fixed values.
LOOSE = (
    r"(?:^|\s)id\s*[:=]?\s*(\d+)", r"(?:^|\s)(?:item|job)\s+id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)(?:item|job)[-_]id\s*[:=]?\s*(\d+)", r"(?:^|\s)#(\d+)",
    r"(?:^|\s)number\s*[:=]?\s*(\d+)", r"(?:^|\s)(\d{4,})\s*\z",
)
SQL_LOOSE_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(lower(q), '{p}', 1), '')" for p in LOOSE) + ")"
SQL_GROUP = f"nullif(regexp_extract(lower(q), 'group by\\s+({W}+)', 1), '')"


def sql_strip() -> str:
    blank = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"

    def trimmed(x: str) -> str:
        return f"regexp_replace({x}, '^{blank}+|{blank}+\\z', '', 'g')"

    text = "lower(q)"
    for word in (*COUNTING, "?"):
        text = trimmed(f"replace({text}, '{word}', '')")
    runs = f"regexp_extract_all({text}, '{W}+|{NOT_W}+')"
    fillers = "['are', 'is', 'there', 'do', 'we', 'have', 'the']"
    kept = f"array_to_string(list_transform({runs}, lambda x: CASE WHEN list_contains({fillers}, x) THEN '' ELSE x END), '')"
    grouped = f"regexp_replace(coalesce({kept}, ''), 'group by\\s+{W}+', '', 'g')"
    return trimmed(grouped)


SPAN = r"(?:in|from|within)\s+(?:the\s+)?last\s+(\d+)\s+(day|week|month|year)s?"
SQL_DAYS = f"""(try_cast(regexp_extract(lower(q), '{SPAN}', 1) AS INT)
  * CASE regexp_extract(lower(q), '{SPAN}', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END)"""
SQL_START = f"strftime(TIMESTAMP '{AS_OF}' - to_days({SQL_DAYS}), '%Y-%m-%d %H:%M:%S')"
VALUE = rf'{W}+[:=]"[^"]+"|{W}+[:=]\S+'
COMPARE = rf"{W}+\s*(?:<=|>=|<|>|=|!=)\s*\d+(?:\.\d+)?"
NUMBER = r"\d+(?:\.\d+)?"
SQL_FILTERS = f"""
  SELECT qid, regexp_extract(m, '^({W}+)', 1) AS field,
    CASE WHEN regexp_matches(m, '^{W}+={NUMBER}$') THEN 'eq' ELSE 'is' END AS op,
    trim(regexp_extract(m, '(?s)^[^:=]+[:=](.*)$', 1), '"') AS value
  FROM (SELECT qid, unnest(regexp_extract_all(q, '{VALUE}')) AS m FROM log)
  UNION ALL
  SELECT qid, regexp_extract(m, '^({W}+)', 1),
    CASE regexp_extract(m, '([<>=!]+)', 1) WHEN '<' THEN 'lt' WHEN '>' THEN 'gt' WHEN '<=' THEN 'lte'
      WHEN '>=' THEN 'gte' WHEN '=' THEN 'eq' ELSE 'neq' END,
    regexp_extract(m, '({NUMBER})$', 1)
  FROM (SELECT qid, unnest(regexp_extract_all(regexp_replace(q, '{VALUE}', ' ', 'g'), '{COMPARE}')) AS m FROM log)
  UNION ALL
  SELECT qid, 'timestamp', 'gte', {SQL_START} FROM log WHERE {SQL_DAYS} IS NOT NULL"""


def search_log(t):
    events = t.events.select(F.expr("'e' || event_id").alias("qid"), F.expr(EVENT_QUERY).alias("q"))
    turns = t.conversations.select(F.expr("'c' || conv_id || '-' || turn").alias("qid"), F.col("text").alias("q"))
    return events.unionByName(turns)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def rule(t, **columns):
    return search_log(t).select("qid", *[make(F.col("q")).alias(n) for n, make in columns.items()])


@case(f"WITH {LOG} SELECT qid, {SQL_CLASS} AS kind FROM log")
def q_classify(t):
    return rule(t, kind=Q.classify)


@case(f"""WITH {LOG} SELECT qid, {SQL_ROUTE} AS route,
  CASE WHEN NOT {SQL_FORM} AND len({SQL_WORDS}) <= 3 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM log""")
def q_route(t):
    return rule(t, route=Q.route, weight=Q.vector_weight)


@case(f"""WITH {LOG} SELECT qid, {SQL_COUNTING} AS counting, regexp_matches(lower(q),
  '(^|{NOT_W})({"|".join(w.replace(" ", chr(92) + "s+") for w in COUNTING)})($|{NOT_W})') AS counting_words FROM log""")
def q_counting(t):
    return rule(t, counting=Q.is_counting, counting_words=lambda q: Q.is_counting(q, word_boundary=True))


@case(f"WITH {LOG} SELECT qid, {SQL_TARGET} AS target FROM log")
def q_target(t):
    return rule(t, target=Q.count_target)


@case(f"WITH {LOG} SELECT qid, {SQL_ID} AS id_value, {SQL_LOOSE_ID} AS loose_id FROM log")
def q_id(t):
    return rule(t, id_value=Q.id_in_query, loose_id=lambda q: Q.id_in_query(q, loose=True))


@case(f"WITH {LOG} {SQL_FILTERS}")
def q_filters(t):
    return ops.query_filters(search_log(t), "q", as_of())


@case(f"WITH {LOG} SELECT qid, {sql_strip()} AS stripped FROM log")
def q_strip(t):
    return rule(t, stripped=Q.strip_counting)


@case(f"""WITH {LOG}, f AS ({SQL_FILTERS}), n AS (SELECT qid, count(*) AS n FROM f GROUP BY qid)
  SELECT log.qid, {SQL_ID} AS id_value, {SQL_COUNTING} AS counting, {SQL_CLASS} AS kind,
    CASE WHEN {SQL_COUNTING} THEN {SQL_TARGET} END AS count_target,
    CASE WHEN {SQL_COUNTING} THEN {sql_strip()} END AS search_text,
    CASE WHEN {SQL_DAYS} IS NOT NULL THEN {SQL_START} END AS window_start,
    coalesce(n.n, 0) AS n_filters
  FROM log LEFT JOIN n ON log.qid = n.qid""")
def q_explain(t):
    out = ops.explain_queries(search_log(t), "q", as_of()).drop("q")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@case(f"WITH {LOG} SELECT qid, {SQL_GROUP} AS field FROM log")
def q_groupby(t):
    return rule(t, field=Q.group_by_field)
