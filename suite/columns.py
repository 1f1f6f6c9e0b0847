"""Column roles, types and result shapes."""

from pyspark.sql import functions as F

from siftwell.operators import columns as C
from siftwell.operators import output
from siftwell.roles import Roles, to_source, to_standard
from suite.registry import case

PART = Roles(id="p_partkey", name="p_name", status="p_type", extra={"price": "p_retailprice"})


def jobs(t):
    """Events under the column names of a job log."""
    return t.events.select(
        F.col("event_id").alias("job_id"),
        F.concat("event_type", F.lit("_job")).alias("job_name"),
        F.col("event_type").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("value").alias("duration_minutes"),
        F.lit("").alias("error_message"),
        F.when(F.col("user_id") > 10, "yes").otherwise("no").alias("is_large"),
        F.col("user_id").alias("retry_count"),
        F.col("user_id").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
    )


SQL_JOBS = """SELECT event_id AS job_id, event_type || '_job' AS job_name, event_type AS status,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, value AS duration_minutes, '' AS error_message,
    CASE WHEN user_id > 10 THEN 'yes' ELSE 'no' END AS is_large, user_id AS retry_count, user_id AS user_id,
    strftime(ts, '%Y-%m-%d') AS run_date FROM events"""
JOB_COLUMNS = (
    "job_id", "job_name", "status", "created_at", "duration_minutes",
    "error_message", "is_large", "retry_count", "user_id", "run_date",
)


def sql_profile() -> str:
    """What the values of every column look like, counted in the table itself."""
    number = "regexp_full_match(x, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
    cells = " UNION ALL ".join(f"SELECT '{c}' AS c, typeof({c}) AS kind, {c}::VARCHAR AS x FROM jobs" for c in JOB_COLUMNS)
    return f"""jobs AS ({SQL_JOBS}), cells AS ({cells}),
    p AS (SELECT c, max(kind) AS kind, count(*) AS n, count(*) FILTER (x <> '') AS filled, count(DISTINCT x) AS distinct_values,
        count(*) FILTER (x <> '' AND {number}) AS numeric,
        count(*) FILTER (regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS dated,
        count(*) FILTER (lower(x) IN ('true', 'false', 'yes', 'no', '1', '0')) AS bools FROM cells GROUP BY c)"""


def named(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(c, '{p}')" for p in parts) + ")"


@case(f"""WITH {sql_profile()},
    v AS (SELECT c, 'id' AS role, CASE c WHEN 'job_id' THEN 0 WHEN 'user_id' THEN 1 END AS place FROM p
            WHERE c IN ('job_id', 'user_id') AND filled = n AND distinct_values = n
          UNION ALL SELECT c, 'name', 0 FROM p WHERE c = 'job_name' AND filled > 0
          UNION ALL SELECT c, 'status', 0 FROM p WHERE c = 'status' AND distinct_values * 2 <= n
          UNION ALL SELECT c, 'timestamp', 0 FROM p WHERE {named("date", "time", "created", "updated", "modified", "published")}
          UNION ALL SELECT c, 'numeric', 0 FROM p WHERE {named("count", "number", "amount", "price", "quantity", "duration", "minutes")}
          UNION ALL SELECT c, 'text', 0 FROM p WHERE {named("text", "description", "message", "error", "name", "title")})
  SELECT c AS "column", role FROM v QUALIFY rank() OVER (PARTITION BY role ORDER BY place) = 1""")
def roles_infer(t):
    return C.infer_roles(jobs(t))


@case(f"""WITH {sql_profile()} SELECT c AS "column", CASE WHEN c IN ('job_name', 'status') THEN 'text' WHEN filled = 0 THEN 'unknown'
    WHEN dated >= 0.95 * filled THEN 'timestamp' WHEN numeric >= 0.95 * filled THEN 'numeric' ELSE 'text' END AS type FROM p""")
def types_profile(t):
    return C.field_types(jobs(t), Roles(id="job_id", name="job_name", status="status"))


@case(f"""WITH {sql_profile()} SELECT c AS "column", CASE WHEN filled = 0 THEN 'empty' WHEN numeric >= 0.95 * filled THEN 'numeric'
    WHEN dated >= 0.95 * filled THEN 'date' WHEN bools >= 0.95 * filled THEN 'boolean' ELSE 'text' END AS class FROM p""")
def fields_classify(t):
    return C.field_classes(jobs(t))


@case(f"""WITH {sql_profile()} SELECT c AS "column", CASE WHEN starts_with(c, 'count') OR ends_with(c, 'count') THEN 'INTEGER'
    WHEN ends_with(c, '_dt') OR ends_with(c, '_at') THEN 'TIMESTAMP'
    WHEN {named("date", "time", "created", "updated", "modified")} AND filled > 0 AND dated >= 0.95 * filled THEN 'TIMESTAMP'
    WHEN kind = 'BIGINT' THEN 'INTEGER' WHEN kind = 'DOUBLE' THEN 'REAL' ELSE 'TEXT' END AS sql_type FROM p""")
def log_types(t):
    return C.log_column_types(jobs(t))


@case(f"""WITH {sql_profile()} SELECT role, c AS "column" FROM p JOIN (VALUES ('id', 'job_id'), ('name', 'job_name'),
    ('status', 'status'), ('date', 'created_at'), ('description', 'error_message')) AS l(role, listed) ON c = listed WHERE filled > 0""")
def roles_extended(t):
    """A listed column without any value plays no role."""
    return C.extended_roles(jobs(t).withColumn("description", F.col("error_message")))


@case("SELECT p_partkey AS id, p_name AS name, p_brand, p_type AS status, p_size, p_retailprice AS price FROM part")
def rename(t):
    return to_standard(t.part, PART)


@case("SELECT * FROM part")
def unrename(t):
    return to_source(to_standard(t.part, PART), PART)


@case("""SELECT event_id::VARCHAR AS id, event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    user_id::VARCHAR AS user_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS props FROM events""")
def output_shape(t):
    gaps = F.when(F.col("event_type") != "error", F.col("props"))
    events = t.events.drop("value").withColumn("props", gaps)
    return output.shape_text(events, Roles(id="event_id", name="event_type"))


@case("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def json_fields(t):
    return C.json_fields(t.events, "props")


@case("SELECT p_partkey, p_name FROM part")
def drop_meta(t):
    scored = t.part.select("p_partkey", "p_name", F.lit(1.0).alias("_score"), F.lit("x").alias("_match_type"))
    return output.drop_meta(scored)
