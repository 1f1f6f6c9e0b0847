"""Sources, sinks and streams: written to the shared folder and read back."""

from pyspark.sql import functions as F

from siftwell.functions.vectors import norm
from siftwell.operators.output import csv_columns
from siftwell.roles import Roles, to_standard
from siftwell.session import shared_folder
from siftwell.sources import scans, sinks
from siftwell.streaming import jobs
from suite.registry import case

EVENTS = Roles(id="event_id", name="event_type")
#: Rows that one task writes to one file.
FILE_DOCUMENTS, FILE_EVENTS = 20_000, 500_000
TEXT_EVENTS = "event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS user_id, value::VARCHAR AS value, props"


def events(t):
    return t.events.select("event_id", "event_type", "user_id", "value", "props")


@case(f"SELECT {TEXT_EVENTS} FROM events")
def csv_scan(t):
    path = shared_folder(t.spark, "csv")
    rows = events(t)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return scans.read_csv(t.spark, path, scans.as_strings(rows.schema))


@case("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT event_id FROM events LIMIT 100)")
def csv_limit(t):
    path = shared_folder(t.spark, "csv")
    rows = events(t)
    rows.write.option("header", True).option("escape", '"').csv(path)
    head = scans.read_csv_head(t.spark, path, scans.as_strings(rows.schema), 100)
    return head.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@case("""SELECT event_id, event_type AS name, CASE WHEN value > 20 THEN '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' END AS extra
  FROM events""")
def json_scan(t):
    """Documents with records below ``data.records``, other values beside each record."""
    path = shared_folder(t.spark, "json")
    extra = F.when(F.col("value") > 20, F.from_json("props", "k long"))
    record = F.to_json(F.struct("event_id", F.col("event_type").alias("name"), extra.alias("extra")))
    document = F.concat(F.lit('{"data":{"records":[7,'), record, F.lit(',null,"x"]}}'))
    t.events.select(document.alias("value")).write.text(path)
    schema = "event_id long, name string, extra struct<k: long>"
    return scans.nested_as_json(scans.read_json_records(t.spark, path, "data.records", schema))


@case("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def json_coerce(t):
    at = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
    return scans.coerce_json(t.events.select("event_id", at.alias("at")), ["at"], "dd.MM.yyyy HH:mm:ss")


@case("""SELECT event_id, event_type AS name, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS retry_count,
    CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'click' THEN strftime(ts, '%Y-%m-%d 00:00:00')
      WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at
  FROM events""")
def log_ingest(t):
    kind = F.col("event_type")
    stamp = (
        F.when(kind == "view", F.date_format("ts", " yyyy-MM-dd HH:mm:ss "))
        .when(kind == "click", F.date_format("ts", "MM/dd/yyyy"))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("not a date")
    )
    raw = t.events.select(
        "event_id",
        F.concat(F.lit("  "), kind, F.lit(" ")).alias("name"),
        F.when(kind == "error", "bad").otherwise(F.col("user_id").cast("string")).alias("retry_count"),
        stamp.alias("created_at"),
    )
    clean = scans.clean_log(raw)
    return clean.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@case(f"SELECT {TEXT_EVENTS.replace('event_id,', 'id,').replace('event_type', 'event_type AS name')} FROM events")
def csv_sink(t):
    path = shared_folder(t.spark, "csv")
    rows = to_standard(events(t), EVENTS).withColumn("_score", F.lit(1.0))
    sinks.write_csv(rows, path)
    return scans.read_csv(t.spark, path, scans.as_strings(csv_columns(rows).schema), escaped_breaks=True)


EDGES = """SELECT doc_id, text, lang, source, n_chars,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' || lang || chr(9) WHEN 3 THEN chr(10) || source ELSE ' ' END AS note
  FROM documents"""


def edges(t):
    """Documents with a note that is empty, null, or has blanks or a break at its ends."""
    note = F.expr("""CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' || lang || chr(9)
        WHEN 3 THEN chr(10) || source ELSE ' ' END""")
    return t.documents.withColumn("note", note)


EDGES_READ = "note string, text string, n_chars long, source string, lang string, doc_id long"


@case(EDGES)
def csv_documents(t):
    """Texts with breaks, quotes, backslashes and blanks there and back; the reader's columns stand in another order."""
    path = shared_folder(t.spark, "csv")
    sinks.write_csv(edges(t), path)
    return scans.read_csv(t.spark, path, EDGES_READ, escaped_breaks=True)


def dealt(rows, batches, file_rows, *keys):
    """Rows dealt to files of about ``file_rows`` rows at most, and how many of them make one of so many batches."""
    per_batch = max(1, -(-rows.count() // (file_rows * batches)))
    return rows.repartition(batches * per_batch, *keys), per_batch


@case(EDGES)
def stream_csv_documents(t):
    """The same files as a stream, whose reader also names its columns in another order."""
    path, out, state = (shared_folder(t.spark, x) for x in ("csv", "streamed", "stream-state"))
    rows, per_batch = dealt(edges(t), 3, FILE_DOCUMENTS, "doc_id", "text")
    sinks.write_csv(rows, path)
    arriving = scans.stream_csv(t.spark, path, EDGES_READ, per_batch, escaped_breaks=True)
    run = arriving.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return t.spark.read.schema(arriving.schema).parquet(out)


@case("SELECT event_id, event_type, user_id, value, props FROM events")
def json_sink(t):
    path = shared_folder(t.spark, "json")
    rows = events(t)
    sinks.write_json(rows.withColumn("_score", F.lit(1.0)), path)
    return scans.read_json_records(t.spark, path, schema=rows.schema)


@case("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def sample(t):
    return scans.sample_rows(t.events.select("event_id", "event_type"), 20, ["event_id"])


@case("SELECT event_id, event_type, user_id, value, props FROM events")
def bulk_read(t):
    """The whole table through a sink and one read of all its files."""
    path = shared_folder(t.spark, "bulk")
    events(t).write.parquet(path)
    return t.spark.read.parquet(path)


@case("SELECT p_partkey, p_name, p_size FROM part")
def table_scan(t):
    t.part.select("p_partkey", "p_name", "p_size").createOrReplaceTempView("parts_table")
    return scans.read_table(t.spark, "parts_table")


@case("SELECT event_id, event_type, value FROM events WHERE value > 20 AND event_type = 'purchase'")
def stream_filter(t):
    base = shared_folder(t.spark, "stream")
    arriving = jobs.arriving(t.spark, t.path("events") + "*", t.events.schema)
    found = jobs.stream_filter(arriving, "event_type:purchase value>20", f"{base}/out", f"{base}/state")
    return found.select("event_id", "event_type", "value")


@case("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_csv(t):
    """CSV files taken in bounded micro-batches."""
    base = shared_folder(t.spark, "stream")
    rows = t.events.select("event_id", "user_id", "event_type")
    files, per_batch = dealt(rows, 4, FILE_EVENTS, "event_id")
    files.write.option("header", True).csv(f"{base}/in")
    stream = scans.stream_csv(t.spark, f"{base}/in", rows.schema, files_per_batch=2 * per_batch)
    found = jobs.stream_filter(stream, "event_id>=0", f"{base}/out", f"{base}/state")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@case("""SELECT vec_id::VARCHAR AS id, label::BIGINT AS version, 1.0::DOUBLE AS norm, round((embedding[1] /
    sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE, 5) AS first FROM embeddings""")
def stream_upsert(t):
    """Vectors arrive twice: an older, flipped version in one file, the newest in another."""
    base = shared_folder(t.spark, "stream")
    newest = t.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("version"))
    older = newest.withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn(
        "version", F.col("version") - 1
    )
    newest.write.parquet(f"{base}/in/a")
    older.write.parquet(f"{base}/in/b")
    arriving = jobs.arriving(t.spark, f"{base}/in/*", newest.schema, files_per_batch=1)
    index = jobs.stream_upsert(arriving, "vec_id", "embedding", "version", f"{base}/out", f"{base}/state")
    return index.select(
        "id",
        "version",
        F.round(norm(F.col("embedding")), 4).alias("norm"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"),
    )


@case("""SELECT vec_id::VARCHAR AS id, label::BIGINT + 7 AS version, round((embedding[1] /
    sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE, 5) AS first FROM embeddings""")
def stream_upsert_merged(t):
    """Eight versions of every vector in eight batches, the newest in the first; runs of two levels."""
    base = shared_folder(t.spark, "stream")
    given = t.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("version"))
    schema = given.schema
    for batch in range(8):
        turned = F.transform("embedding", lambda x: x if batch == 0 else -x)  # noqa: B023
        rows = given.withColumn("embedding", turned).withColumn("version", F.col("version") + 7 - batch)
        rows.write.mode("append").parquet(f"{base}/in")
        arriving = jobs.arriving(t.spark, f"{base}/in", schema)
        index = jobs.stream_upsert(arriving, "vec_id", "embedding", "version", f"{base}/out", f"{base}/state", fan=2)
    return index.select("id", "version", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))
