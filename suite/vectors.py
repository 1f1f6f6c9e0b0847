"""Embedding index, nearest neighbours and fusion."""

import re
import string

import numpy as np
from pyspark.sql import functions as F

from siftwell.functions import vectors as V
from siftwell.operators import columns, fusion, search
from siftwell.operators import vectorindex as I
from siftwell.plans import ask
from siftwell.plans.ask import query_weight
from siftwell.roles import Roles
from siftwell.session import shared_folder
from suite.registry import case
from suite.scoring import sql_points

DIM = 64
QUERY = "hent was"
TARGET = V.embed_text(QUERY, DIM)
SQL_TARGET = "[" + ", ".join(repr(x) for x in TARGET) + "]::DOUBLE[]"
SQL_SIM = f"list_cosine_similarity(embedding::DOUBLE[], {SQL_TARGET})"
DOCS = Roles(id="doc_id", name="lang", status="source", texts=("text",))
K = 50


@case("""SELECT p_partkey, concat_ws(' ', 'p_name: ' || p_name, 'p_name: ' || p_name, 'p_name: ' || p_name,
    'p_type: ' || p_type, 'p_type: ' || p_type, 'p_brand: ' || p_brand) AS text FROM part""")
def row_text(t):
    roles = Roles(id="p_partkey", name="p_name", status="p_type")
    text = V.row_text(t.part, ["p_name", "p_type", "p_brand"], V.embedding_weights(roles))
    return t.part.select("p_partkey", text.alias("text"))


@case("""SELECT event_id, concat_ws(' ', 'event_type:' || event_type, 'event_type:' || event_type,
    'user_id:' || user_id::VARCHAR,
    'ts:' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' ||
      floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0)::BIGINT::VARCHAR || ' days ago',
    'props:object') AS text FROM events""")
def row_text_json(t):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    events = t.events
    weights = {"event_type": 2.0, "value": 0.0}
    text = V.row_text_typed(events, ["event_type", "user_id", "ts", "value", "props"], weights, as_of)
    return events.select("event_id", text.alias("text"))


@case("""SELECT c AS "column" FROM (SELECT 'c_name' AS c, max(length(c_name)) AS longest FROM customer
    UNION ALL SELECT 'c_mktsegment', max(length(c_mktsegment)) FROM customer) WHERE longest > 5 OR c = 'c_name'""")
def text_fields(t):
    return columns.text_fields(t.customer, Roles(id="c_custkey", name="c_name", status=None))


def versions(t):
    """Every vector twice: reversed in sign as version 0, as it is as version 1."""
    flipped = F.transform("embedding", lambda x: -x)
    old = t.embeddings.withColumn("embedding", flipped).withColumn("version", F.lit(0))
    return old.unionByName(t.embeddings.withColumn("version", F.lit(1)))


def index(t):
    return I.build_index(versions(t), "vec_id", "embedding", "version", ["label"])


SQL_UNIT = """list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT)"""
SQL_INDEX = f"""SELECT vec_id::VARCHAR AS id, label, len(embedding) AS dim,
    round(({SQL_UNIT})[1]::DOUBLE, 5) AS first, round(({SQL_UNIT})[64]::DOUBLE, 5) AS last FROM embeddings"""


def show_index(built):
    return built.select(
        "id",
        F.col("data.label").alias("label"),
        F.size("embedding").cast("long").alias("dim"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"),
        F.round(F.get("embedding", F.lit(DIM - 1)).cast("double"), 5).alias("last"),
    )


@case(SQL_INDEX)
def index_build(t):
    return show_index(index(t))


@case(SQL_INDEX)
def index_roundtrip(t):
    path = shared_folder(t.spark, "index")
    I.save_index(index(t), path, DIM)
    items, _ = I.load_index(t.spark, path)
    return show_index(items)


@case("SELECT 64::INT AS dim, count(*) AS count, 1::INT AS version FROM embeddings")
def index_meta(t):
    path = shared_folder(t.spark, "index")
    I.save_index(index(t), path, DIM)
    return I.load_index(t.spark, path)[1]


@case("""SELECT count(*) AS items, 0::BIGINT AS wrong_dim, 0::BIGINT AS no_data, 0::BIGINT AS repeated,
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphans,
    (SELECT count(*) = 0 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS valid
  FROM embeddings""")
def index_verify(t):
    data = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    return I.verify_index(index(t), DIM, data)


@case("""SELECT count(*) AS items, 64::BIGINT AS dim, (count(*) * 64 * 4)::BIGINT AS approx_bytes FROM embeddings""")
def index_stats(t):
    return I.index_stats(index(t))


@case(f"""SELECT vec_id, label, round({SQL_SIM}, 6) AS score FROM embeddings
  ORDER BY {SQL_SIM} DESC, vec_id LIMIT {K}""")
def knn(t):
    near = I.knn(t.embeddings, "vec_id", "embedding", TARGET, K)
    return near.select("vec_id", "label", F.round("_score", 6).alias("score"))


def items(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


SQL_CENTRES = """c AS (SELECT label AS query_id, list(m::FLOAT::DOUBLE ORDER BY i) AS centre FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label)"""


@case(f"""WITH {SQL_CENTRES}, s AS (
    SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], centre) AS sim FROM c, embeddings)
  SELECT query_id, id, round(sim, 5) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5""")
def knn_batch(t):
    centres = I.group_centres(t.embeddings, "label", "embedding")
    near = I.knn_batch(items(t), centres, 5)
    return near.select("query_id", "id", F.round("_score", 5).alias("score"), "rank")


SQL_ALL = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b)
  SELECT query_id, id, round(sim, 6) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 3"""


@case(SQL_ALL)
def knn_all(t):
    """Every vector is a query; blocks meet blocks."""
    near = I.knn_batch(items(t), items(t), 3, broadcast_bytes=0, block_bytes=256 << 10)
    return near.select("query_id", "id", F.round("_score", 6).alias("score"), "rank")


def keyword_side(t, query=QUERY):
    found = search.best_matches(t.documents, query, DOCS, K, ["text", "lang", "source"])
    return found.select(F.col("doc_id").alias("id"), "_score")


def vector_side(t):
    near = I.knn(t.embeddings, "vec_id", "embedding", TARGET, K)
    return near.select(F.col("vec_id").alias("id"), "_score")


def sql_sides(query: str = QUERY) -> str:
    score = (
        f"({sql_points('text', query)} + {sql_points('lang', query)} * 3 + {sql_points('source', query)} * 2)"
    )
    return f"""k AS (SELECT doc_id AS id, {score} AS s FROM documents WHERE {score} > 0 ORDER BY s DESC, id LIMIT {K}),
      v AS (SELECT vec_id AS id, {SQL_SIM} AS s FROM embeddings ORDER BY s DESC, id LIMIT {K}),
      p AS (SELECT (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM k) AS pk,
                   (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM v) AS pv),
      f AS (SELECT coalesce(k.id, v.id) AS id, k.s AS ks, v.s AS vs, coalesce(k.s, 0) / pk AS a, coalesce(v.s, 0) / pv AS b
            FROM k FULL OUTER JOIN v ON k.id = v.id, p)"""


@case(f"""WITH {sql_sides()} SELECT id, round(a, 6) AS structured_score, round(b, 6) AS vector_score,
    round(0.6 * a + 0.4 * b, 6) AS score FROM f ORDER BY 0.6 * a + 0.4 * b DESC, id LIMIT {K}""")
def fuse_weighted(t):
    return fusion.fuse_weighted(keyword_side(t), vector_side(t), 0.4, K).select(
        "id",
        F.round("_structured_score", 6).alias("structured_score"),
        F.round("_vector_score", 6).alias("vector_score"),
        F.round("_score", 6).alias("score"),
    )


def show_hybrid(found):
    return found.select("id", F.round("_score", 6).alias("score"), F.col("_result_type").alias("side"))


SIDE = "CASE WHEN ks IS NULL THEN 'vector' WHEN vs IS NULL THEN 'structured' ELSE 'both' END AS side"


@case(f"""WITH {sql_sides()} SELECT id, round(0.3 * a + 0.7 * b, 6) AS score, {SIDE}
  FROM f ORDER BY 0.3 * a + 0.7 * b DESC, id LIMIT {K}""")
def hybrid(t):
    return show_hybrid(fusion.hybrid(keyword_side(t), vector_side(t), query_weight(QUERY), K))


@case(f"""WITH {sql_sides().replace("doc_id AS id", "doc_id::VARCHAR AS id").replace("vec_id AS id", "vec_id::VARCHAR AS id")}
  SELECT id, round(0.3 * a + 0.7 * b, 5) AS score, {SIDE} FROM f ORDER BY 0.3 * a + 0.7 * b DESC, id LIMIT {K}""")
def hybrid_search(t):
    """The whole way: index, route, both sides, fusion; ids are text."""
    docs = t.documents.withColumn("doc_id", F.col("doc_id").cast("string"))
    built = I.build_index(t.embeddings, "vec_id", "embedding")
    found = ask.hybrid_search(docs, built, QUERY, DOCS, DIM, K, fields=["text", "lang", "source"])
    return found.select("id", F.round("_score", 5).alias("score"), F.col("_result_type").alias("side"))


HELD = "SELECT * FROM documents WHERE n_chars > 900"


@case(f"""WITH {sql_sides().replace("FROM documents", f"FROM ({HELD})").replace("FROM embeddings", f"FROM embeddings WHERE vec_id IN (SELECT doc_id FROM ({HELD}))")}
  SELECT doc_id, source, round(0.5 * a + 0.5 * b, 5) AS combined, round(a, 5) AS structured, round(b, 5) AS vector, {SIDE}
  FROM f JOIN documents ON doc_id = id ORDER BY 0.5 * a + 0.5 * b DESC, id::VARCHAR LIMIT {K}""")
def hybrid_rows(t):
    """Whole rows with three scores; the condition holds for keywords and vectors alike."""
    built = I.build_index(t.embeddings, "vec_id", "embedding", kind="double")
    found = ask.hybrid_rows(t.documents, built, f"n_chars>900 {QUERY}", DOCS, DIM, K, weight=0.5, fields=["text", "lang", "source"])
    return found.select(
        "doc_id",
        "source",
        F.round("_combined_score", 5).alias("combined"),
        F.round("_structured_score", 5).alias("structured"),
        F.round("_vector_score", 5).alias("vector"),
        F.col("_result_type").alias("side"),
    )


@case(f"""SELECT doc_id::VARCHAR AS id, 1.0::DOUBLE AS score, 'structured' AS side FROM documents
  WHERE lower(lang) = 'fr' AND n_chars > 1000 ORDER BY doc_id LIMIT {K}""")
def hybrid_search_structured(t):
    found = ask.hybrid_search(t.documents, index(t), "lang:fr n_chars>1000", DOCS, DIM, K)
    return found.select("id", F.round("_score", 5).alias("score"), F.col("_result_type").alias("side"))


@case()
def index_from_text(t):
    built = I.index_table(t.documents, DOCS, ["lang", "source", "text"], DIM)
    return built.select("id", F.size("embedding").alias("dim"), F.col("data.lang").alias("lang"))


@case(f"""SELECT vec_id AS id, round({SQL_SIM}, 6) AS score, 'vector' AS side FROM embeddings
  ORDER BY {SQL_SIM} DESC, id LIMIT {K}""")
def hybrid_no_keyword_hit(t):
    return show_hybrid(fusion.hybrid(keyword_side(t, "qqqxyzzy"), vector_side(t), 0.5, K))


@case(f"""WITH {sql_sides()} SELECT id, round(s, 6) AS score, tier FROM (
    SELECT id, s, 0 AS tier FROM k UNION ALL SELECT id, s, 1 FROM v WHERE id NOT IN (SELECT id FROM k))
  ORDER BY tier, s DESC, id LIMIT {K + 20}""")
def fuse_sequential(t):
    found = fusion.fuse_sequential(keyword_side(t), vector_side(t), K + 20)
    return found.select("id", F.round("_score", 6).alias("score"), "tier")


@case(f"""WITH {sql_sides()}, rk AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM k),
    rv AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM v),
    z AS (SELECT coalesce(rk.id, rv.id) AS id, coalesce(1 / (60.0::DOUBLE + rk.r), 0) + coalesce(1 / (60.0::DOUBLE + rv.r), 0) AS s
          FROM rk FULL OUTER JOIN rv ON rk.id = rv.id)
  SELECT id, round(s, 8) AS score FROM z ORDER BY s DESC, id LIMIT {K}""")
def fuse_rrf(t):
    found = fusion.fuse_by_rank(keyword_side(t), vector_side(t), K)
    return found.select("id", F.round("_score", 8).alias("score"))


@case()
def mock_embedding(t):
    made = t.documents.select("doc_id", V.embedding(F.col("text"), DIM).alias("e"))
    return made.select(
        "doc_id",
        F.size("e").alias("dim"),
        F.round(V.norm(F.col("e")), 4).alias("norm"),
        F.round(F.get("e", F.lit(0)).cast("double"), 5).alias("first"),
    )


def hashed_counts():
    """A small model of our own: how often tokens fall into each of 64 cells, by first letter and length."""

    def run(texts):
        out = np.zeros((len(texts), DIM))
        for row, text in zip(out, texts):
            words = re.findall("[a-z]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
            np.add.at(row, [(ord(w[0]) + 31 * len(w)) % DIM for w in words], 1)
        return out

    return run


COUNTS = V.Model("hashed counts", DIM, hashed_counts)
ASKED = "the report of a small harbour in the north"
SQL_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')"
SQL_CELLS = f"""w AS (SELECT doc_id, unnest({SQL_WORDS.format("'text: ' || text")}) AS word FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, (ascii(word) + 31 * length(word)) % 64 AS cell, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
    u AS (SELECT doc_id, cell, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM c)"""


def counted_index(t):
    return I.index_table(t.documents, DOCS, ["text"], DIM, model=COUNTS, kind="double")


@case(f"""WITH {SQL_CELLS} SELECT doc_id::VARCHAR AS id, 64::BIGINT AS dim, round(sum(x * (cell + 1)), 5) AS weighted,
    round(max(x), 5) AS largest FROM u GROUP BY doc_id""")
def index_from_model(t):
    """An index of all documents, embedded by a function of the caller's."""
    weighted = V.dot(F.col("embedding"), F.sequence(F.lit(1), F.lit(DIM)))
    largest = F.round(F.array_max("embedding"), 5).alias("largest")
    return counted_index(t).select("id", F.size("embedding").cast("long").alias("dim"), F.round(weighted, 5).alias("weighted"), largest)


@case(f"""WITH {SQL_CELLS}, a AS (SELECT unnest({SQL_WORDS.format(f"'{ASKED}'")}) AS word),
    q AS (SELECT (ascii(word) + 31 * length(word)) % 64 AS cell, count(*)::DOUBLE AS n FROM a GROUP BY ALL),
    v AS (SELECT cell, n / sqrt(sum(n * n) OVER ()) AS y FROM q)
  SELECT doc_id::VARCHAR AS id, round(sum(x * y), 6) AS score FROM u JOIN v USING (cell) GROUP BY doc_id
  ORDER BY round(sum(x * y), 9) DESC, id LIMIT {K}""")
def knn_from_model(t):
    """The search string goes through the same function as the index."""
    near = I.knn(counted_index(t).select("id", "embedding"), "id", "embedding", COUNTS.one(ASKED, DIM), K, unit=True)
    return near.select("id", F.round("_score", 6).alias("score"))
