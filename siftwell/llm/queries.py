"""The registered query of every operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bytebpe, divergence, exact, graph, hilbert, lm, merkle, minhash, packing, pieces, rules, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_suffix(spark, sf_dir):
    return suffix.repeats(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op2_minhash(spark, sf_dir):
    found = minhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark, sf_dir):
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("""SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN first END AS refers_to
  FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""")
def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # The table has no capture times: two captures a minute from the start of 2024.
    found = warc.archive_and_index(pages, F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 30))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_graph(spark, sf_dir):
    return graph.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op7_hilbert(spark, sf_dir):
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    law, none = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", none, "curve")


@query()
def op8_bloom(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query()
def op9_pieces(spark, sf_dir):
    found = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("ids")


@query()
def op10_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rules.quality_scores(docs, rules.fit_quality(docs, table(spark, sf_dir, "labels")))


@query(r"""WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 30),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    every AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (coalesce(t.total, 0) + 5 * v) AS p,
        1 + 1000000000 * (k.n + 5)::HUGEINT // (langs.total + 5 * v) AS q
      FROM groups JOIN kept k USING (lang) JOIN langs USING (lang)
      LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
    pairs AS (SELECT lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM every a JOIN every b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    both_parts AS (
      SELECT lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b USING (lang) LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      WHERE a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM every WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM both_parts QUALIFY part = 'pair' OR rank <= 50""")
def op11_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query()
def op12_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, {"text": F.when(hit, lowered).otherwise(F.col("text"))}).drop("path")


@query()
def op13_byte_pairs(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode_documents(table(spark, sf_dir, "documents"), path)
    return bytebpe.decode_documents(encoded, path).drop("text")
