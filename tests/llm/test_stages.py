"""Stages of the pipeline on columns of any name and type, and the pipeline as a whole."""

import datetime as dt

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from siftwell.llm import exact, minhash, packing, rules, suffix
from tests.conftest import DATA
from tests.llm.conftest import HARD

#: Names that stages use themselves or used once, and names that are no identifiers.
NAMES = ["k_id", "k_sha", "k_text", "sha", "s", "id", "body", "block", "part", "rest", "row", "node", "label", "keep_id", "n", "a b", "x-y", "a.b", "ü"]
MODEL = rules.RuleModel(1.0, [])


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that may not be null, nested ones too, beside the hard rows and a passage that two documents share."""
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [*HARD, (20, f"first {passage} end"), (21, f"second one {passage} over")]
    inner = T.StructType([T.StructField("at", T.TimestampType(), False), T.StructField("of", T.ArrayType(T.LongType(), False), False)])
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("nested", inner, False),
            T.StructField("text", T.StringType()),
            T.StructField("map", T.MapType(T.StringType(), T.IntegerType(), False), False),
            *[T.StructField(c, T.IntegerType(), False) for c in NAMES],
        ]
    )
    at = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
    rows = [(i, (at, [k]), t, {"k": k}, *range(len(NAMES))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "stage",
    [
        lambda d: rules.keep_good(d, MODEL),
        exact.kept_documents,
        lambda d: minhash.nearly_unique(d, corpus_pipeline.NEAR),
        lambda d: suffix.without_repeats(d, corpus_pipeline.PASSAGE_BYTES),
    ],
)
def test_odd_columns_survive(odd, stage):
    found = stage(odd)
    assert found.columns == odd.columns
    assert [f.dataType.simpleString() for f in found.schema] == [f.dataType.simpleString() for f in odd.schema]
    rows = found.collect()
    before = {(r["nested"]["of"][0]): r for r in odd.collect()}
    assert rows
    for row in rows:
        mine = before[row["nested"]["of"][0]]
        assert [row[c] for c in odd.columns if c != "text"] == [mine[c] for c in odd.columns if c != "text"]
        assert len(row["text"] or "") <= len(mine["text"] or "")
    assert stage(odd.limit(0)).collect() == []


def test_packing_takes_odd_columns(odd):
    import public_tokenizers

    pieces = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json"))
    assert pieces.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_whole_pipeline(spark, monkeypatch):
    """Places of ``run`` are gapless, and it packs exactly what the stages before it kept."""
    kept = []
    real = corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: kept.append(real(df, name)) or kept[-1])
    found = corpus_pipeline.run(spark, DATA).collect()
    assert len(kept) == 4
    assert {r.doc_id for r in found} == {r.doc_id for r in kept[-1].select("doc_id").collect()}
    sequences = {}
    for row in found:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_statistics_by_spark_and_by_hand(spark, frame):
    """The statistics that can be said in SQL, computed by Spark's own functions."""
    name = dict(zip(rules.STATISTICS, range(len(rules.STATISTICS))))
    docs = frame([(1, "One two two.\n\nThree three, four!"), (2, ""), (3, None), (4, "- a\n- b\n- a")])
    for row in docs.select("text", rules.statistics_column("text").alias("s")).collect():
        assert list(row.s) == rules.statistics((row.text or "").encode())
    assert len(name) == len(rules.statistics(b"x"))
