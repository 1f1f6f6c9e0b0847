"""Archives, graphs, curve, language model, pieces, rules and the pipeline."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from siftwell.llm import graph, hilbert, lm, pieces, rules, warc
from tests.conftest import DATA
from tests.llm.conftest import HARD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key int")


def test_archives_and_index(spark):
    long = "p" * 120 + "\r\n\r\nWARC/1.1\r\né"
    rows = [
        (3, "http://www.b.org/x", long, "mine", 1),
        (1, "https://a.b.org/y?q=1", long, None, 1),
        (9, "http://a.b.org/y", None, None, 1),
        (None, None, long, None, 1),
        (4, "no url\r\nX-Header: 1", "short", None, 1),
        (5, "http://[bad", "short", None, 1),
        (7, "http://b.org/x", "z" * 100, None, 1),
        (7, "http://b.org/x", "z" * 100, None, 1),
    ]
    found = warc.archive_and_index(pages(spark, rows), F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    for id, _, html, _, _ in rows:
        data = (html or "").encode()
        assert (by_id[id].payload_bytes, by_id[id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    kinds = {i: (r.record_type, r.refers_to) for i, r in by_id.items()}
    assert kinds[3] == kinds[None] == ("revisit", 1)
    assert {kinds[i] for i in (1, 4, 5, 7, 9)} == {("response", None)}
    assert [r.urlkey for r in found] == sorted(r.urlkey for r in found)
    assert by_id[1].urlkey == "org,b,a)/y?q=1" and by_id[3].urlkey == "org,b)/x"
    assert warc.archive_and_index(pages(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    merged = list(warc.LoserTree([iter(sorted(r)) for r in runs], lambda x: x))
    assert merged == sorted(itertools.chain(*runs))


# Graphs


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:420] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [math.nan] * 8), (1300, [1.0, None] * 4), (None, rows[0][1]), (1400, [])]
    df = spark.createDataFrame([*rows, *bad, rows[5], (1500, [1.0, 2.0])], "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit("mine"))
    found = graph.nearest(df, settings=graph.Settings(shard=250))
    by_query = {}
    for r in found.orderBy("query_id", "rank").collect():
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    # The only vector of two components has no other to be near to.
    assert set(by_query) == set(range(0, 900, 100))
    hits = 0
    exact = x.astype(float)
    for q, own in by_query.items():
        away = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        best = sorted((away[i], i) for i in range(900) if i != q)[:10]
        assert own == sorted(own) and len(own) == 10
        assert all(abs(s - away[i]) < 1e-12 for s, i in own)
        hits += len({i for _, i in best} & {i for _, i in own})
    assert hits / 90 >= 0.95
    assert [i for _, i in by_query[300]] == list(range(301, 311))


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in graph.nearest(df).collect()] == [(1, 1, 1.0), (2, 2, 3.0)]
    assert graph.nearest(df.limit(0)).count() == 0


# Curve


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_curve_steps_to_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_hold_runs(frame, spark, tmp_path):
    docs = frame([*HARD, *[(50 + i, "w " * i) for i in range(61)]])
    placed = hilbert.hilbert_shards(docs, 5)
    rows = placed.collect()
    assert len(rows) == len(HARD) + 61
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(a.curve <= b.curve for a, b in itertools.pairwise(sorted(rows, key=lambda r: r.rank)))
    body = {i: (t or "").encode() for i, t in HARD if i}
    assert all((r.size, r.text_crc32) == (len(body[r.doc_id]) + 1, zlib.crc32(body[r.doc_id])) for r in rows if r.doc_id in body)
    assert hilbert.hilbert_shards(frame([]), 5).count() == 0
    unique = docs.filter("doc_id >= 50")
    shards = hilbert.hilbert_shards(unique, 4)
    known = hilbert.manifest(unique, shards, ("n_chars", "lang"))
    assert known.agg(F.sum("n")).first()[0] == 61 and known.filter("min_n_chars > max_n_chars").isEmpty()
    hilbert.write_shards(unique, shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 61


def test_cells_cover_the_range_of_numbers(spark):
    longs = [-(1 << 63) + 1, -70_000, -1, 0, 1, 900, 60_000, 70_000, 10**6, 10**9, 10**12, (1 << 63) - 1]
    df = spark.createDataFrame([(n, float(n)) for n in longs], "n long, x double").coalesce(1)
    for c, kind in (("n", T.LongType()), ("x", T.DoubleType())):
        cells = [r[0] for r in df.orderBy(c).select(hilbert.cell(c, kind)).collect()]
        assert cells == sorted(set(cells))
    far = spark.createDataFrame([(float("-inf"),), (1e300,), (float("inf"),)], "x double").coalesce(1)
    cells = [r[0] for r in far.select(hilbert.cell("x", T.DoubleType())).collect()]
    assert cells == sorted(set(cells))


def test_seven_dimensions_share_the_curve(frame):
    names = ("source", "lang", "n_chars", "a", "b", "c", "d")
    assert hilbert.hilbert_shards(frame([(i, "w " * i) for i in range(9)]), 3, names).count() == 9


# Language model


def test_scores(frame, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [*HARD, *[(100 + i, " ".join(draw.choices(vocabulary, k=30)).title()) for i in range(150)]]
    docs += [(400 + i, docs[20][1]) for i in range(30)]
    found = lm.score_documents(frame(docs)).collect()
    routed = lm.score_documents(frame(docs), 0).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(routed, key=key)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " "] for _, t in docs]
    trains = [zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i, _ in docs]
    count = Counter(w for own, t in zip(tokens, trains) if t for w in own)
    n, v = sum(count.values()), len(count)
    wanted = sorted(
        (-1 if i is None else i, not t, len(own), sum(count[w] > 0 for w in own), n,
         round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4))
        for (i, _), own, t in zip(docs, tokens, trains)
    )
    mine = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found
    )
    assert mine == wanted
    # Copies of a text that was learned from are far likelier than their words alone.
    assert all(r.score > r.base_score for r in found if r.doc_id and r.doc_id >= 400)
    assert all(r.score <= 0 for r in found)
    assert lm.score_documents(frame([])).count() == 0


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64))
    counts = rng.geometric(0.4, len(keys))
    made = lm.Filter.of([lm.build_slice(keys, counts)])
    level = made.levels(np.zeros(len(keys), np.int64), keys)
    assert (level >= lm.quantised(counts)).all() and (level > lm.quantised(counts)).mean() < 0.05
    others = np.setdiff1d(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64), keys)
    assert (made.levels(np.zeros(len(others), np.int64), others) > 0).mean() < 0.04


# Pieces


def encoder():
    return test_pieces_equal_the_library.__dict__.setdefault("made", pieces.PieceEncoder(MODEL, threads=1))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30) | st.text(st.sampled_from("ab ▁\n\té日🙂"), max_size=20))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    original = encoder().original
    ids = encoder().encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == original.encode(text)
    assert encoder().decode(ids) == text.replace("▁", " ")


def test_unigram_models_and_character_maps():
    model = pieces.Model(
        [("<unk>", 0.0, pieces.UNKNOWN), ("▁a", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁", -3.0, 1)]
    )
    assert pieces.rebuilt(model).encode("▁ab").tokens == ["▁a", "b"]
    assert pieces.rebuilt(model).encode("▁ax").ids[-1] == 0
    with open(MODEL, "rb") as file:
        parsed = pieces.parse(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [p[0] for p in parsed.pieces] == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert parsed.kind == pieces.BPE and parsed.byte_fallback and parsed.unknown == library.unk_id()


def test_wrong_parity_is_an_error():
    made = pieces.PieceEncoder(MODEL, threads=1)
    names = [p for p, *_ in made.model.pieces]
    a, b = names.index("▁the"), names.index("▁of")
    made.model.pieces[a], made.model.pieces[b] = made.model.pieces[b], made.model.pieces[a]
    made.tokenizer = pieces.rebuilt(made.model)
    with pytest.raises(ValueError, match="original library"):
        made.encode(["the"])


def test_documents_there_and_back(frame):
    found = pieces.encode_documents(frame(HARD), MODEL, threads=1)
    assert found.filter("NOT round_trip").isEmpty()
    back = pieces.decode_documents(found, MODEL)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in HARD)
    assert pieces.encode_documents(frame([]), MODEL).count() == 0


# Rules


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fit_quality(docs, labels)
    found = rules.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in found)
    assert right / len(found) >= 0.9
    assert all(0 <= r.score <= 1 for r in found)
    assert len(model.describe()) == len(model.rules) > 0


def test_rules_say_in_spark_what_they_say_here(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(rules.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = rules.fit_rules(x, y)
    z = rules.met_by([r for r, _ in model.rules], x)
    mine = 1 / (1 + np.exp(-(z @ np.array([w for _, w in model.rules]) + model.bias)))
    schema = "i int, " + ", ".join(f"{s} double" for s in rules.STATISTICS)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], schema)
    scored = df.select("i", model.score(F.struct(*rules.STATISTICS)).alias("p")).orderBy("i").collect()
    assert np.allclose([r.p for r in scored], mine, atol=1e-6)
    assert ((mine >= 0.5) == (y == 1)).mean() > 0.97


def test_scores_of_hard_rows(frame, spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = rules.fit_quality(frame(HARD), labels)
    assert rules.quality_scores(frame(HARD), model).count() == len(HARD)
    assert rules.quality_scores(frame([]), rules.fit_quality(frame([]), labels)).count() == 0
    assert rules.keep_good(frame(HARD), model).columns == frame(HARD).columns
    assert rules.fit_rules(np.zeros((0, len(rules.STATISTICS))), np.zeros(0)).bias == 0


# Pipeline


def test_stages_one_by_one(spark):
    """Each stage against brute force on what the one before it kept."""
    from siftwell.llm.common import written
    from tests.llm import test_minhash, test_suffix

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            good = [i for i in before if quality.get(i) == 1]
            assert sum(i in after for i in good) / len(good) >= 0.98
            assert all(after[i] == before[i] for i in after)
        elif name == "exact dedup":
            assert after == {max(i for i in before if before[i] == t): t for t in set(before.values())}
        elif name == "near dedup":
            real, test_minhash.shingles.__defaults__ = test_minhash.shingles.__defaults__, (5,)
            kept = {c for *_, c in test_minhash.brute(sorted(before.items()), 80)}
            test_minhash.shingles.__defaults__ = real
            assert after == {i: before[i] for i in kept}
        else:
            wanted = {r[0]: r for r in test_suffix.brute([(i, t.encode()) for i, t in before.items()], corpus_pipeline.PASSAGE_BYTES)}
            assert set(after) == set(before)
            for i, text in after.items():
                # Spans are drawn in to whole characters: up to three bytes more stay at either end.
                assert 0 <= len(text.encode()) - (wanted[i][1] - wanted[i][2]) <= 6 * wanted[i][3]
