import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import packing
from tests.llm.conftest import HARD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(PATH)


def whole(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aZéßÀ.,' \n\t<|>1٣́İſǅ日\x1c"), max_size=25))
def test_word_by_word_equals_the_library(text):
    made = test_word_by_word_equals_the_library.__dict__.setdefault("made", packing.WordEncoder(PATH))
    assert next(made.encode([text])) == whole(made, text)


def test_special_strings_and_generations(encoder, monkeypatch):
    assert encoder.short
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    texts = ["The the. <|endoftext|>x it's " * 3, "été, Été " + "q" * 300, "", " "] * 50
    assert list(encoder.encode(texts)) == [whole(encoder, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aé.,*&%$?!'’\"-_<|>1 \n"), max_size=25))
def test_words_with_marks_equal_the_library(text):
    made = test_words_with_marks_equal_the_library.__dict__.setdefault("made", packing.WordEncoder(PATH))
    assert list(made.encode([text, text])) == [whole(made, text)] * 2


def test_marks_behind_words_go_to_the_library_once(monkeypatch):
    made, asked = packing.WordEncoder(PATH), []
    direct = made._whole
    monkeypatch.setattr(made, "_whole", lambda words: asked.extend(words) or direct(words))
    texts = [f"{a}{b}{mark}" for a in ("tion", "Été", "ôe") for b in "abcdefgh" for mark in ("***", "&&&", "?!", ".")]
    texts.append("a" + "*" * 200)
    assert list(made.encode(texts)) == [whole(made, t) for t in texts]
    assert sorted({*asked} - {""}) == sorted(["***", "&&&", "?!", ".", texts[-1]])
    assert texts[-1] not in made.known


def test_tasks_of_a_worker_share_an_encoder():
    assert packing.encoder(PATH) is packing.encoder(PATH)


def test_lots(encoder, monkeypatch):
    monkeypatch.setattr(packing, "LOT_CHARS", 10)
    texts = ["The the", "", "été, " * 9, "x\n\ny", "", "a$. don't"] * 3
    assert list(encoder.encode(texts)) == [whole(encoder, t) for t in texts]
    assert list(encoder.encode([])) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_bins_are_full_at_most_and_bound_holds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit_decreasing(lengths, 20)
    for b in range(int(bins.max(initial=-1)) + 1):
        held = sorted((int(o), int(n)) for o, n in zip(offsets[bins == b], lengths[bins == b]))
        at = 0
        for o, n in held:
            assert o == at
            at += n
        assert at <= 20
    need = packing.bins_needed(lengths, 20)
    assert -(-int(lengths.sum()) // 20) <= need <= int(bins.max(initial=-1)) + 1


def fewest(lengths, capacity):
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for room in {f for f in free if f >= lengths[i]}:
            rest = list(free)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    draw = random.Random(4)
    for _ in range(150):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 8))]
        assert packing.bins_needed(np.array(lengths), 12) <= fewest(lengths, 12)


def test_exchange_saves_sequences(spark):
    lengths = [2500, 1596, 3000, 1096, 2048, 2048, 4000, 96] * 60
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    alone = packing.packed(packing.in_parts(pieces.withColumnRenamed("doc_id", "item"), 20), 4096, 0)
    before = alone.filter("offset = 0").count()
    found = packing.pack_pieces(pieces, part_pieces=20).collect()
    assert len(found) == len(lengths)
    check_places(found)
    after = len({r.sequence_id for r in found})
    assert sum(lengths) / 4096 <= after < before


def check_places(found):
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_hard_rows(frame, encoder):
    found = packing.pack_documents(frame(HARD), PATH).collect()
    check_places(found)
    wanted = []
    for i, t in HARD:
        ids = whole(encoder, t or "") + np.array([1], "<u4").tobytes()
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[a : a + 4 * 4096]
            wanted.append((i or -1, k, a // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)


def test_nothing(frame):
    assert packing.pack_documents(frame([]), PATH).count() == 0
