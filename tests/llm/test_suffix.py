import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import suffix
from tests.llm.conftest import HARD


def brute(docs, width=50):
    """doc_id -> bytes, removed, spans, digest of the rest."""
    first = {}
    for id, data in docs:
        for p in range(len(data) - width + 1):
            first.setdefault(data[p : p + width], id)
            first[data[p : p + width]] = min(first[data[p : p + width]], id)
    out = []
    for id, data in docs:
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < id:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(found):
    last = suffix.LAST
    return sorted((last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


def as_bytes(pairs):
    return [(suffix.LAST if i is None else i, (t or "").encode()) for i, t in pairs]


@pytest.mark.parametrize("part_bytes", [1 << 20, 4000])
def test_against_brute_force(frame, monkeypatch, part_bytes):
    monkeypatch.setattr(suffix, "PART_BYTES", part_bytes)
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "ß", "aaaa"]
    passages = [" ".join(draw.choices(words, k=30)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, 25)))]
        parts += draw.choices(passages, k=draw.randint(0, 2))
        docs.append((i, " ".join(parts)[draw.randint(0, 9) :]))
    docs += [(200 + i, "b" * draw.randint(40, 140)) for i in range(12)] + [(300 + i, docs[5][1]) for i in range(20)]
    assert rows(suffix.repeats(frame(docs))) == brute(as_bytes(docs))


def test_hard_rows(frame):
    assert rows(suffix.repeats(frame(HARD))) == brute(as_bytes(HARD))


def test_stage_keeps_rows_columns_and_characters(frame):
    docs = frame(HARD)
    found = suffix.without_repeats(docs)
    assert found.columns == docs.columns
    texts = sorted((r.doc_id or -1, r.text) for r in found.collect())
    assert len(texts) == len(HARD)
    # Document 8 loses the shared run of characters as a whole, 6 loses nothing of its own repeats.
    assert dict(texts)[8] == " anders"[0:0] + dict(texts)[8] and "é" not in dict(texts)[8]
    assert dict(texts)[6] == dict(HARD)[6]


def test_nothing(frame):
    assert suffix.repeats(frame([])).count() == 0


def test_spans_on_whole_characters():
    data = "aéb".encode()
    assert suffix.on_borders(data, [2], [4]) == [(3, 4)]
    assert suffix.on_borders(data, [0], [2]) == [(0, 1)]
    assert suffix.on_borders(data, [2], [3]) == []


def footed(n):
    """Documents that differ but for one footer of 120 bytes, at which each has a stretch of its own."""
    draw = random.Random(8)
    footer = "".join(draw.choices("abcdefghij ", k=120))
    return [(i, "".join(draw.choices("abcdefghij ", k=150)) + footer + "".join(draw.choices("abcdefghij ", k=60))) for i in range(n)]


@pytest.mark.parametrize("width", [50, 100])
def test_a_common_footer_is_spread(frame, monkeypatch, width):
    monkeypatch.setattr(suffix, "PART_BYTES", 8000)
    monkeypatch.setattr(suffix, "SORT_BYTES", 4000)
    docs = footed(600)
    parts, limit = suffix.parts_of(frame(docs), width)
    dealt = suffix.blocks(frame(docs), F.lit(1), parts)
    hot = suffix.hot_of(dealt, parts, limit)
    assert len(hot)
    largest = {}
    for name, chosen in (("plain", suffix.NOT_HOT), ("spread", hot)):
        held = {}
        for _, text in docs:
            key, start, strings = suffix.anchors(text.encode(), width, chosen)
            for k, a, m in zip(key.tolist(), start.tolist(), strings.tolist()):
                held.setdefault(k, set()).add(text[a : a + m + width - 1])
        largest[name] = max(sum(map(len, v)) for v in held.values())
    assert largest["plain"] > 2 * 8000 > 2 * largest["spread"]
    assert rows(suffix.repeats(frame(docs), width)) == brute(as_bytes(docs), width)


def test_turns_agree_with_one_sort(monkeypatch):
    texts = [t.encode() for _, t in footed(40)]
    block = suffix.Block(np.arange(40), texts, list(range(40)))
    every = np.unique(np.concatenate([suffix.short(suffix.anchors(x)[0], 1) for x in texts]))
    found = suffix.stretches(block, every, 1, 50)
    lengths = np.array([len(x) for x in found.contents[0]], np.uint32)
    row = (b"".join(found.contents[0]), lengths, np.array(found.first[0]), np.frombuffer(bytes(found.lowest[0]), np.uint8))
    sorts = []
    earliest = suffix.earliest
    monkeypatch.setattr(suffix, "earliest", lambda *a, **k: sorts.append(sum(map(len, a[0]))) or earliest(*a, **k))
    whole = suffix.smallest_ids([row], 50)[0]
    monkeypatch.setattr(suffix, "SORT_BYTES", 3000)
    turned = suffix.smallest_ids([row], 50)[0]
    assert all((a == b).all() for a, b in zip(whole, turned))
    assert len(sorts) > 3 and max(sorts[1:]) < sorts[0] // 3


@pytest.mark.parametrize("piece", [1 << 16, 700])
@pytest.mark.parametrize("width", [50, 100])
def test_anchors_of_many_texts_are_those_of_each(monkeypatch, piece, width):
    monkeypatch.setattr(suffix, "PIECE", piece)
    texts = [t.encode() for _, t in footed(60)] + [b"", b"x" * (width - 1), b"y" * width, b"z" * 5000]
    hot = np.sort(suffix.hashes(texts[0][150:270])[:40])
    for chosen in (suffix.NOT_HOT, hot):
        document, key, start, strings = suffix.anchors_of(texts, width, chosen)
        for i, data in enumerate(texts):
            own = document == i
            for found, alone in zip((key[own], start[own], strings[own]), suffix.anchors(data, width, chosen)):
                assert found.tolist() == alone.tolist()
            # Every string of the text lies in one stretch.
            assert sorted(p for a, n in zip(start[own], strings[own]) for p in range(a, a + n)) == list(range(max(0, len(data) - width + 1)))
