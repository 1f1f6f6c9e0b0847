"""Byte-level BPE against the original library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siftwell.llm import bytebpe
from tests.conftest import DATA
from tests.llm.conftest import HARD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
rng = random.Random(3)
POINTS = [*range(1, 0xD800), *range(0xE000, 0x110000)]


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.ByteEncoder(PATH)


@pytest.fixture(scope="module")
def original():
    ranks = bytebpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n a", "it's IT'S 'llx we'd'", "a\x1c\x85᠎​ b", " \t\n " * 500, "x" * 3000, "ab" * 2000, "é" * 900,
    "՘a\U0003d000b 1࢏ ", "<|endoftext|> <s>", "日本語 العربية ΑΒΓ абв 1२३",
    "".join(rng.choice("abcde") for _ in range(3000)),
    " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(1, 540))) for _ in range(120)),
    "".join(chr(rng.choice(POINTS)) for _ in range(4000)),
    "".join(chr(rng.randrange(0x20, 0x600)) for _ in range(4000)),
    "".join(chr(rng.randrange(1, 0x3000)) for _ in range(4000)),
]


def test_same_ids_as_the_original(encoder, original):
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == original.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_every_code_point(encoder, original):
    text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in POINTS[:: 1 if len(POINTS) < 9 else 7])
    text += "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(1, 0x600))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == original.encode_ordinary(text)


def test_long_words_in_rounds_and_in_queues_agree(encoder, monkeypatch):
    words = ["".join(rng.choice("etaoinsh") for _ in range(n)).encode() for n in (513, 700, 1500)]
    queued = encoder.encode_words(words)
    monkeypatch.setattr(bytebpe, "LONG", 1 << 20)
    assert [x.tolist() for x in encoder.encode_words(words)] == [x.tolist() for x in queued]


def test_texts_in_small_pieces(encoder, monkeypatch):
    whole = encoder.encode(TEXTS)
    monkeypatch.setattr(bytebpe, "CHARS", 50)
    monkeypatch.setattr(bytebpe, "MATCHES", 7)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    assert encoder.encode(TEXTS) == whole
    assert [x for t in TEXTS for x in encoder.encode([t])] == whole


def test_documents(spark, frame, original):
    rows = HARD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    encoded = bytebpe.encode_documents(frame(rows), PATH)
    found = bytebpe.decode_documents(encoded, PATH).collect()
    wanted = []
    for i, text in rows:
        ids = original.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        wanted.append((i, len(ids), text or "", digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert bytebpe.decode_documents(bytebpe.encode_documents(frame([]), PATH), PATH).collect() == []


def test_whole_table(spark, original):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    encoded = bytebpe.encode_documents(docs, PATH).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    for row in encoded:
        assert np.frombuffer(row.ids, "<u4").tolist() == original.encode_ordinary(texts[row.doc_id] or "")
