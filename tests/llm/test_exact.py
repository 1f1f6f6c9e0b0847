import hashlib

import pytest

from siftwell.llm import exact
from tests.llm.conftest import HARD


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in docs:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i or -1, max(ids, default=-1), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
def test_hard_rows(frame, monkeypatch, weak):
    """Also with digests that often agree by chance: contents then decide."""
    docs = [*HARD, *[(20 + i, f"text {i % 7} " * 900) for i in range(40)]]
    if weak:
        real = exact.digest
        monkeypatch.setattr(exact, "digest", real)
        weak_rows(monkeypatch)
    found = exact.exact_groups(frame(docs)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in found) == brute(docs)
    assert sum(r.kept for r in found) == len({t or "" for _, t in docs})


def weak_rows(monkeypatch):
    """One-byte digests, sent to the workers inside the functions that use them."""
    import types

    def weak(chunk):
        return hashlib.blake2b(chunk, digest_size=1).digest()

    for name in ("recipe_rows", "chunk_rows"):
        real = getattr(exact, name)
        copy = types.FunctionType(real.__code__, dict(real.__globals__, digest=weak, __name__="__main__"), name)
        monkeypatch.setattr(exact, name, copy)


def test_stage_keeps_one_of_each(frame):
    docs = frame(HARD)
    found = exact.kept_documents(docs)
    assert found.columns == docs.columns
    assert sorted((r.text or "") for r in found.collect()) == sorted({t or "" for _, t in HARD})


def test_nothing(frame):
    assert exact.exact_groups(frame([])).count() == 0


def test_cuts_follow_the_content():
    import random

    data = random.Random(1).randbytes(200_000)
    assert b"".join(exact.chunks(data)) == data
    own, moved = set(exact.chunks(data)), list(exact.chunks(b"in front" + data))
    assert len([c for c in moved if c not in own]) <= 2
    assert max(map(len, exact.chunks(b"a" * 1_000_000))) <= exact.MOST
