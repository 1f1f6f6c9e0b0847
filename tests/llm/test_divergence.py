"""Shares, skybands and ranks against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import divergence
from tests.llm.conftest import HARD

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    groups, found = {}, {}
    for text, lang, source in rows:
        low = (text or "").translate(str.maketrans(CAPITALS, CAPITALS.lower()))
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        found.setdefault(lang or "", Counter()).update(words.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least]
        whole = sum((Counter(c) for c in sources.values()), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return out


def compare(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, part int, term string")
    found = divergence.divergence(docs.repartition(7), **settings)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, **settings))


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(20, 60) for b in "eéß日"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "S1", "é", None, "hot", "hot", "hot"])
        some = rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=rng.randrange(60))
        rows.append((rng.choice([" ", "-", "1", "\n", "_@["]).join(some).title() if i % 9 else None, lang, source))
    return rows + [("Only one here", "xx", "alone"), (None, "xx", None), ("", "yy", "z"), ("\0", "yy", "")]


@pytest.mark.parametrize("least,top", [(30, 50), (1, 3), (3, 1000)])
def test_against_plain_python(spark, least, top):
    compare(spark, corpus(least), least=least, top=top)


def test_small_parts_and_blocks(spark, monkeypatch):
    """Every split in use: partitions of terms, merges, blocks of sources, parts of counts, pieces of texts."""
    for name, value in {"TERMS": 5, "MERGED": 2, "SOURCES": 2, "PART": 20, "CELLS": 7, "PIECE": 9, "HELD": 11}.items():
        monkeypatch.setattr(divergence, name, value)
    compare(spark, corpus(9), least=2, top=4)


def test_hard_rows_and_no_rows(spark, frame):
    found = divergence.divergence(frame(HARD), least=1, top=50).collect()
    assert sorted(map(tuple, found)) == sorted(brute([(t, "en", "s") for _, t in HARD], least=1))
    assert divergence.divergence(frame([])).collect() == []


def test_share_is_exact_beyond_64_bits(spark):
    rows = [(5, 5), (7, 30), (8 * 10**15, 8999999999999999), (123456789012345, 8888888888888887)]
    found = spark.createDataFrame(rows, "a long, b long").select(divergence.share(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [1 + 10**9 * a // b for a, b in rows]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_skyband(k):
    rng = np.random.default_rng(k)
    high, low = rng.integers(1, 40, 900), rng.integers(1, 40, 900)
    wanted = [i for i in range(900) if ((high[:i] >= high[i]) & (low[:i] <= low[i])).sum() < k]
    assert divergence.skyband(high, low, k, chunk=64).tolist() == wanted
    assert divergence.skyband(high[:0], low[:0], k).tolist() == []


def test_terms_of_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    found = [t for terms in divergence.terms_of("AbÇé1x long-word_Z".encode()) for t in terms]
    assert [t.decode() for t in found] == ["abÇé", "x", "long", "word", "z"]
