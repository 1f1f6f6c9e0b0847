"""Suffix order against sorting the suffixes themselves, in memory and through files."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm.induce import suffix_order


def brute(symbols):
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(symbols) and symbols[a + k] == symbols[b + k]:
            k += 1
        shared.append(k)
    return order, shared


words = st.integers(1, 4).flatmap(lambda top: st.lists(st.integers(1, top), max_size=60))


@pytest.mark.parametrize(("in_memory", "queue_bytes"), [(1 << 20, 1 << 30), (1, 64)])
@settings(max_examples=150, deadline=None)
@given(word=words, times=st.integers(1, 4))
def test_order_and_common_prefixes(in_memory, queue_bytes, word, times):
    symbols = [*word * times, 0]
    order, shared = suffix_order(np.array(symbols, np.uint16), in_memory, queue_bytes)
    assert (order.tolist(), shared.tolist()) == brute(symbols)


def test_long_runs():
    symbols = [1] * 700 + [2] + [1] * 700 + [0]
    order, shared = suffix_order(np.array(symbols, np.uint16), 1, 64)
    assert (order.tolist(), shared.tolist()) == brute(symbols)
