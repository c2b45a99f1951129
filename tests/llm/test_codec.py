"""Simple-8b round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossover.llm.simple8b import COUNTS, decode, encode


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=1200), st.sampled_from([7, 64, 256]), st.sampled_from([5, 15, 20]))
def test_round_trip(ids, block, escape_bits):
    x = np.array(ids, dtype=np.uint32)
    assert np.array_equal(decode(encode(x, block, escape_bits)), x)


def test_all_widths_and_escapes():
    for width in {60 // n for n in COUNTS}:
        top = min((1 << width) - 1, 2**32 - 1)
        x = np.array([top, top - 1, 0, 1] * 90, dtype=np.uint32)
        assert np.array_equal(decode(encode(x)), x)


def test_small_ids_take_little_room():
    assert len(encode(np.zeros(100_000, dtype=np.uint32))) < 30_000


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        decode(b"nope" + bytes(20))
