import random

from hypothesis import given, settings
from hypothesis import strategies as st

from twinscope.llm.suffix_array import suffix_array


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small_alphabets(text):
    assert suffix_array(text) == naive(text)


def test_shapes():
    rng = random.Random(5)
    for text in ([], [7], [1] * 200, [1, 2] * 90, [2, 1] * 90, list(range(100)), list(range(100, 0, -1)), [rng.randrange(1000) for _ in range(2000)], ([rng.randrange(5) for _ in range(40)] + [0]) * 12):
        assert suffix_array(text) == naive(text)
