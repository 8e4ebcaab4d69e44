import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselon.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 6), st.sampled_from([3, 8, 17, 20, 24, 50]), st.integers(0, 99))
def test_order_and_groups(block, times, depth, seed):
    rng = np.random.default_rng(seed)
    raw = bytearray(block * times * 3 + b"abab" * 20)
    for i in rng.integers(0, len(raw), 3):  # long common prefixes with a few breaks
        raw[i] = rng.integers(0, 256)
    data = np.frombuffer(bytes(raw), np.uint8)
    pos = rng.permutation(np.arange(max(0, len(raw) - depth + 1)))
    order, new = suffixes.deep_shallow_sort(data, pos, depth)
    assert sorted(order) == list(range(len(pos)))
    got = [bytes(raw[p : p + depth]) for p in pos[order]]
    assert got == sorted(got)
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_nothing_to_sort():
    order, new = suffixes.deep_shallow_sort(np.zeros(0, np.uint8), np.zeros(0, np.int64), 50)
    assert len(order) == len(new) == 0
