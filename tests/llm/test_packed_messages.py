"""Packed arrays: round trips, and few wide values cost little."""

import numpy as np
import pytest
import zstandard

from foldwright.llm.pitman_yor import _filled, pack, unpack


@pytest.mark.parametrize("a", [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.arange(5), np.array([0, 70_000]), np.array([2**63 + 5, 1], np.uint64), np.array([0.5, -1.0])])
def test_round_trip(a):
    got = unpack(pack(a))
    assert got.tolist() == a.tolist()


def test_few_wide_values_cost_little():
    a = np.random.default_rng(1).integers(0, 4, 100_000)
    narrow = len(pack(a))
    a[:20] = 2**30
    assert len(pack(a)) < 1.1 * narrow < len(zstandard.ZstdCompressor(level=1).compress(a.astype(np.uint32).tobytes()))


def test_replies_name_only_pairs_seen_often():
    customers, tables = _filled(np.array([0, 1, 2, 1, 2]), np.array([5, 9]), np.array([3, 4]), 2)
    assert customers.tolist() == [0, 1, 5, 1, 9] and tables.tolist() == [0, 2, 3, 2, 4]
