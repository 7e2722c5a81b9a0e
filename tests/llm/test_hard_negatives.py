"""Hard negatives against brute force: skewed labels, ties, repeated rows, odd vectors, several chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foldwright.llm import hard_negatives
from foldwright.llm.hard_negatives import mine_negatives, shifted_label

SCHEMA = "vec_id long, embedding array<double>, label int, v string, anchor int, row_key int, best double"


def brute(rows):
    rows = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in (r for r in rows if r[0] % 50 == 0):
        order = sorted(((-dot(a, b), b[0], b[1]) for b in rows if b != a), key=lambda t: t[:2])
        for s, i, _ in [t for t in order if t[2] == a[1]][:5]:
            window = [t for t in order if t[2] != a[1] and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a[0], i, k + 1, n[1], -s, -n[0]) for k, n in enumerate(window)]
    return sorted(out)


def mine(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine_negatives(table.repartition(5), F.col("vec_id") % 50 == 0, shifted_label()).collect())


def crowd(seed, n, width, values):
    r = random.Random(seed)
    label = lambda: 3 if r.random() < 0.4 else r.randrange(10)
    return [(i, [values(r) for _ in range(width)], label()) for i in range(n)]


@pytest.mark.parametrize("values", [lambda r: r.gauss(0.3, 0.5), lambda r: r.choice([0.0, 0.5, 1.0])])
def test_against_brute_force(spark, values):
    rows = crowd(3, 420, 6, values)
    want = brute(rows)
    assert len(want) > 50 and mine(spark, rows) == want


def test_chunks_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK_COMPONENTS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_SCORES", 64)
    rows = crowd(4, 300, 5, lambda r: r.gauss(0.4, 0.4))
    assert mine(spark, rows) == brute(rows)


def test_edges(spark):
    rows = crowd(5, 260, 4, lambda r: r.choice([0.25, 0.5, 1.0]))
    odd = [(1000, None, 1), (1050, [1.0, None, 0.0, 0.0], 1), (1100, [float("nan")] * 4, 1), (1150, [float("inf"), 0.0, 0.0, 0.0], 1), (1200, [1.0] * 4, None), (None, [1.0] * 4, 1), (1250, [], 2), (1300, [0.0] * 4, 2), (1351, [0.5, 0.5], 2)]
    same = [rows[50], rows[51], (50, [0.9, 0.9, 0.1, 0.2], 4)]
    assert mine(spark, [*rows, *odd, *same]) == brute([*rows, *odd, *same])
    assert mine(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [(2.0**k) * (1 + i % 3) for k in (18, 20, 19 + i % 2)], i % 2) for i in range(101)]
    assert mine(spark, rows) == brute(rows) != []
    assert mine(spark, [(i, [1e308 * (i % 3), -1e300], i % 2) for i in range(60)]) is not None
