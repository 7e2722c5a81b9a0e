"""Vectors that meet in the tables, against all pairs of codes."""

from collections import Counter

import numpy as np
import pytest

from foldwright.llm import embedding_dedup


def codes_near(n_codes: int, n: int = 300) -> np.ndarray:
    rng = np.random.default_rng(n_codes)
    codes = rng.integers(0, 2**63, (30, n_codes)).astype(np.uint64)[rng.integers(0, 30, n)]
    for _ in range(9):
        codes ^= np.uint64(1) << rng.integers(0, 64, codes.shape).astype(np.uint64)
    return codes


def wanted(ids: list, labels: list, codes: np.ndarray, most_apart: int) -> Counter:
    found = Counter()
    for i in range(len(codes)):
        for j in range(i):
            apart = codes[i] ^ codes[j]
            if labels[i] == labels[j] and ids[i] != ids[j] and np.bitwise_count(apart).sum() <= most_apart and embedding_dedup.shown(apart.view(np.int64)).any():
                found[(min(ids[i], ids[j]), max(ids[i], ids[j]))] += 1
    return found


@pytest.mark.parametrize("n_codes, rows", [(1, 1 << 16), (1, 50), (3, 700)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_the_tables(spark, monkeypatch, n_codes, rows, kind):
    monkeypatch.setattr(embedding_dedup, "ROWS", rows)
    codes = codes_near(n_codes)
    ids = [i // 2 if i < 20 else i for i in range(len(codes))]
    ids = [f"{i:03d}" for i in ids] if kind == "string" else ids
    labels = [f"label {i % 2}" for i in range(len(codes))]
    given = spark.createDataFrame([(i, x, c) for i, x, c in zip(ids, labels, codes.view(np.int64).tolist())], f"id {kind}, label string, codes array<long>")
    got = Counter(tuple(r) for r in embedding_dedup.candidates(given.repartition(5), n_codes, 20 * n_codes).collect())
    assert got == wanted(ids, labels, codes, 20 * n_codes) and len(got) > 200


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_matches_in_steps(monkeypatch, pairs):
    monkeypatch.setattr(embedding_dedup, "PAIRS", pairs)
    codes = codes_near(1)
    rows = sorted((p, int(c[0] >> np.uint64(8 * p) & np.uint64(255)), i) for i, c in enumerate(codes) for p in range(8))
    group = np.cumsum([0, *(x[:2] != y[:2] for x, y in zip(rows, rows[1:]))])
    place, own = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    got = Counter()
    for a, b in embedding_dedup._matches(group, place, codes[own], 20):
        got.update((min(x), max(x)) for x in zip(own[a].tolist(), own[b].tolist()))
    assert got == wanted(list(range(len(codes))), [0] * len(codes), codes, 20)


def test_a_vector_meets_others_eight_times(spark):
    codes = spark.createDataFrame([(i, 1, [i]) for i in range(50)], "id long, label int, codes array<long>")
    plan = embedding_dedup.candidates(codes, 1, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan


def pairs_of(spark, ids, rows):
    placed = embedding_dedup.in_blocks(spark.createDataFrame(rows, "a long, b long").repartition(3), 200)
    return placed, spark.createDataFrame(ids, "id long, embedding array<float>")


@pytest.mark.parametrize("batch", [10_000, 37])
def test_links_are_exact(spark, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((6, 8))[rng.integers(0, 6, 120)] + 0.15 * rng.standard_normal((120, 8))).astype(np.float32)
    ids = [i // 2 if i < 10 else i for i in range(120)]  # some ids have two vectors
    rows = [(i, j) for i in range(120) for j in range(i + 1, 120)]
    placed, vectors = pairs_of(spark, list(zip(ids, x.tolist())), rows)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    at = {}
    for k, i in enumerate(ids):
        at.setdefault(i, []).append(k)
    want = Counter((i, j) for i, j in rows for k in at.get(i, []) for m in at.get(j, []) if near[k, m])
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, batch)
        got = Counter(tuple(r) for r in embedding_dedup.links(placed, vectors, 0.98).collect())
    finally:
        spark.conf.set(key, before)
    assert got == want and len(want) > 100


def test_a_vector_is_not_sent_once_a_pair(spark):
    n = 100
    dense = [(i, j) for i in range(n) for j in range(i + 1, n)]
    placed, _ = pairs_of(spark, [(0, [1.0])], dense + [(1000, k) for k in range(1001, 1500)])
    blocks = {}
    for a, b, block in placed.collect():
        blocks.setdefault(block, set()).update((a, b))
    own = [s for s in blocks.values() if min(s) < 1000]
    assert sorted((a, b) for a, b, _ in placed.collect()) == sorted(dense + [(1000, k) for k in range(1001, 1500)])
    assert sum(map(len, own)) < len(dense) // 3 and 1 < len(own) <= 36
