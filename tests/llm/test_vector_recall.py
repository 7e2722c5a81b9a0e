"""Planted vector pairs just above the least cosine, with and without a common direction."""

import numpy as np
import pytest

from foldwright.llm import embedding_dedup


def planted(offset: float, n: int = 2000, width: int = 64) -> np.ndarray:
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, width)) / np.sqrt(width)
    x[:, 0] += offset
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.98, 0.985, (n, 1))
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside])


def linked(spark, vectors: np.ndarray) -> dict[int, int]:
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, label int")
    return {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(rows).collect()}


def true_links(vectors: np.ndarray) -> np.ndarray:
    return (vectors @ vectors.T >= 0.98).sum(axis=1) - 1


@pytest.mark.parametrize("offset", [0.0, 2.0])
def test_recall_of_planted_pairs(spark, offset):
    vectors = planted(offset)
    got, want = linked(spark, vectors), true_links(vectors)
    assert all(n <= want[i] for i, n in got.items())
    assert sum(got.values()) >= 0.99 * want.sum()


def test_all_pairs_where_tables_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_CODES", 0)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    vectors = planted(2.0, 300)
    assert linked(spark, vectors) == dict(enumerate(true_links(vectors).tolist()))
