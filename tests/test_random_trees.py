"""Totally random trees: constant columns, smallest leaves, missing values, independence of the partitioning."""

import numpy as np
import pytest

from foldwright.operators.random_trees import grow
from foldwright.operators.trees import RandomTreesEmbedding


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, [1.0, float(rng.integers(0, 5)), float(rng.normal())]) for i in range(300)]
    return spark.createDataFrame(data, "row_id long, features array<double>").persist()


def test_same_trees_for_any_partitioning(rows):
    a, b = (grow(rows.repartition(n), "features", 3, 4, 4) for n in (2, 8))
    assert (a.column == b.column).all() and (a.threshold == b.threshold).all()


def test_constant_columns_are_passed_over(rows):
    trees = grow(rows, "features", 3, 6, 4)
    assert (trees.column[:, 1] >= 1).all() and (trees.column != 0).all()


def test_smallest_leaves_and_splits(rows):
    x = np.array([r.features for r in rows.collect()])
    for least in (1, 40):
        trees = grow(rows, "features", 3, 6, 4, min_split=50, min_leaf=least)
        for at in trees.nodes(x).T:
            assert np.unique(at, return_counts=True)[1].min() >= least
        # a node that is split has at least fifty rows
        for tree, at in enumerate(trees.nodes(x).T):
            for node in np.flatnonzero(trees.column[tree] >= 0):
                below = sum(1 for v in at if bin(v)[2:].startswith(bin(node)[2:]))
                assert below >= 50


def test_missing_values_and_empty_input(spark, rows):
    step = RandomTreesEmbedding(n_estimators=2, max_depth=2)
    more = rows.union(spark.createDataFrame([(900, None), (901, [None, None, None])], rows.schema))
    out = {r.row_id: r for r in step.fit(rows).transform(more).collect()}
    assert out[900].leaves is None and out[900].features is None
    assert len(out[901].leaves) == 2 and all(sum(r.features) == 2.0 for r in out.values() if r.features)
    with pytest.raises(ValueError):
        step.fit(rows.limit(0))
