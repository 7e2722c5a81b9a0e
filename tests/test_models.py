"""Neighbours, projections, encoders and special functions on small known inputs."""

import numpy as np
import pandas as pd
import pytest

from foldwright.functions.special import chi2_tail, f_tail
from foldwright.operators.agglomerate import merge_columns
from foldwright.operators.discriminant import LDA
from foldwright.operators.encode import fit_one_hot
from foldwright.operators.metrics import bac_multiclass
from foldwright.operators.neighbors import nearest
from foldwright.operators.project import PCA, FastICA, Nystroem, PolynomialFeatures, kernel_matrix
from foldwright.operators.tabular import MinMaxScaler, StandardScaler


def frame(spark, x, label=None):
    pdf = pd.DataFrame({"row_id": np.arange(len(x)), "features": list(map(list, x)), "label": np.zeros(len(x), int) if label is None else label})
    return spark.createDataFrame(pdf, "row_id bigint, features array<double>, label int")


def values(df):
    return np.array([r["features"] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_with_copies(spark, p):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:150] = x[0]  # a third of the rows are copies
    q = np.vstack([rng.normal(size=(40, 3)), x[:2]])
    got = nearest(frame(spark, x), frame(spark, q), 6, p, pivots=9, block_rows=25).orderBy("qid", "rank").collect()
    for i in range(len(q)):
        d = np.abs(x - q[i]).sum(1) if p == 1 else np.sqrt(((x - q[i]) ** 2).sum(1))
        want = np.lexsort((np.arange(len(x)), d))[:6]
        assert [r["tid"] for r in got if r["qid"] == i] == want.tolist()


def test_nearest_with_fewer_rows_than_k(spark):
    x = np.arange(6.0).reshape(3, 2)
    assert nearest(frame(spark, x), frame(spark, x), 5).count() == 9


def test_constant_columns_scale_to_zero(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0]])
    assert values(MinMaxScaler().fit(frame(spark, x)).transform(frame(spark, x))).tolist() == [[0.0, 0.0], [1.0, 0.0]]
    assert values(StandardScaler().fit(frame(spark, x)).transform(frame(spark, x))).tolist() == [[-1.0, 0.0], [1.0, 0.0]]


def test_pca_keeps_the_needed_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) @ np.array([[3.0, 1, 0, 2], [0, 1, -2, 1]]) + 7
    model = PCA(0.9999).fit(frame(spark, x))
    assert model.info["components"] == 2
    z = values(model.transform(frame(spark, x)))
    np.testing.assert_allclose(z.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(np.cov(z.T)[0, 1], 0, atol=1e-9)


@pytest.mark.parametrize("algorithm", ["parallel", "deflation"])
def test_ica_separates_sources(spark, algorithm):
    rng = np.random.default_rng(2)
    s = np.stack([rng.uniform(-1, 1, 3000), rng.laplace(size=3000)], axis=1)
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    z = values(FastICA(2, algorithm).fit(frame(spark, x)).transform(frame(spark, x)))
    c = np.abs(np.corrcoef(z.T, s.T)[:2, 2:])
    assert c.max(1).min() > 0.98


def test_polynomial_order(spark):
    x = np.array([[2.0, 3.0]])
    assert values(PolynomialFeatures(2).fit(frame(spark, x)).transform(frame(spark, x))).tolist() == [[1, 2, 3, 4, 6, 9]]
    assert values(PolynomialFeatures(2, True, False).fit(frame(spark, x)).transform(frame(spark, x))).tolist() == [[2, 3, 6]]


def test_nystroem_is_exact_on_all_landmarks(spark):
    x = np.random.default_rng(4).normal(size=(30, 3))
    z = values(Nystroem("rbf", 30, 0.4).fit(frame(spark, x)).transform(frame(spark, x)))
    np.testing.assert_allclose(z @ z.T, kernel_matrix(x, x, "rbf", 0.4, 3, 0.0), atol=1e-6)


def test_merge_columns_finds_the_groups():
    points = np.array([0.0, 0.1, 5.0, 5.2, 9.0])
    d = np.abs(points[:, None] - points[None, :])
    for linkage in ("ward", "complete", "average"):
        labels = merge_columns(d.copy(), 3, linkage)
        assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3


@pytest.mark.parametrize("shrinkage", [None, "manual", "auto"])
def test_lda_separates(spark, shrinkage):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + 4 * np.eye(4)[y]
    df = frame(spark, x, y)
    out = LDA(shrinkage, 0.3).fit(df).predict(df)
    assert out.filter("label = prediction").count() > 280


def test_one_hot_unseen_values(spark):
    fit = spark.createDataFrame([(0.0,)] * 50 + [(1.0,)] * 49 + [(7.0,)], "c double")
    new = spark.createDataFrame([(0.0,), (7.0,), (3.0,), (99.0,), (float("nan"),)], "c double")
    some = fit_one_hot(fit, ["c"], 0.1)
    assert some.width == 3  # other, 0 and 1
    assert [r["active"] for r in some.transform(new).collect()] == [[1], [0], [0], [0], [0]]
    every = fit_one_hot(fit, ["c"], None)
    got = {str(r["c"]): r["active"] for r in every.transform(new).collect()}
    assert got == {"0.0": [0], "7.0": [2], "3.0": [], "99.0": [], "nan": []}
    with pytest.raises(Exception, match="non-negative"):
        fit_one_hot(spark.createDataFrame([(-1.0,)], "c double"), ["c"], 0.1)


def test_bac_rejects_labels_outside_the_classes(spark):
    df = spark.createDataFrame([(5, 0)], "y int, p int")
    with pytest.raises(Exception, match="class outside"):
        bac_multiclass(df, "y", "p", 3, []).collect()


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(16.918977604620448, 9) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert f_tail(4.0, 2, 1e5) == pytest.approx(chi2_tail(8.0, 2), rel=1e-3)
    assert f_tail(1.0, 10, 10) == pytest.approx(0.5, rel=1e-9)
    assert f_tail(161.4476387975881, 1, 1) == pytest.approx(0.05, rel=1e-6)
