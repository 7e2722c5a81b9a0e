"""Gradient boosting of two classes is one problem with the decisions of two."""

import numpy as np
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from foldwright.operators.trees import GradientBoosting


class _BothWays(GradientBoosting):
    def spread(self, estimator, classes):
        return OneVsRest(classifier=estimator)


def test_two_classes_are_boosted_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 300) > 0, 7, 4)
    rows = [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int")
    one, both = (c(n_estimators=4, max_depth=2).fit(df) for c in (GradientBoosting, _BothWays))
    assert not hasattr(one.model, "models") and len(both.model.models) == 2
    for method in ("predict", "scores", "probabilities"):
        got, want = ([r["v"] for r in getattr(m, method)(df, "v").orderBy("row_id").collect()] for m in (one, both))
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert one.predict(df).filter(F.col("prediction") == F.col("label")).count() > 200


def test_three_classes_stay_one_against_the_rest(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 3) for i in range(30)], "row_id long, features array<double>, label int")
    model = GradientBoosting(n_estimators=2, max_depth=2).fit(df)
    assert len(model.model.models) == 3 and model.predict(df).filter("prediction <> label").count() == 0
