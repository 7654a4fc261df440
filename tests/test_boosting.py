"""Histogram boosting: a stump equals brute force, missing values beat imputation, models survive being stored."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from marlstone.operators.boosting import BoostedModel, HistogramBoosting


def frame(spark, x, y):
    rows = [(float(v), *(None if np.isnan(a) else float(a) for a in r)) for r, v in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "y double, " + ", ".join(f"x{k} double" for k in range(x.shape[1]))).repartition(3)


def stump(x, y, least, ridge):
    """Every cut between two values, missing rows on either side."""
    residual, best = y - y.mean(), (0.0,)
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        for at in np.unique(x[known, f]):
            for lost_left in (True, False):
                left = np.where(known, np.nan_to_num(x[:, f]) <= at, lost_left)
                a, b = left.sum(), (~left).sum()
                if min(a, b) >= least:
                    ga, gb = residual[left].sum(), residual[~left].sum()
                    gain = ga**2 / (a + ridge) + gb**2 / (b + ridge) - residual.sum() ** 2 / (len(y) + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, y.mean() + np.where(left, ga / (a + ridge), gb / (b + ridge)))
    return best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_tree_of_one_split_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = np.where(x[:, 1] > 6, 3.0, 1.0) + 0.2 * x[:, 2] + rng.normal(0, 0.3, 300)
    x[rng.random((300, 3)) < 0.3] = np.nan
    y += np.where(np.isnan(x[:, 0]), 4.0 * (seed == 2), 0)
    model = HistogramBoosting(trees=1, leaves=2, levels=1, rate=1.0, least=10).fit(frame(spark, x, y), ["x0", "x1", "x2"])
    assert len(model.trees) == 1 and len(model.trees[0].feature) == 3
    assert np.allclose(model.scores(model.binned(x)), stump(x, y, 10, 1.0))


def test_missing_values_beat_imputation(spark):
    """40 % of values are missing, and that they are says something."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3000, 4))
    y = 2 * x[:, 0] + np.sin(2 * x[:, 1]) + x[:, 2] * (x[:, 3] > 0)
    lost = rng.random(x.shape) < np.where(x > 0.3, 0.75, 0.2)
    x[lost] = np.nan
    assert 0.35 < np.isnan(x).mean() < 0.45
    names = [f"x{k}" for k in range(4)]
    train, test = frame(spark, x[:2000], y[:2000]), frame(spark, x[2000:], y[2000:])
    model = HistogramBoosting(trees=20).fit(train, names)
    mse = lambda df: df.agg(F.avg(F.pow(F.col("y_hat") - F.col("y"), 2))).first()[0]
    filled = [f"{n}_filled" for n in names]
    gbt = Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTRegressor(labelCol="y", predictionCol="y_hat", maxIter=20, maxDepth=4, seed=1)])
    assert mse(model.predict(test)) < mse(gbt.fit(train).transform(test))
    again = BoostedModel.from_json(model.to_json())
    assert [r.y_hat for r in again.predict(test).collect()] == [r.y_hat for r in model.predict(test).collect()]
    assert all(sum(f == -1 for f in t.feature) <= 15 for t in model.trees)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "y double, a double")
    assert HistogramBoosting().fit(empty, ["a"]).trees == []
    same = spark.createDataFrame([(1.0, None), (1.0, float("nan")), (None, 2.0)], "y double, a double")
    model = HistogramBoosting(least=1).fit(same, ["a"])
    assert model.trees == [] and [r.y_hat for r in model.predict(same).collect()] == [1.0] * 3
