"""Registered model queries use every feature, every component, the whole grid, and score rows they did not see."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chronotape.operators import models as ml
from queries import evaluation as qe

GROUPS = ["act", "app", "attachments", "comm", "friction", "money", "profile", "tenure", "type_activity"]


class Coin:
    """A model that gives every row one half and remembers the rows it scored."""

    def __init__(self):
        self.scored = set()

    def transform(self, df):
        self.scored |= {r["client"] for r in df.select("client").collect()}
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))


@pytest.fixture
def rows(spark, monkeypatch):
    """Thirty clients with all the columns of the client features."""
    names = [c for c in qe.fx.client_features(qe.tape(spark, "/root/testdata/sf0.001"), qe.CUTOFF).columns if c != "client"]
    made = spark.range(30).select(
        F.concat(F.lit("c"), F.col("id")).alias("client"),
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(names)],
        F.lit("f").alias("gender"),
        F.lit("r").alias("region"),
    )
    monkeypatch.setattr(qe, "model_rows", lambda spark, sf: made)
    return names


def test_trees_use_all_features_and_score_unseen_rows(spark, rows, monkeypatch):
    fits = []

    def boosted(train, numeric, categorical, row, **cuts):
        fits.append((list(numeric), cuts, {r["client"] for r in train.select("client").collect()}, Coin()))
        return fits[-1][-1], 0.5, 1

    monkeypatch.setattr(ml, "boosted", boosted)
    for fn, sets in ((qe.e9, [98]), (qe.e10, [98, 98 + 64])):
        fits.clear()
        fn(spark, "/root/testdata/sf0.001")
        assert [len(numeric) for numeric, *_ in fits] == sets
        for numeric, cuts, trained, model in fits:
            assert numeric[:98] == rows and cuts == {}
            assert model.scored and not trained & model.scored


def test_ablation_and_probe_try_the_whole_grid(spark, rows, monkeypatch):
    tried = []
    real = ml.logistic.fit_all

    def fit_all(found, sets, strengths, folds):
        tried.append((sorted(sets), tuple(strengths), folds))
        return real(found, sets, strengths, folds)

    monkeypatch.setattr(ml.logistic, "fit_all", fit_all)
    found = qe.e15(spark, "/root/testdata/sf0.001").collect()
    assert tried == [(GROUPS, ml.STRENGTHS, ml.FOLDS)]
    assert sorted(r["features"] for r in found) == GROUPS
    assert all(r["strength"] in ml.STRENGTHS and 0 < r["log_loss"] < 5 for r in found)
    assert sorted({qe.group_of(c) for c in [*rows, *qe.CATEGORICAL]}) == GROUPS


def plain_fit(x, y, strength):
    """One fit by plain Newton steps on scaled columns; weights for the columns as they come."""
    spread = x.std(axis=0, ddof=1)
    used = spread > 0
    z = np.hstack([(x[:, used] - x[:, used].mean(axis=0)) / spread[used], np.ones((len(x), 1))])
    ridge = np.append(np.full(used.sum(), 1 / (strength * len(x))), 0)
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + np.diag(ridge), z.T @ (p - y) / len(x) + ridge * w)
    out = np.zeros(x.shape[1] + 1)
    out[:-1][used] = w[:-1] / spread[used]
    out[-1] = w[-1] - out[:-1] @ x.mean(axis=0)
    return out


def test_shared_fits_equal_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    n, folds = 240, 3
    x = np.hstack([rng.normal(size=(n, 4)), rng.integers(0, 2, (n, 2)), np.full((n, 1), 7.0), 1e6 + 1e3 * rng.normal(size=(n, 1))])
    y = (x[:, 0] - x[:, 4] + rng.normal(size=n) > 0).astype(int)
    fold = np.arange(n) % folds
    rows = spark.createDataFrame(
        [(i, [float(v) for v in x[i]], int(y[i]), int(fold[i])) for i in range(n)], "id long, features array<double>, y int, fold int"
    ).repartition(5)
    sets = {"all": range(8), "some": (1, 4, 7)}
    fits = ml.logistic.fit_all(rows, sets, ml.STRENGTHS, folds)
    assert len(fits) == 2 * len(ml.STRENGTHS) * (folds + 1)
    for f in fits:
        inside = fold != f.fold
        want = plain_fit(x[inside][:, list(f.columns)], y[inside], f.strength)
        assert np.allclose(f.weights, want, rtol=1e-6, atol=1e-6 * (1 + np.abs(want[-1])))
        if f.fold >= 0:
            margins = x[~inside][:, list(f.columns)] @ want[:-1] + want[-1]
            assert abs(f.loss - np.logaddexp(0, np.where(y[~inside] == 1, -margins, margins)).mean()) < 1e-6
    best = ml.logistic.best_strengths(fits)
    outside = ml.logistic.scores(rows, [f for f in fits if f.fold >= 0 and f.strength == best[f.name]], "id", out_of_fold=True)
    assert sorted((r["name"], r["id"]) for r in outside.collect()) == sorted((name, i) for name in sets for i in range(n))


def test_one_class_and_no_rows(spark):
    schema = "id long, features array<double>, y int, fold int"
    fits = ml.logistic.fit_all(spark.createDataFrame([(i, [float(i)], 1, i % 3) for i in range(9)], schema), {"a": [0]}, [1.0], 3)
    assert all(np.isfinite(f.weights).all() for f in fits)
    assert ml.logistic.fit_all(spark.createDataFrame([], schema), {"a": [0]}, [1.0], 3) == []


def test_columns_without_values_are_zero(spark):
    empty = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert [tuple(r) for r in ml.empty_as_zero(empty, ["a", "b"]).collect()] == [(0.0, 1.0), (0.0, None)]
