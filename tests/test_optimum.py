"""Certified coefficients against the loss itself, and tables stored by query."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from judgelens.constants import FEATURES, LABELS, REG_PARAM
from judgelens.operators import classification as C
from judgelens.operators import modelling as M
from judgelens.operators.optimum import certify, optimum_table
from judgelens.operators.splits import split_disjointness
from judgelens.sources import tables
from judgelens.sources.bucketed import read_bucketed, write_bucketed
from judgelens.sources.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def train(spark):
    return stage(fx.features(spark, SF).filter("dataset_split = 'train'"), "optimum-train")


@pytest.fixture(scope="module")
def fitted(train):
    return M.fit_relevance_model(train, True)


def loss_of(train, fitted, weights):
    """The penalised loss as a plain function of (labels x features) coefficients and intercepts."""
    rows = train.select("label", *FEATURES).toPandas()
    y = np.array([LABELS.index(x) for x in rows["label"]])
    w = np.array([weights[x] for x in rows["label"]])
    sd = fitted.stages[-2].std.toArray()
    x = np.where(sd > 0, (rows[list(FEATURES)].to_numpy() - fitted.stages[-2].mean.toArray()) / np.where(sd > 0, sd, 1), 0)
    mean = w @ x / w.sum()
    variance = (w @ (x - mean) ** 2) / (w.sum() - (w @ w) / w.sum())

    def loss(b, c):
        z = x @ b.T + c
        z = z - z.max(axis=1, keepdims=True)
        each = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]
        return w @ each / w.sum() + REG_PARAM / 2 * (b * b * variance).sum()

    return loss, variance


def test_certified_point_is_a_minimum_of_the_plain_loss(train, fitted):
    weights = M.training_weights(train)
    found = certify(fitted, train, weights)
    assert found.error_bounds.max() < 1e-9 and found.intercept_slope < 1e-9
    assert np.abs(found.fit_errors).max() < 1e-4
    loss, _ = loss_of(train, fitted, weights)
    b, c = found.coefficients, found.intercepts
    rng = np.random.default_rng(1)
    for _ in range(40):
        db, dc = rng.normal(size=b.shape), rng.normal(size=c.shape)
        h = 1e-4
        assert abs(loss(b + h * db, c + h * dc) - loss(b - h * db, c - h * dc)) / (2 * h) < 1e-6
        assert loss(b + 0.01 * db, c + 0.01 * dc) > loss(b, c)


@pytest.mark.parametrize("size", [1e-4, 1e-3, 1e-2])
def test_bound_holds_away_from_the_minimum(train, fitted, size):
    weights = M.training_weights(train)
    best = certify(fitted, train, weights)
    _, variance = loss_of(train, fitted, weights)
    rng = np.random.default_rng(2)
    off = lambda a: SimpleNamespace(toArray=lambda: a + size * rng.normal(size=a.shape))
    start = SimpleNamespace(stages=[fitted.stages[-2], SimpleNamespace(coefficientMatrix=off(best.coefficients), interceptVector=off(best.intercepts))])
    here = certify(start, train, weights, turns=0)
    assert here.turns == 0
    away = np.abs(here.coefficients - best.coefficients)[:, variance > 0]
    assert (away <= here.error_bounds[variance > 0] * 1.02).all() and here.error_bounds.max() < 2000 * size
    again = certify(start, train, weights)
    # A feature that never varies has no best coefficient.
    moving = variance > 0
    assert again.turns >= 1 and np.allclose(again.coefficients[:, moving], best.coefficients[:, moving], atol=1e-8)


def test_optimum_table_has_a_row_per_coefficient(spark, train, fitted):
    table = optimum_table(spark, certify(fitted, train, None, turns=1))
    assert table.count() == len(LABELS) * len(FEATURES) and table.where("error_bound IS NULL").isEmpty()


# Tables stored by query


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_grouping_by_query_needs_no_shuffle_on_saved_tables(spark, tmp_path):
    scored = fx.scored(spark, SF)
    tables.write_scored_by_query(scored, str(tmp_path / "scored"), 8)
    tables.write_features_by_query(fx.features(spark, SF), str(tmp_path / "features"), 8)
    for again in (False, True):
        if again:  # as another session would, which knows the path only
            for row in spark.catalog.listTables():
                if row.name.startswith("judgelens_"):
                    spark.sql(f"DROP TABLE {row.name}")
        saved, features = read_bucketed(spark, str(tmp_path / "scored")), read_bucketed(spark, str(tmp_path / "features"))
        cells = C.query_contingency(saved)
        assert shuffles(cells) == 0
        assert cells.exceptAll(C.query_contingency(scored)).isEmpty() and saved.count() == scored.count()
        assert shuffles(features.groupBy("query_id").agg(F.countDistinct("dataset_split"))) == 0
        assert shuffles(split_disjointness(features)) < shuffles(split_disjointness(fx.features(spark, SF)))
        assert features.select("dataset_split").distinct().count() == 3
    pruned = features.filter("dataset_split = 'test'")
    assert "PartitionFilters: [isnotnull(dataset_split" in pruned._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_refuse_odd_requests(spark, tmp_path):
    rows = spark.range(10).withColumn("k", F.col("id") % 3)
    with pytest.raises(ValueError):
        write_bucketed(rows, str(tmp_path / "a"), "k", 0)
    write_bucketed(rows.limit(0), str(tmp_path / "b"), "k", 4)
    assert read_bucketed(spark, str(tmp_path / "b")).count() == 0


def test_solver_gets_each_vector_once_with_the_same_loss(spark, monkeypatch):
    """Many equal rows reach the solver as one weighted vector; the minimum stays that of the rows."""
    rng = np.random.default_rng(3)
    kinds = [(label, *(float(v) for v in rng.integers(0, 3, len(FEATURES)))) for label in LABELS for _ in range(8)]
    rows = [kinds[i] for i in range(len(kinds)) for _ in range(1 + 13 * (i % 5))]
    many = stage(spark.createDataFrame(rows, "label string, " + ", ".join(f"{name} double" for name in FEATURES)), "alike")
    sizes = []
    real = M.classifier

    class Counted:
        def __init__(self, *args):
            self.solver = real(*args)

        def fit(self, frame):
            sizes.append(frame.count())
            return self.solver.fit(frame)

    monkeypatch.setattr(M, "classifier", Counted)
    weights = M.training_weights(many)
    for name, model in M.fit_candidates(many).items():
        found = certify(model, many, weights if name == "logistic_class_weighted" else None)
        assert np.abs(found.fit_errors).max() < 1e-3 and found.error_bounds.max() < 1e-9
    assert sizes == [len(kinds)] * 2 and len(rows) > 10 * len(kinds)
