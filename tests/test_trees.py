"""Trees over sparse rows against Spark ML's over every column."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cairn.operators import models as M
from cairn.operators import trees as T

NAMES = "abcdefghijkl"


@pytest.fixture(scope="module")
def design(spark):
    """One drug, twelve features of different shares and weights, some isolates equal."""
    rng = random.Random(11)
    isolates = [(f"u{i}", f"l{i % 3}", {m for k, m in enumerate(NAMES) if rng.random() < 0.1 + 0.04 * k}) for i in range(900)]
    lead = lambda on: sum((0.9 - 0.13 * k) * (m in on) for k, m in enumerate(NAMES)) - 0.4 + ("a" in on and "l" in on)
    cohort = spark.createDataFrame([("D", u, x, "R" if lead(on) + rng.gauss(0, 0.7) > 0 else "S") for u, x, on in isolates], "drug string, uid string, lineage string, phenotype string")
    carried = spark.createDataFrame([(u, "g", m) for u, _, on in isolates for m in on], "uid string, gene string, mutation string")
    return M.design(cohort, carried, spark.createDataFrame([("D", "g", m) for m in NAMES], "drug string, gene string, mutation string"))


def test_boosted_trees_are_spark_mls(spark, design):
    rows, index = design
    got = {r.uid: (r.fold, r.score) for r in M.out_of_fold(rows, {"boosted": T.Boosted(index.count(), 4, 3)}).collect()}
    assert len(got) == rows.count() == 900
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=7, weightCol="weight").fit(rows.filter("lineage <> 'l1'"))
    for r in model.transform(rows.filter("lineage = 'l1'")).select("uid", vector_to_array("probability")[1].alias("score")).collect():
        assert got[r.uid][0] == "l1" and abs(got[r.uid][1] - r.score) < 1e-9


def test_boosted_values_are_spark_mls(spark, design):
    rows, _ = design
    graded = rows.select("drug", "uid", (F.size("columns") + F.pmod(F.xxhash64("uid"), F.lit(1000)) / 500.0).alias("value"))
    got = {r.uid: r.prediction for r in M.graded_regression(rows, graded).collect()}
    data = rows.drop("label").join(graded.withColumnRenamed("value", "label"), ["drug", "uid"])
    model = GBTRegressor(maxIter=8, maxDepth=5, seed=7).fit(data.filter("lineage <> 'l0'"))
    own = model.transform(data.filter("lineage = 'l0'")).collect()
    assert len(got) == 900 and sum(abs(got[r.uid] - r.prediction) < 1e-6 for r in own) >= 0.95 * len(own)  # splits of equal gain may differ


def test_forest_sees_rows_by_their_number_and_ranks_features(spark, design):
    rows, index = design
    p = index.count()
    data = T.drawn(T.taken(rows), T.Forest(p, 40))
    taken = T.taken(rows).agg(F.count(F.lit(1)), F.sum("n")).first()
    draws = np.concatenate([np.frombuffer(r.draws, np.int32) for r in data.collect()])
    assert taken[0] < taken[1] == 900 and len(draws) == 40 * taken[0] and abs(draws.sum() / 40 - 900) < 25
    score = {r.uid: (r.y, r.score) for r in M.out_of_fold(rows, {"forest": T.Forest(p)}).collect()}
    r, s = ([x for y, x in score.values() if y == k] for k in (1, 0))
    assert len(score) == 900 and all(0 <= x <= 1 for x in r + s)
    assert np.mean([a > b for a in r for b in s]) > 0.75
    imp = {x.mutation: x.importance for x in M.variable_importance(rows, index).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["a"] > imp["g"] and imp["l"] > imp["h"]


def test_a_plain_forest_by_hand():
    """The leaves of one tree that sees every row once and both columns."""
    grown = T.Grown(np.array([[1, -1, 0, -1, -1, -1, -1]], np.int32), np.array([[0.5, 0.1, 0.0, 0.0, 0.0, 0.3, 0.9]]), np.zeros((1, 7)), np.array([1.0]))
    x = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], np.uint8)  # and a column of 0
    assert grown.says(x).tolist() == [0.1, 0.1, 0.3, 0.9]


def test_poisson_numbers():
    u = (np.arange(100_000) + 0.5).reshape(-1, 1) / 100_000
    for mean in (1, 7, 5000):
        k = T._poisson(u, np.full(len(u), mean))
        assert abs(k.mean() / mean - 1) < 1e-3 and abs(k.var() / mean - 1) < 1e-2


def test_no_column_of_a_row_is_made_for_trees(spark, design, monkeypatch):
    """The panel's trees never read the dense form: rows without vectors fit the same."""
    rows, index = design
    panel = {k: v for k, v in M.learners(index.count()).items() if k in ("forest", "boosted")}
    bare = M.out_of_fold(rows.drop("features"), panel)
    assert bare.groupBy("model").count().count() == 2 and bare.count() == 2 * rows.count()
