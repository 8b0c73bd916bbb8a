"""Perceptrons over sparse rows against Spark ML's over dense ones."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cairn.operators import models as M
from cairn.operators import perceptron as N


@pytest.fixture(scope="module")
def design(spark):
    """Two drugs; three copies of each isolate."""
    rng = random.Random(5)
    isolates = [(d, f"{d}{i}", f"l{i % 3}", {m for m in "abcde" if rng.random() < 0.4}) for d in "DE" for i in range(70)]
    said = {u: "R" if ("a" in on) != (rng.random() < 0.1) else "S" for _, u, _, on in isolates}
    cohort = spark.createDataFrame([(d, f"{u}-{k}", x, said[u]) for d, u, x, _ in isolates for k in range(3)], "drug string, uid string, lineage string, phenotype string")
    carried = spark.createDataFrame([(f"{u}-{k}", "g", m) for _, u, _, on in isolates for k in range(3) for m in on], "uid string, gene string, mutation string")
    return M.design(cohort, carried, spark.createDataFrame([(d, "g", m) for d in "DE" for m in "abcde"], "drug string, gene string, mutation string"))


def test_equal_rows_are_taken_once(spark, design):
    rows, _ = design
    data = N.taken(rows)
    n = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert data.count() == rows.select("columns", "y").distinct().count() < rows.count() / 3
    assert abs(data.agg(F.sum("w")).first()[0] - sum(-(-k // N.BLOCK) for k in n)) < 1e-9  # blocks


def test_out_of_fold_scores_are_spark_mls(spark, design):
    rows, index = design
    p = index.count()
    panel = {"4x6": N.Net(p, 4, 6), "4x12": N.Net(p, 4, 12), "3x12": N.Net(p, 3, 12)}
    got = {(r.model, r.drug, r.uid): (r.fold, r.y, r.score) for r in M.out_of_fold(rows, panel).collect()}
    assert len(got) == 3 * rows.count()
    for name, net in panel.items():
        model = MultilayerPerceptronClassifier(layers=[p, net.hidden, 2], maxIter=net.steps, seed=7).fit(rows.filter("lineage <> 'l1'"))
        for r in model.transform(rows.filter("lineage = 'l1'")).select("drug", "uid", "y", vector_to_array("probability")[1].alias("score")).collect():
            fold, y, score = got[name, r.drug, r.uid]
            assert (fold, y) == ("l1", r.y) and abs(score - r.score) < 1e-7


def test_gradient_by_differences(spark):
    rows = spark.createDataFrame([([0, 2], 1, 2.0), ([], 0, 1.0), ([1], 0, 0.5), ([0, 1, 2], 1, 1.0)], "columns array<int>, y int, w double").repartition(2)
    f = N.loss_and_gradient(rows, 3, 2)
    w = np.random.default_rng(2).standard_normal(3 * 2 + 2 + 4 + 2)
    _, g = f(w)
    for k in range(len(w)):
        e = np.eye(len(w))[k] * 1e-6
        assert abs((f(w + e)[0] - f(w - e)[0]) / 2e-6 - g[k]) < 1e-7


def test_a_task_of_a_tree_holds_so_many_rows(spark, design, monkeypatch):
    """Rows of a few bytes lie in one file; a fit's tasks hold no more than they may."""
    rows, _ = design
    assert M.dealt(rows).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(M, "TREE_ROWS", 60)
    own = M.dealt(rows)
    n = own.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(n) == rows.count() == 420 and len(n) == 7 and max(n) <= 70


def test_documents_are_scored_without_vectors(spark):
    """Sums by document are those of its vectors, of documents without a hit, depth or lineage too."""
    from cairn.operators import serve as R

    docs = [("u", ("lineage1", 3.3), [("g", "m"), ("g", "a"), ("g", "m")]), ("v", ("lineage2", None), [("g", "m"), ("h", "tX")]), ("n", (None, 1.0), []), ("o", None, None)]
    docs = spark.createDataFrame(docs, R.INSTANCE)
    terms = [("D", "g@m", "mutation", 0.0, 1.0, 0.5, 2.0), ("E", "g@m", "mutation", 0.0, 3.0, 0.5, 1.0), ("E", "lineage1", "lineage", 0.0, 0.25, 0.2, 0.4), ("D", "tb_depth", "coverage", 40.0, 0.5, 1.0, 1.5), ("D", "h@tX", "mutation", 0.0, 9.0, 0.5, 1.0), ("D", "intercept", "intercept", 0.0, 1.0, 0.0, 1.0), ("F", "intercept", "intercept", 0.0, -1.0, 0.0, 1.0)]
    model = spark.createDataFrame(terms, "drug string, feature string, kind string, fill double, coef double, mean double, scale double")
    of = lambda df: {(r.uid, r.drug): (round(r.logit, 9), round(r.p_resistant, 9)) for r in df.collect()}
    got = of(R.score_documents(docs, model))
    assert len(got) == 12 and got == of(R.score(R.vectorize(docs, model), docs, model))
    own = R.score_documents(docs, model)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in own


def test_changes_are_dealt_once_and_names_are_not_read(spark, design):
    """Importance needs no long carriage, and changes meet their rows where they were summed."""
    from cairn.operators import agreement as A

    rows, index = design
    net = A.fit_perceptron(rows, index.count(), hidden=4, steps=8)
    got = {(r.drug, r.mutation): r.importance for r in A.permutation_importance(rows, None, index, net).collect()}
    assert len(got) == 10 and got["D", "a"] > 0.1 and got["E", "a"] > 0.1
    ones = spark.createDataFrame([("D", k, 9, 0) for k in range(1, 5)], "drug string, place long, n long, i int")
    own = A.moved(ones, 2, 42, 3)
    executed = own._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and own.agg(F.sum("change")).first()[0] == 0
