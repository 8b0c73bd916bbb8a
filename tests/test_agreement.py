"""Cross-model selection and exact grading against plain Python."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from cairn.functions.tails import binomial_at_least, binomial_at_most
from cairn.operators import agreement as A
from cairn.operators import grading as G
from cairn.operators import models


@pytest.fixture(scope="module")
def design(spark):
    rng = random.Random(11)
    rows, carried = [], []
    for d, n in (("D", 160), ("E", 90)):
        for i in range(n):
            on = [f"m{k}" for k in range(6) if rng.random() < 0.3]
            carried += [(f"{d}{i}", "g", m) for m in on]
            rows.append((d, f"{d}{i}", f"l{i % 3}", "R" if (("m0" in on or "m1" in on) != (rng.random() < 0.1)) else "S"))
    cohort = spark.createDataFrame(rows, "drug string, uid string, lineage string, phenotype string")
    carriage = spark.createDataFrame(carried, "uid string, gene string, mutation string")
    pool = spark.createDataFrame([(d, "g", f"m{k}") for d in "DE" for k in range(7)], "drug string, gene string, mutation string")  # m6: no carrier
    return rows, carried, carriage, *models.design(cohort, carriage, pool)


def test_perceptron_is_the_fitted_model(spark, design):
    *_, rows, index = design
    n = index.count()
    net = A.fit_perceptron(rows, n, hidden=5, steps=30)
    model = MultilayerPerceptronClassifier(layers=[n, 5, 2], maxIter=30, seed=7).fit(rows)
    for r in model.transform(rows).collect():
        x = r.features.toArray()
        lead = net.lead + (net.margin / (1 + np.exp(-(x @ net.into + net.shift)))).sum()
        assert int(lead > 0) == r.prediction
        assert math.isclose(1 / (1 + math.exp(-lead)), r.probability[1], abs_tol=1e-9)


def test_permutation_importance_by_brute_force(spark, design):
    rows, carried, carriage, data, index = design
    names = {r.i: (r.drug, r.mutation) for r in index.collect()}
    rng = np.random.default_rng(4)
    net = A.Perceptron(rng.standard_normal((len(names), 4)) * 2, rng.standard_normal(4), rng.standard_normal(4) * 3, 0.3)
    got = {(r.drug, r.mutation): r.importance for r in A.permutation_importance(data, carriage, index, net, repeats=3, seed=42).collect()}
    offsets = {(r.i, r.turn): r.h for r in spark.range(len(names)).select(F.col("id").cast("int").alias("i"), F.explode(F.array(*map(F.lit, range(3)))).alias("turn")).select("i", "turn", F.xxhash64("i", "turn", F.lit(42)).alias("h")).collect()}
    on = {(u, m) for u, _, m in carried}
    want = {}
    for drug in "DE":
        uids = sorted((u for d, u, *_ in rows if d == drug), key=lambda u: (hashlib.md5(f"{u}|42".encode()).hexdigest(), u))
        y = np.array([{u: p == "R" for _, u, _, p in rows}[u] for u in uids], int)
        own = [i for i, (d, _) in names.items() if d == drug]
        x = np.zeros((len(uids), len(names)))
        for i in own:
            x[:, i] = [1 if names[i][1] is None or (u, names[i][1]) in on else 0 for u in uids]
        right = lambda x, y=y: ((net.lead + (net.margin / (1 + np.exp(-(x @ net.into + net.shift)))).sum(axis=1) > 0) == y).mean()
        for i in own:
            if names[i][1] is None:
                continue
            lost = []
            for turn in range(3):
                moved = x.copy()
                moved[:, i] = np.roll(x[:, i], 1 + offsets[i, turn] % (len(uids) - 1))  # place a goes to a + offset
                lost.append(right(x) - right(moved))
            want[drug, names[i][1]] = np.mean(lost)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert got["D", "m6"] == 0 and any(want.values())


def test_cross_model(spark, design):
    *_, carriage, rows, index = design
    union = A.cross_model(rows, carriage, index, top=3, mode="union", hidden=6).collect()
    both = A.cross_model(rows, carriage, index, top=3, hidden=6).collect()
    for d in "DE":
        own = [r for r in union if r.drug == d]
        shared = {r.mutation for r in own if r.in_forest and r.in_perceptron}
        assert shared == {r.mutation for r in both if r.drug == d} and shared >= {"m0", "m1"}
        assert sum(r.in_forest for r in own) == sum(r.in_perceptron for r in own) == 3
        assert {r.agreement for r in own} == {round(len(shared) / len(own), 6)}
    held = A.cross_model(rows, carriage, index, top=3, mode="union", held_out="l0", hidden=6)
    other = A.cross_model(rows.filter("lineage <> 'l0'"), carriage, index, top=3, mode="union", hidden=6)
    assert sorted(map(str, held.collect())) == sorted(map(str, other.collect()))
    for bad in (dict(mode="most"), dict(held_out="none of them", mode="union")):
        if bad["mode"] == "most":
            with pytest.raises(ValueError):
                A.cross_model(rows, carriage, index, **bad)
    with pytest.raises(ValueError):
        A.cross_model(rows.filter("y = 1"), carriage, index)
    with pytest.raises(ValueError):
        A.cross_model(rows.limit(0), carriage, index)


def test_binomial_tails():
    """Against sums of fractions."""
    for n in (1, 2, 7, 40, 200):
        for share in (0.05, 0.5, 0.93):
            s = Fraction(share)
            mass = [math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n + 1)]
            for r in {0, 1, n // 3, n // 2, n - 1, n}:
                assert math.isclose(binomial_at_least(r, n, share), float(sum(mass[r:])), rel_tol=1e-10)
                assert math.isclose(binomial_at_most(r, n, share), float(sum(mass[: r + 1])), rel_tol=1e-10)
    assert binomial_at_least(0, 5, 0.1) == binomial_at_most(5, 5, 0.1) == 1 and binomial_at_least(6, 5, 0.1) == 0
    assert 0 < binomial_at_least(50_050_000, 1_000_000_000, 0.05) < 1e-12  # no sum over a billion
    assert 0.49 < binomial_at_most(50_000_000, 1_000_000_000, 0.05) < 0.51


def test_confidence_and_strictness_decide_grades(spark):
    rows = [("one", 1, 1), ("few", 2, 30), ("none", 0, 20), ("many", 0, 60), ("all", 9, 10), ("near", 2, 40)]
    solos = spark.createDataFrame(rows, "mutation string, n_r long, n long")
    of = lambda p, strict: {r.mutation: r.prediction for r in G.graded_exact(solos, 0.05, p, strict).collect()}
    assert of(0.9, True) == {"one": "R", "few": "U", "none": "U", "many": "S", "all": "R", "near": "U"}
    assert of(0.95, True) == {"one": "U", "few": "U", "none": "U", "many": "S", "all": "R", "near": "U"}  # a tail of exactly 1 - p is not below it
    assert of(0.9, False) == {"one": "R", "few": "S", "none": "S", "many": "S", "all": "R", "near": "S"}
    samples = spark.createDataFrame([("D", f"u{i}", "R" if i < 3 else "S") for i in range(80)], "drug string, uid string, phenotype string")
    pairs = [("D", f"u{i}", "x") for i in range(3, 80)] + [("D", "u0", "y"), ("D", "u0", "x"), ("D", "u1", "y")]
    out = {r.mutation: (r.round, r.prediction) for r in G.grade(samples, spark.createDataFrame(pairs, "drug string, uid string, mutation string"), strict=True, p=0.9).collect()}
    assert out == {"x": (0, "S"), "y": (1, "R")}  # y's second sample is solo once x has left


def test_rounds_go_on_where_nothing_leaves(spark):
    """Every mutation is graded R at once: the second round grades the same again, as its SQL does."""
    samples = spark.createDataFrame([("D", f"u{i}", "R" if i < 30 else "S") for i in range(60)], "drug string, uid string, phenotype string")
    mutations = spark.createDataFrame([("D", f"u{i}", "xy"[i % 2]) for i in range(60)], "drug string, uid string, mutation string")
    rounds = lambda n: sorted((r.round, r.p, r.mutation, r.n, r.n_r, r.prediction) for r in G.grade_rounds(samples, mutations, [0.9, 0.95], n).collect())
    first = [(0, p, m, 30, 15, "R") for p in (0.9, 0.95) for m in "xy"]
    assert rounds(1) == first and rounds(3) == [(k, *r[1:]) for k in range(3) for r in first]
