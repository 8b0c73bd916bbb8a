"""Firth fits, model cards, annotations and feature sets on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cohort as C
from cairn.operators import derive as D
from cairn.operators import models as M
from cairn.operators.firth import firth
from cairn.sources import release


def plain_firth(x, y, steps=25):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = mu * (1 - mu)
        inverse = np.linalg.inv((x * w[:, None]).T @ x + 1e-8 * np.eye(len(beta)))
        h = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        step = inverse @ (x.T @ (y - mu + h * (0.5 - mu)))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def test_firth_of_each_drug_is_the_joint_fit(spark):
    """Thirteen drugs, one with two thirds of the rows; a feature that nobody
    carries and one that separates."""
    rng = random.Random(6)
    rows, on, pool = [], {}, []
    for k in range(13):
        n = 400 if k == 0 else 30
        names = [f"m{j}" for j in range(5)]
        pool += [(f"D{k}", "g", m) for m in [*names, "none"]]
        for i in range(n):
            own = {m for m in names if rng.random() < 0.3}
            r = "m0" in own or rng.random() < 0.3
            rows.append((f"D{k}", f"{k}.{i}", "R" if r else "S"))
            on[f"{k}.{i}"] = own
    cohort = spark.createDataFrame(rows, "drug string, uid string, phenotype string").repartition(3)
    carried = spark.createDataFrame([(u, "g", m) for u, own in on.items() for m in own], "uid string, gene string, mutation string")
    got = {(r.drug, r.mutation): r.coef for r in firth(cohort, carried, spark.createDataFrame(pool, "drug string, gene string, mutation string")).collect()}
    names = [(d, m) for k in range(13) for d in [f"D{k}"] for m in [None, *[f"m{j}" for j in range(5)], "none"]]
    x = np.array([[float(d == drug and (m is None or m in on[u])) for d, m in names] for drug, u, _ in rows])  # all drugs in one system
    beta = plain_firth(x, np.array([p == "R" for *_, p in rows], float))
    assert got.keys() == set(names)
    assert all(math.isclose(got[k], b, abs_tol=1e-4) for k, b in zip(names, beta, strict=True))
    assert all(math.isfinite(v) for v in got.values()) and all(abs(got[f"D{k}", "none"]) < 1e-6 for k in range(13))


def test_firth_of_a_large_pool_in_many_blocks(spark, monkeypatch):
    """Three hundred features for each of two drugs, blocks that meet in two steps."""
    from cairn.operators import firth as module

    monkeypatch.setattr(module, "MEET", 2)
    rng = random.Random(9)
    rows = [(d, f"{d}{i}", "RS"[rng.random() < 0.5]) for d in "DE" for i in range(350)]
    carried = [(u, "g", f"m{j}") for _, u, _ in rows for j in range(300) if rng.random() < 0.03]
    pool = spark.createDataFrame([(d, "g", f"m{j}") for d in "DE" for j in range(300)], "drug string, gene string, mutation string")
    cohort = spark.createDataFrame(rows, "drug string, uid string, phenotype string").repartition(6)
    got = {(r.drug, r.mutation): r.coef for r in firth(cohort, spark.createDataFrame(carried, "uid string, gene string, mutation string"), pool, steps=3).collect()}
    assert len(got) == 602
    have = set(carried)
    own = [(u, p) for d, u, p in rows if d == "E"]
    names = sorted(f"m{j}" for j in range(300))
    x = np.array([[1.0, *[float((u, "g", m) in have) for m in names]] for u, _ in own])
    beta = plain_firth(x, np.array([p == "R" for _, p in own], float), 3)
    assert np.allclose([got["E", m] for m in [None, *names]], beta, atol=1e-6)


MODEL = "drug string, feature string, kind string, gene string, mutation string, fill double, coef double, mean double, scale double"


def test_model_cards(spark):
    terms = [("D", "g@a", "mutation", "g", "a", 0.0, 1.5, 0.1, 0.3), ("D", "g@b", "mutation", "g", "b", 0.0, -2.5, 0.1, 0.3), ("D", "tb_depth", "coverage", None, None, 40.0, 0.1, 30.0, 9.0), ("D", "intercept", "intercept", None, None, 0.0, -1.0, 0.0, 1.0), ("E", "g@a", "mutation", "g", "a", 0.0, 1.5, 0.1, 0.3)]
    model = spark.createDataFrame(terms, MODEL)
    tiers = spark.createDataFrame([("D", 0.9, "usable", 0.01)], "drug string, auc double, tier string, stability_std double")
    cohort = spark.createDataFrame([("D", "u", "R"), ("D", "v", "S"), ("D", "w", "S"), ("E", "u", "S")], "drug string, uid string, phenotype string")
    known = spark.createDataFrame([("g", "a")], "gene string, mutation string")
    marts = lambda *rows: spark.createDataFrame(rows, "drug string, release string, fe_id string")
    cards = {r.drug: r for r in M.model_cards(model, tiers, cohort, known, marts(("D", "v1", "fe-1"), ("E", "v1", "fe-1"))).collect()}
    d, e = cards["D"], cards["E"]
    assert (d.n_features, d.largest, d.n_missing, d.missing, d.depth_fill, d.n, d.n_r, d.pct_r, d.auc, d.tier, d.release, d.fe_id) == (3, "g@b,g@a", 1, "g@b", 40.0, 3, 1, 33.3, 0.9, "usable", "v1", "fe-1")
    assert (e.n_missing, e.missing, e.auc, e.depth_fill) == (0, "", None, None)
    again = {r.drug: r.model_sha256 for r in M.model_digest(model.orderBy(F.desc("feature"))).collect()}
    assert again == {k: r.model_sha256 for k, r in cards.items()} and d.model_sha256 != e.model_sha256
    for bad in ([("D", "v1", "fe-1"), ("E", "v2", "fe-1")], [("D", "v1", "fe-1"), ("E", "v1", "fe-2")], [("D", None, "fe-1")], [("D", "", "fe-1")]):
        with pytest.raises(ValueError):
            M.model_cards(model, tiers, cohort, known, marts(*bad))


def test_annotation_flags(spark):
    line = lambda attr: "\t".join(["chr", "src", "CDS", "10", "20", ".", "+", "0", attr])
    lines = [line("Locus=L1;Name=a;Functional_Category=PE/PPE;Drug Resistance Mutations=D1, D2;PFAM=PF1"), line("Locus=L2;Functional_Category=insertion seqs and phages;Product=an Essential kinase"), line("Locus=L3;Name=c;Functional_Category=lipid metabolism;Comments=nonessential"), "#x", "short\tline"]
    rows = release.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.gene: (r.is_hitchhiker_region, r.drug_resistance, r.pfam, r.essential_hint) for r in rows.collect()}
    assert got == {"a": (True, "D1, D2", "PF1", False), "L2": (True, "", "", True), "c": (False, "", "", False)}
    carried = spark.createDataFrame([("u", "a", "x"), ("u", "a", "y"), ("v", "c", "x")], "uid string, gene string, mutation string")
    assert [tuple(r) for r in D.resgene_burden(carried, rows, "D2").collect()] == [("u", 2)]


def test_cohort_of_one_drug(spark):
    truth = spark.createDataFrame([("u", "D", "R"), ("v", "D", "S"), ("w", "D", "N"), ("x", "D", "R"), ("u", "E", "S")], "uid string, drug string, phenotype string")
    calls = spark.createDataFrame([(u, "D", "S", "C", k) for u in "uvw" for k in (1, 2)] + [("x", "D", "U", "C", 1)], "uid string, drug string, prediction string, catalogue_name string, catalogue_version int")
    genomes = spark.createDataFrame([(u, "l1", 9.0) for u in "uvwx"], "uid string, lineage string, tb_depth double")
    samples = spark.createDataFrame([("u", "NL")], "uid string, country string")
    rows, absent = C.drug_cohort(truth, calls, genomes, samples, "C", 1, "D")
    assert absent == ["dataset", "sublineage", "tb_coverage"] and "tb_coverage" not in rows.columns
    assert sorted((r.uid, r.phenotype, r.sublineage, r.country, r.dataset) for r in rows.collect()) == [("u", "R", None, "NL", None), ("v", "S", None, None, None)]
    with pytest.raises(ValueError):
        C.drug_cohort(truth, calls, genomes, samples, "C", 1, "none")
