"""Firth's bias-reduced logistic regression of every drug, by iterated weighted
least squares. A drug's system has the drug's own columns only: partial sums of
all drugs leave each task as one block a drug, meet drug by drug, and are solved
there. The driver holds each drug's coefficients and inverse, as large as its
pool of features, never a system of all drugs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import stored

FEATURE = ["gene", "mutation"]
CHUNK = 2000  #: rows that are dense at a time
MEET = 64  #: blocks of a drug that meet in one task, about


def columns(cohort: DataFrame, pool: DataFrame) -> DataFrame:
    """(drug, gene, mutation, i): each drug's columns from 0, its constant (null
    gene) first."""
    constant = cohort.select("drug", F.lit(None).cast("string").alias("gene"), F.lit(None).cast("string").alias("mutation")).distinct()
    named = constant.unionByName(pool.select("drug", *FEATURE).distinct())
    return named.withColumn("i", F.row_number().over(Window.partitionBy("drug").orderBy(*FEATURE)) - 1)  # a pool's


def _dense(on: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(on), width))
    x[np.repeat(np.arange(len(on)), [len(v) for v in on]), np.concatenate(list(on)).astype(int)] = 1
    return x


def _partial(held, what: str):
    """A block a drug: the information matrix, or the modified score."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, total = held.value, {}
        for pdf in parts:
            for drug, rows in pdf.groupby("drug", sort=False):
                if drug not in state:
                    continue
                beta, inverse = state[drug]
                for k in range(0, len(rows), CHUNK):
                    part = rows.iloc[k : k + CHUNK]
                    x = _dense(part["on"], len(beta))
                    mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                    w = mu * (1 - mu)
                    if what == "information":
                        add = (x * w[:, None]).T @ x
                    else:
                        h = w * ((x @ inverse) * x).sum(axis=1)
                        add = x.T @ (part["y"].to_numpy() - mu + h * (0.5 - mu))
                    total[drug] = total.get(drug, 0) + add
        yield pd.DataFrame({"drug": list(total), "block": [v.tobytes() for v in total.values()]})

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in group["block"])
    return pd.DataFrame({"drug": [group["drug"].iloc[0]], "block": [total.tobytes()]})


def _inverted(ridge: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in group["block"])
        p = math.isqrt(len(total))
        inverse = np.linalg.inv(total.reshape(p, p) + ridge * np.eye(p))
        return pd.DataFrame({"drug": [group["drug"].iloc[0]], "block": [inverse.tobytes()]})

    return run


def firth(cohort: DataFrame, carried: DataFrame, pool: DataFrame, ridge: float = 1e-8, steps: int = 25, tolerance: float = 1e-6) -> DataFrame:
    """(drug, gene, mutation, coef) of each drug's fit on its `pool`; a drug's
    constant has no gene. A drug is done when no coefficient moves by
    `tolerance`, or after `steps`. Steps are 2 a coefficient at most."""
    spark = cohort.sparkSession
    index = stored(columns(cohort, pool), "columns")
    on = cohort.select("drug", "uid").join(carried.select("uid", *FEATURE).distinct(), "uid").join(index, ["drug", *FEATURE])
    on = on.groupBy("drug", "uid").agg(F.collect_list("i").alias("on"))  # a pool's at most
    y = (F.col("phenotype") == "R").cast("double").alias("y")
    rows = cohort.select("drug", "uid", y).join(on, ["drug", "uid"], "left").select("drug", "y", F.array_append(F.coalesce("on", F.array().cast("array<int>")), F.lit(0)).alias("on"))
    rows = stored(rows, "firth")
    parts = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    slots = 1 if parts <= MEET else math.ceil(math.sqrt(parts))

    def met(what: str, state: dict, last) -> dict[str, np.ndarray]:
        held = spark.sparkContext.broadcast(state)
        out = rows.mapInPandas(_partial(held, what), "drug string, block binary")
        if slots > 1:
            slot = F.pmod(F.spark_partition_id(), F.lit(slots)).alias("slot")
            out = out.select("*", slot).groupBy("drug", "slot").applyInPandas(lambda g: _summed(g), "drug string, block binary")
        found = out.groupBy("drug").applyInPandas(last, "drug string, block binary").collect()  # a block for each drug
        return {r["drug"]: np.frombuffer(r["block"]) for r in found}

    sizes = {r["drug"]: r["n"] for r in index.groupBy("drug").agg(F.count(F.lit(1)).alias("n")).collect()}
    beta, left = {d: np.zeros(n) for d, n in sizes.items()}, set(sizes)
    for _ in range(steps):
        inverse = {d: v.reshape(sizes[d], -1) for d, v in met("information", {d: (beta[d], None) for d in left}, _inverted(ridge)).items()}
        score = met("score", {d: (beta[d], inverse[d]) for d in left}, _summed)
        for d in sorted(left):
            step = inverse[d] @ score[d]
            beta[d] = beta[d] + np.clip(step, -2, 2)
            if np.abs(step).max() < tolerance:
                left.discard(d)
        if not left:
            break
    flat = [(d, i, float(b)) for d, own in beta.items() for i, b in enumerate(own)]
    return index.join(spark.createDataFrame(flat, "drug string, i int, coef double"), ["drug", "i"]).drop("i")
