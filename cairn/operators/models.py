"""Models over sparse carriage, as Spark ML jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import perceptron, trees
from cairn.operators.carriage import coded
from cairn.operators.shared import at_once, in_shuffle, stored
from cairn.operators.stats import auc

FEATURE = ["gene", "mutation"]


def design(cohort: DataFrame, carried: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (drug, uid, lineage, y, label, weight, features) and the index
    (i, drug, gene, mutation) of their columns, of all drugs at once.

    Each drug has columns of its own, one for each feature of its pool and a
    constant (null gene), so one linear fit is a fit of every drug; weights give
    each drug the same say. The vectors are made in the JVM; the driver holds
    the pool's names, as many as a model has coefficients.
    """
    return coded_design(cohort, *coded(carried), pool)


def coded_design(cohort: DataFrame, codes: DataFrame, features: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of carriage as numbers. A row's columns are looked up in its
    drug's pool by number, in the row: nothing is dealt but the cohort, once.
    Rows also have `columns`, those that are 1."""
    constant = cohort.select("drug", F.lit(None).cast("string").alias("gene"), F.lit(None).cast("string").alias("mutation")).distinct()
    named = stored(pool.select("drug", *FEATURE).distinct().unionByName(constant), "pool")
    name = F.concat_ws("@", "drug", "gene", "mutation")
    vocabulary = named.join(features, FEATURE, "left").select(name.alias("k"), "drug", *FEATURE, "f").orderBy("k").collect()
    spark = cohort.sparkSession
    index = spark.createDataFrame([(i, *r[1:4]) for i, r in enumerate(vocabulary)], "i int, drug string, gene string, mutation string")
    size = features.count()
    at = {r["drug"]: [None] * size for r in vocabulary}  # a number for each feature and drug
    first = {}
    for i, r in enumerate(vocabulary):
        if r["gene"] is None:
            first[r["drug"]] = i
        elif r["f"] is not None:
            at[r["drug"]][r["f"]] = i
    places = spark.createDataFrame([(k, first[k], v) for k, v in at.items() if k in first], "drug string, _first int, _at array<int>")
    n = cohort.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    total, drugs = n.agg(F.sum("n"), F.count("n")).first()
    base = cohort.select("drug", "uid", F.coalesce("lineage", F.lit("unknown")).alias("lineage"), (F.col("phenotype") == "R").cast("int").alias("y"))
    base = base.join(F.broadcast(n.select("drug", (F.lit(float(total or 0)) / drugs / F.col("n")).alias("weight"))), "drug")  # a row for each drug
    rows = in_shuffle(base).join(codes, "uid", "left").join(F.broadcast(places), "drug")  # a row for each drug
    on = F.transform(F.coalesce("on", F.array().cast("array<int>")), lambda f: F.get("_at", f))
    rows = rows.select(*base.columns, F.array_sort(F.array_append(F.filter(on, lambda i: i.isNotNull()), F.col("_first"))).alias("columns"))
    return stored(vectors(rows, len(vocabulary)).withColumn("label", F.col("y").cast("double")).select("drug", "uid", "lineage", "y", "label", "weight", "features", "columns"), "design"), index


def vectors(rows: DataFrame, size: int) -> DataFrame:
    """`rows` with `features`, the vector of their `columns`; made in the JVM."""
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)] or ["none"], inputCol="_names", outputCol="features").setBinary(True)
    return counter.transform(rows.withColumn("_names", F.col("columns").cast("array<string>"))).drop("_names")


def merged(rows: DataFrame, *more: str) -> DataFrame:
    """Design rows that are equal in drug, lineage, label and columns (and
    `more`) as one, stored, with the sum of their weights. A loss that is a
    weighted sum over rows is the same, so linear models and boosted trees that
    see all rows fit the same; forests, which draw rows, and perceptrons, which
    take no weights, need the rows themselves."""
    g = rows.groupBy("drug", "lineage", "y", "label", "columns", *more)
    return stored(g.agg(F.sum("weight").alias("weight"), F.first("features").alias("features")), "merged")


def takes_merged(learner) -> bool:
    return isinstance(learner, LogisticRegression | GBTClassifier) and learner.isSet("weightCol") and (not isinstance(learner, GBTClassifier) or learner.getSubsamplingRate() == 1.0)


def logistic(reg: float = 0.05, l1: float = 0.0, drugs: int = 1, steps: int = 40) -> LogisticRegression:
    """`reg` is what each drug's own fit has: the joint loss averages drugs. The
    constant of a single drug does not vary, which the solver leaves out: there
    an intercept takes its place."""
    return LogisticRegression(regParam=reg / max(1, drugs), elasticNetParam=l1, maxIter=steps, standardization=False, fitIntercept=drugs < 2, weightCol="weight")


def learners(n_features: int, drugs: int = 1, seed: int = 7) -> dict[str, Callable]:
    """The panel. Spark ML has no extremely randomised trees: no such row."""
    return {
        "logistic_l2": logistic(0.01, 0.0, drugs),
        "elastic_net": logistic(0.01, 0.5, drugs),
        "forest": trees.Forest(max(1, n_features), 20, 8, seed),
        "boosted": trees.Boosted(max(1, n_features), 8, 5),
        "mlp": perceptron.Net(max(1, n_features), 8, 30, seed),
    }


#: Rows of a design that a task of a tree's fit holds, about: Spark ML keeps a number for every column of each.
TREE_ROWS = 100_000


def dealt(rows: DataFrame) -> DataFrame:
    """What a tree's fit reads of design rows, dealt again where tasks would
    hold more than `TREE_ROWS`: stored rows are a few bytes each, so a task that
    scans a file of them can get millions."""
    tasks = math.ceil(rows.count() / TREE_ROWS)
    own = rows.select("label", "weight", "features")
    return own.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows


def fit_score(learner) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        out = learner.fit(dealt(train) if isinstance(learner, RandomForestClassifier | GBTClassifier) else train).transform(test)
        return out.select("drug", "uid", "lineage", "y", vector_to_array("probability")[1].alias("score"))

    return run


def fit_score_nets(nets: Mapping[str, perceptron.Net], spark) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """All of `nets` of a fold, which see its rows in the same form."""
    starts = {name: net.start(spark) for name, net in nets.items()}

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        data = perceptron.taken(train)
        return perceptron.scores(test, perceptron.fitted(data, nets, starts))

    return run


def out_of_fold(rows: DataFrame, panel: Mapping[str, object], group: str = "lineage") -> DataFrame:
    """Scores of each model on each usable group by what the others fit."""
    from cairn.operators.evaluate import cv_logo, usable_for_logo

    out, seen = None, merged(rows) if group == "lineage" and any(map(takes_merged, panel.values())) else None
    nets = {name: x for name, x in panel.items() if isinstance(x, perceptron.Net)}
    grown = {name: x for name, x in panel.items() if isinstance(x, trees.Forest | trees.Boosted)}
    if nets:
        out = cv_logo(rows, group, fit_score_nets(nets, rows.sparkSession))
    if grown:
        groups = usable_for_logo(rows, group)
        part = trees.scores(rows, trees.fitted(rows, grown, groups, group), groups, group)
        out = part if out is None else out.unionByName(part)
    for name, learner in panel.items():
        if name in nets or name in grown:
            continue
        part = cv_logo(rows, group, fit_score(learner), seen=seen if takes_merged(learner) else None).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return stored(out, "oof")


def leaderboard(scored: DataFrame) -> DataFrame:
    return auc(scored, "score", F.col("y") == 1, ["drug", "model"]).withColumn("auc", F.round("auc", 6)).orderBy("drug", F.desc("auc"), "model")


def stack(oof: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """A logistic metalearner on the out-of-fold scores of each set of models,
    itself scored out of fold: weights, its AUC, and the lift over the best of
    its bases."""
    from pyspark.ml.feature import VectorAssembler

    from cairn.operators.evaluate import cv_folds

    every = sorted({m for models in sets.values() for m in models})
    wide = oof.groupBy("drug", "uid", "lineage", "fold", "y").pivot("model", every).agg(F.max("score")).na.fill(0.5, every)
    wide = stored(wide.withColumn("label", F.col("y").cast("double")), "stack")
    base = {r["model"]: r["auc"] for r in auc(oof.filter(F.col("model").isin(every)), "score", F.col("y") == 1, ["model"]).collect()}
    folds, out = [r[0] for r in wide.select("fold").distinct().orderBy("fold").collect()], []  # groups, few
    for name, models in sets.items():
        rows = VectorAssembler(inputCols=list(models), outputCol="features").transform(wide)
        meta = LogisticRegression(regParam=0.01)
        weights = meta.fit(rows).coefficients.toArray().tolist()
        own = auc(cv_folds(rows, "fold", fit_score(meta), folds).select("*", F.lit("all").alias("g")), "score", F.col("y") == 1, ["g"]).first()["auc"]
        out += [(name, m, float(w), own, base[m], own - max(base[x] for x in models)) for m, w in zip(models, weights, strict=True)]
    return oof.sparkSession.createDataFrame(out, "model_set string, model string, weight double, stack_auc double, base_auc double, lift double")


def _named(spark, values: Sequence[float], name: str) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"i int, {name} double")


def coefficients(rows: DataFrame, index: DataFrame, reg: float = 0.01, l1: float = 0.0) -> DataFrame:
    """(drug, gene, mutation, coef) of one fit of all drugs; a drug's constant
    has no gene."""
    drugs = index.filter("gene IS NULL").count()
    fitted = logistic(reg, l1, drugs).fit(merged(rows))
    out = index.join(_named(rows.sparkSession, fitted.coefficients.toArray(), "coef"), "i").drop("i")
    return out.withColumn("coef", F.when(F.col("gene").isNull(), F.col("coef") + F.lit(float(fitted.intercept))).otherwise(F.col("coef")))


def deployable(coefs: DataFrame, pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """A model as serving reads it: (drug, feature, kind, gene, mutation, fill,
    coef, mean, scale, direction). Features are centred on their share and
    scaled by its deviation; the row of kind `intercept` takes that up."""
    share = pairs.join(F.broadcast(totals), "drug").select("drug", *FEATURE, (F.col("carriers") / F.col("n")).alias("mean"))  # a row for each drug
    m = coefs.filter("gene IS NOT NULL").join(share, ["drug", *FEATURE])
    scale = F.sqrt(F.col("mean") * (1 - F.col("mean")))
    m = m.select("drug", F.concat("gene", F.lit("@"), "mutation").alias("feature"), F.lit("mutation").alias("kind"), *FEATURE, F.lit(0.0).alias("fill"), "mean", F.when(scale > 0, scale).otherwise(1.0).alias("scale"), F.col("coef").alias("raw"))
    moved = m.groupBy("drug").agg(F.sum(F.col("raw") * F.col("mean")).alias("moved"))
    base = coefs.filter("gene IS NULL").join(moved, "drug", "left").select("drug", (F.col("coef") + F.coalesce("moved", F.lit(0.0))).alias("coef"))
    none = F.lit(None).cast("string")
    base = base.select("drug", F.lit("intercept").alias("feature"), F.lit("intercept").alias("kind"), none.alias("gene"), none.alias("mutation"), F.lit(0.0).alias("fill"), "coef", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    m = m.select("drug", "feature", "kind", *FEATURE, "fill", (F.col("raw") * F.col("scale")).alias("coef"), "mean", "scale")
    return m.unionByName(base).withColumn("direction", F.when(F.col("coef") > 0, "R+").otherwise("S-"))


def top_features(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The first `n` features of each drug: a drug has a pool's features."""
    w = Window.partitionBy("drug").orderBy(by, *FEATURE)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def variable_importance(rows: DataFrame, index: DataFrame, top: int = 30) -> DataFrame:
    p = index.count()
    spec = learners(p)["forest"]
    grown = trees.forest(trees.drawn(trees.taken(rows), spec), spec)
    imp = index.join(_named(rows.sparkSession, trees.importances(grown, p), "importance"), "i").filter("gene IS NOT NULL").drop("i")
    return top_features(imp, F.desc("importance"), top)


def importance_vote(coefs: DataFrame, pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """|coef| times the mean absolute deviation of a 0/1 column; the vote is
    for the upper half of each drug's candidates."""
    p = pairs.join(F.broadcast(totals), "drug").select("drug", *FEATURE, (F.col("carriers") / F.col("n")).alias("p"))  # a row for each drug
    out = coefs.filter("gene IS NOT NULL").join(p, ["drug", *FEATURE]).withColumn("importance", F.abs("coef") * 2 * F.col("p") * (1 - F.col("p")))
    by = Window.partitionBy("drug")
    rank, n = F.row_number().over(by.orderBy(F.desc("importance"), *FEATURE)), F.count(F.lit(1)).over(by)
    return out.select("drug", *FEATURE, "importance", (rank <= F.greatest(F.lit(1), F.floor(n / 2))).alias("important"))


def nested_logo(rows: DataFrame, grid: Sequence[float], drugs: int, group: str = "lineage") -> DataFrame:
    """Regularisation chosen inside the training groups only: for each drug and
    held-out group, the value with the best mean inner AUC, and its outer AUC.
    A fit without two groups serves both orders of the pair."""
    from cairn.operators.evaluate import usable_for_logo

    groups, seen = usable_for_logo(rows, group), merged(rows)

    def scored(setting: tuple[float, str, str]) -> DataFrame:
        reg, a, b = setting
        part = fit_score(logistic(reg, 0.0, drugs, 20))(seen.filter(~F.col(group).isin(a, b)), rows.filter(F.col(group).isin(a, b)))
        # held out `a`, scored on `b`, and the other way round; a pair of one group is the outer fit
        other = F.when(F.col("lineage") == a, b).otherwise(a)
        return part.withColumns({"held_out": other if a != b else F.lit(a), "outer": F.lit(a == b), "reg": F.lit(reg)})

    parts = at_once(scored, [(reg, a, b) for reg in grid for k, a in enumerate(groups) for b in groups[k:]])
    out = reduce(DataFrame.unionByName, parts) if parts else None
    if out is None:
        return rows.sparkSession.createDataFrame([], "drug string, held_out string, reg double, inner_auc double, outer_auc double")
    each = auc(stored(out, "nested"), "score", F.col("y") == 1, ["drug", "held_out", "outer", "reg", "lineage"])
    inner = each.filter("NOT outer").groupBy("drug", "held_out", "reg").agg(F.round(F.avg("auc"), 9).alias("inner_auc"))
    best = inner.groupBy("drug", "held_out").agg(F.max(F.struct("inner_auc", (-F.col("reg")).alias("less"))).alias("b")).select("drug", "held_out", (-F.col("b.less")).alias("reg"), "b.inner_auc")
    return best.join(each.filter("outer").select("drug", "held_out", "reg", F.col("auc").alias("outer_auc")), ["drug", "held_out", "reg"], "left")


def class_weights(cohort: DataFrame) -> DataFrame:
    """n / (2 n_class) for each drug and label."""
    g = cohort.groupBy("drug", "phenotype").agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy("drug")
    return g.select("drug", "phenotype", F.round(F.sum("n_class").over(w) / (2 * F.col("n_class")), 6).alias("weight"))


def surrogate(rows: DataFrame, index: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """Additive models of another model's scores (drug, uid, score): the
    largest terms of each drug and how much of its scores they explain."""
    data = stored(rows.select("drug", "uid", "features", "columns").join(scores.select("drug", "uid", F.col("score").alias("label")), ["drug", "uid"]), "surrogate")
    once = stored(data.groupBy("columns", "label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("features").alias("features")), "surrogate")
    fitted = LinearRegression(regParam=0.001, fitIntercept=False, standardization=False, weightCol="n").fit(once)
    e = F.col("label") - F.col("prediction")
    r2 = fitted.transform(data).groupBy("drug").agg((1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"))
    terms = index.join(_named(rows.sparkSession, fitted.coefficients.toArray(), "term"), "i").filter("gene IS NOT NULL").drop("i")
    return top_features(terms, F.desc(F.abs("term")), top).join(F.broadcast(r2), "drug")  # a row for each drug


def graded_regression(rows: DataFrame, graded: DataFrame) -> DataFrame:
    """Out-of-lineage predictions of a graded phenotype (drug, uid, value) by
    boosted trees."""
    from cairn.operators.evaluate import usable_for_logo

    data = stored(rows.drop("label").join(graded.select("drug", "uid", F.col("value").alias("label")), ["drug", "uid"]), "graded")
    groups = usable_for_logo(data, "lineage")
    p = 1 + (data.select(F.max(F.array_max("columns"))).first()[0] or 0)
    grown = trees.boosted(trees.means_taken(data, groups), trees.Boosted(p, 8, 5, values=True), range(len(groups)))
    out = trees.scores(data, {"graded": grown}, groups, keys=["drug", "uid", "lineage", "y", "label"])
    return stored(out.withColumnRenamed("score", "prediction").drop("model", "fold"), "graded")


def transfer(rows: DataFrame, codes: DataFrame, features: DataFrame, pool: DataFrame, classes: Mapping[str, str], drugs: int) -> DataFrame:
    """One boosted model over (isolate, drug): features that drugs share, the
    drug and its class as categories. Its mean AUC on held-out lineages for
    each drug, and how far that is from the drugs' own linear models. Carriage
    is `codes` of `features`, as `coded` makes it."""
    spark = rows.sparkSession
    shared = features.join(F.broadcast(pool.select(*FEATURE).distinct()), FEATURE, "left_semi").orderBy(*FEATURE).select("f").collect()  # the pool's
    names = [r[0] for r in rows.select("drug").distinct().orderBy("drug").collect()]
    kinds = sorted({*classes.values(), "other"})
    at = [None] * features.count()  # a number for each feature
    for i, r in enumerate(shared):
        at[r["f"]] = i
    first = len(shared) + len(names)
    own = [(d, at, [len(shared) + k, first + kinds.index(classes.get(d, "other"))]) for k, d in enumerate(names)]
    places = spark.createDataFrame(own, "drug string, _at array<int>, _kinds array<int>")
    data = in_shuffle(rows.drop("features", "columns")).join(codes, "uid", "left").join(F.broadcast(places), "drug")  # a row for each drug
    on = F.filter(F.transform(F.coalesce("on", F.array().cast("array<int>")), lambda f: F.get("_at", f)), lambda i: i.isNotNull())
    data = stored(data.withColumn("columns", F.array_sort(F.concat(on, "_kinds"))).drop("on", "_at", "_kinds"), "transfer")
    joint = trees.Boosted(first + len(kinds), 10, 5)
    both = out_of_fold(data, {"joint": joint}).unionByName(out_of_fold(rows, {"own": logistic(0.01, 0.0, drugs)}))
    mean = auc(both, "score", F.col("y") == 1, ["drug", "model", "lineage"]).groupBy("drug", "model").agg(F.avg("auc").alias("m"), F.count("auc").alias("n"))
    wide = mean.groupBy("drug").agg(*[F.max(F.when(F.col("model") == m, F.col("m"))).alias(m) for m in ("joint", "own")], F.max("n").alias("n_groups"))
    return wide.select("drug", F.round("joint", 6).alias("mean_auc"), F.round(F.col("joint") - F.col("own"), 6).alias("delta"), "n_groups")


def model_digest(model: DataFrame) -> DataFrame:
    """(drug, model_sha256, n_features): a digest of each drug's terms, equal
    for equal models to nine decimals, whatever the order of their rows."""
    term = F.concat_ws("=", "feature", F.floor(F.col("coef") * 1e9 + 0.5).cast("string"))
    g = model.groupBy("drug").agg(F.array_join(F.array_sort(F.collect_list(term)), ";").alias("terms"), F.count_if(F.col("kind") != "intercept").alias("n_features"))  # a model's
    return g.select("drug", F.sha2("terms", 256).alias("model_sha256"), "n_features")


def one_release(marts: DataFrame) -> str:
    """The release that all of `marts(drug, release, fe_id)` come from, with
    one way of making features; raises where it is not one, or not named."""
    said = marts.agg(F.collect_set("release").alias("releases"), F.collect_set("fe_id").alias("ids"), F.count_if(F.col("release").isNull() | (F.col("release") == "")).alias("unnamed")).first()
    if said["unnamed"]:
        raise ValueError("a mart names no release")
    if len(said["releases"]) != 1 or len(said["ids"]) != 1:
        raise ValueError(f"one release and one way of making features a package, not {sorted(said['releases'])} and {sorted(said['ids'])}")
    return said["releases"][0]


def model_cards(model: DataFrame, tiers: DataFrame, cohort: DataFrame, mart_features: DataFrame, marts: DataFrame) -> DataFrame:
    """One card for each drug of a fitted `model` (as serving reads it): its
    digest and size, the features that the mart lacks, the largest terms, its
    evaluation, its cohort, and the release and feature identity of its mart. A
    drug without an evaluation keeps nulls."""
    release = one_release(marts)
    own = model.filter("kind = 'mutation'")
    gone = own.join(mart_features.select(*FEATURE).distinct(), FEATURE, "left_anti").groupBy("drug").agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("missing"))
    largest = top_features(own.withColumn("size", F.round(F.abs("coef"), 9)), F.desc("size"), 5).groupBy("drug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("largest"))
    fill = model.filter("kind = 'coverage'").groupBy("drug").agg(F.max("fill").alias("depth_fill"))
    n = cohort.groupBy("drug").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phenotype") == "R").alias("n_r")).withColumn("pct_r", F.round(100 * F.col("n_r") / F.col("n"), 1))
    out = model_digest(model)
    for part in (largest, fill, gone, n, tiers.select("drug", "auc", "tier", "stability_std"), marts.select("drug", "fe_id")):
        out = out.join(part, "drug", "left")
    return out.na.fill({"n_missing": 0, "missing": ""}).withColumn("release", F.lit(release))


def fills(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("drug").agg(F.round(F.median("tb_depth"), 6).alias("depth_fill"))


def mlp_sweep(rows: DataFrame, n_features: int, widths: Sequence[int] = (4, 16), iterations: Sequence[int] = (20, 40)) -> DataFrame:
    """Perceptrons by width and iterations (Spark ML has no L2 knob for them):
    mean AUC over drugs and held-out lineages, the best first."""
    panel = {f"{w}x{i}": perceptron.Net(max(1, n_features), w, i) for w in widths for i in iterations}
    a = auc(out_of_fold(rows, panel), "score", F.col("y") == 1, ["model", "drug", "lineage"])
    return a.groupBy("model").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.count("auc").alias("n_folds")).orderBy(F.desc("mean_auc"), "model")


def tuned(rows: DataFrame, grid: Sequence[tuple[float, float]], drugs: int) -> DataFrame:
    """Elastic nets by (reg, l1): mean AUC over drugs and held-out lineages."""
    panel = {f"{reg},{l1}": logistic(reg, l1, drugs, 20) for reg, l1 in grid}
    a = auc(out_of_fold(rows, panel), "score", F.col("y") == 1, ["model", "drug", "lineage"]).groupBy("model").agg(F.round(F.avg("auc"), 6).alias("mean_auc"))
    part = F.split("model", ",")
    return a.select(part[0].cast("double").alias("reg"), part[1].cast("double").alias("l1"), "mean_auc").orderBy(F.desc("mean_auc"), "reg", "l1")


def cv_random(rows: DataFrame, learner, folds: DataFrame, k: int) -> DataFrame:
    """Pooled out-of-fold AUC of given random folds (drug, uid, fold)."""
    from cairn.operators.evaluate import cv_folds

    folded = stored(rows.join(folds.select("drug", "uid", "fold"), ["drug", "uid"]), "folded")
    seen = merged(folded, "fold") if takes_merged(learner) else None
    return auc(cv_folds(folded, "fold", fit_score(learner), range(k), seen), "score", F.col("y") == 1, ["drug"])


def impute_confounders(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("drug",)) -> DataFrame:
    """Missing confounders as the median of their group, exact."""
    med = df.groupBy(*by).agg(*[F.median(c).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(med), list(by))  # a row for each drug
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
