"""Evaluation of scores and models: random folds, leave-one-group-out, tiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.shared import at_once
from cairn.operators.stats import auc

# The tiers and their floors.
TIERS = ((0.88, "usable"), (0.80, "moderate"), (0.0, "at chance"))  #: thresholds are a parameter, these the default


def tier(value: Column, tiers: Sequence[tuple[float, str]] = TIERS) -> Column:
    out = F.lit(None).cast("string")
    for floor, name in reversed(tiers):
        out = F.when(value >= floor, name).otherwise(out)
    return out


def auc_by(scored: DataFrame, by: Sequence[str], least_rows: int = 0) -> DataFrame:
    return auc(scored, "score", F.col("y") == 1, by, least_rows).withColumn("auc", F.round("auc", 6))


def cv_folds(rows: DataFrame, fold: str, fit_score: Callable[[DataFrame, DataFrame], DataFrame], folds: Sequence, seen: DataFrame | None = None) -> DataFrame:
    """Out-of-fold scores: each fold scored by what the others fit. The fits
    are Spark jobs, some at a time; None without folds. `seen`: the same rows
    as fits take them, equal ones as one with their weight."""
    train = rows if seen is None else seen

    def scored(f) -> DataFrame:
        test = rows.filter(F.col(fold) == F.lit(f))
        return fit_score(train.filter(F.col(fold) != F.lit(f)), test).withColumn("fold", F.lit(f).cast("string"))

    parts = at_once(scored, folds)
    return reduce(DataFrame.unionByName, parts) if parts else None


def usable_for_logo(rows: DataFrame, group: str, least: int = 20) -> list[str]:
    """Groups with enough rows of both labels, few by nature."""
    g = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_r"))
    return sorted(r[0] for r in g.filter((F.col("n") >= least) & (F.col("n_r") > 0) & (F.col("n_r") < F.col("n"))).collect())


def cv_logo(rows: DataFrame, group: str, fit_score, least: int = 20, named_only: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """Leave each group out. `named_only`: rows of no usable group never train
    (lineages); otherwise all others do (sites)."""
    groups = usable_for_logo(rows, group, least)
    named = lambda df: df if df is None or not named_only else df.filter(F.col(group).isin(groups))
    return cv_folds(named(rows), group, fit_score, groups, named(seen))


def fold_means(scored: DataFrame, by: Sequence[str] = ("drug",)) -> DataFrame:
    """`logo_summary` without the pooled AUC, for those who do not ask for it."""
    groups = auc(scored, "score", F.col("y") == 1, [*by, "fold"])
    return groups.groupBy(*by).agg(F.count("auc").alias("n_groups"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def logo_summary(scored: DataFrame, by: Sequence[str] = ("drug",)) -> DataFrame:
    """Unweighted mean of group AUCs beside the pooled one, not rounded: what
    is made of them is rounded once, at its end."""
    pooled = auc(scored, "score", F.col("y") == 1, list(by)).select(*by, F.col("auc").alias("pooled_auc"))
    return fold_means(scored, by).join(pooled, list(by))


def headline(results: DataFrame) -> DataFrame:
    """From (drug, feature_set, regime, auc): leakage = random - logo of each
    set; gain = logo of the concordant set - logo of the de novo one."""
    wide = results.groupBy("drug").pivot("cell", ["concordant_random", "concordant_logo", "de_novo_random", "de_novo_logo"]).agg(F.max("auc"))
    return wide.select(
        "drug", F.round(F.col("concordant_random") - F.col("concordant_logo"), 4).alias("leakage"), F.round(F.col("concordant_logo") - F.col("de_novo_logo"), 4).alias("gain")
    )


def tier_report(folds: DataFrame, tiers: Sequence[tuple[float, str]] = TIERS) -> DataFrame:
    """From (drug, held_out, group, auc, random_auc, mean_group_auc): only the
    held-out group's own result of each fold counts."""
    own = folds.filter(F.col("group") == F.col("held_out")).filter("auc IS NOT NULL")
    g = own.groupBy("drug").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"), F.avg("random_auc").alias("r"), F.avg("mean_group_auc").alias("o")
    )
    return g.select(
        "drug", "n_folds", F.round("m", 4).alias("auc"), tier(F.col("m"), tiers).alias("tier"), F.when(F.col("n_folds") > 1, F.round("s", 4)).alias("stability_std"),
        F.round(F.col("r") - F.col("m"), 4).alias("inflation_vs_random"), F.round(F.col("o") - F.col("m"), 4).alias("selection_leakage"),
    )


def stability(groups: DataFrame, weakest: int = 3) -> DataFrame:
    """Spread of group AUCs and the weakest groups' names."""
    from pyspark.sql import Window

    w = Window.partitionBy("drug").orderBy(F.round("auc", 6), "group")
    ranked = groups.filter("auc IS NOT NULL").withColumn("k", F.row_number().over(w))
    low = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= weakest, F.struct("k", "group")))), lambda x: x["group"]), ",")
    return ranked.groupBy("drug").agg(F.round(F.stddev_pop("auc"), 6).alias("std_auc"), low.alias("weakest"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """Candidates (model) of each drug by AUC on held-out rows, the best marked."""
    from pyspark.sql import Window

    a = auc(scored, "score", F.col("y") == 1, ["drug", "model"]).withColumn("auc", F.round("auc", 6))
    w = Window.partitionBy("drug").orderBy(F.desc("auc"), "model")
    return a.select("drug", "model", "auc", (F.row_number().over(w) == 1).alias("is_best"))


def flatten_metrics(manifests: DataFrame, run: str = "run", doc: str = "manifest") -> DataFrame:
    """(run, metric, value) of nested JSON maps set -> regime -> metric."""
    parsed = F.from_json(doc, "map<string, map<string, map<string, double>>>")
    a = manifests.select(run, F.explode(parsed).alias("s", "x")).select(run, "s", F.explode("x").alias("r", "y"))
    return a.select(run, "s", "r", F.explode("y").alias("m", "value")).select(run, F.concat_ws(".", "s", "r", "m").alias("metric"), "value")
