"""Candidate pools and confounder-aware selection by three votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import carriage
from cairn.operators.carriage import FEATURE, top_n, two_by_two
from cairn.operators.ranks import by_hash, numbered, tile
from cairn.operators.shared import few, stored
from cairn.operators.stats import phi

KEY = ["drug", *FEATURE]
CRITICAL = 1.959963984540054  #: of a two-sided normal test at 5 %


def feature_corr(pairs: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return two_by_two(pairs, totals, by).withColumn("r", phi())


def pool(correlated: DataFrame, k: int, determinants: DataFrame, least: int = 10) -> DataFrame:
    """The `k` most correlated features with enough carriers, then the drug's
    determinant genes' features."""
    enough = correlated.filter((F.col("carriers") >= least) & F.col("r").isNotNull())
    best = top_n(enough, k, F.round(F.abs("r"), 9).desc())
    extra = enough.join(F.broadcast(determinants), ["drug", "gene"], "left_semi")
    return best.unionByName(extra).select(*KEY, "carriers", "r").distinct()


def strata(cohort: DataFrame, quantiles: int = 4) -> DataFrame:
    """Lineage by coverage quarter within each drug. Ranks are of distinct
    isolates, ties by uid."""
    base = stored(cohort.select("drug", "uid", "lineage", "phenotype", "tb_depth"), "cohort")
    n = base.groupBy("drug").agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(base, ["drug"], [F.col("tb_depth"), F.col("uid")], "_k").join(F.broadcast(n), "drug")  # a row for each drug
    return ranked.select(
        "drug", "uid", F.coalesce("lineage", F.lit("unknown")).alias("lineage"), (F.col("phenotype") == "R").cast("int").alias("y"),
        F.concat_ws("/", F.coalesce("lineage", F.lit("unknown")), tile(F.col("_k"), F.col("_n"), quantiles).cast("string")).alias("stratum"),
    )


def counts(strata_: DataFrame, carried: DataFrame) -> DataFrame:
    """`n1` carriers and `r1` resistant ones of each feature by drug, lineage
    and stratum: pairs, pools, votes and weights are all sums of these."""
    rows = strata_.join(carried, "uid")
    return rows.groupBy(*KEY, "lineage", "stratum").agg(F.count(F.lit(1)).alias("n1"), F.sum("y").alias("r1"))


def coded_counts(strata_: DataFrame, codes: DataFrame, features: DataFrame) -> DataFrame:
    """The same as `counts` of carriage as numbers."""
    n = carriage.coded_counts(strata_, codes, ["drug", "lineage", "stratum"]).join(few(features), "f")
    return n.select(*KEY, "lineage", "stratum", "n1", "r1")


def pairs_of(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counted.groupBy(*KEY, *by).agg(F.sum("n1").alias("carriers"), F.sum("r1").alias("carriers_r"))


def vote_effect(strata_: DataFrame, counted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Post-stratified risk difference of carriers, its 95 % interval and vote.

    Strata without carriers, or without others, say nothing of the difference
    and are left out; `share` is the rest of the cohort.
    """
    n = strata_.groupBy("drug", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_r"))
    whole = n.groupBy("drug").agg(F.sum("n").alias("n_all"))
    rows = counted.join(candidates.select(*KEY), KEY, "left_semi")
    t = rows.groupBy(*KEY, "stratum").agg(F.sum("n1").alias("n1"), F.sum("r1").alias("r1"))
    t = t.join(n, ["drug", "stratum"]).filter("n1 < n")
    p1, n0 = F.col("r1") / F.col("n1"), F.col("n") - F.col("n1")
    p0 = (F.col("n_r") - F.col("r1")) / n0
    each = t.select(*KEY, "n", (F.col("n") * (p1 - p0)).alias("d"), (F.col("n") * F.col("n") * (p1 * (1 - p1) / F.col("n1") + p0 * (1 - p0) / n0)).alias("v"))
    g = each.groupBy(*KEY).agg(F.sum("n").alias("n_used"), F.sum("d").alias("d"), F.sum("v").alias("v")).join(F.broadcast(whole), "drug")  # a row for each drug
    ate, se = F.col("d") / F.col("n_used"), F.sqrt("v") / F.col("n_used")
    out = g.select(*KEY, F.round(ate, 6).alias("ate"), F.round(ate - CRITICAL * se, 6).alias("ci_lower"), F.round(ate + CRITICAL * se, 6).alias("ci_upper"), F.round(F.col("n_used") / F.col("n_all"), 6).alias("share"))
    return out.withColumn("effect_significant", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def vote_residual(strata_: DataFrame, counted: DataFrame, candidates: DataFrame, least_r: float = 0.05) -> DataFrame:
    """Partial correlation of feature and label given lineage and coverage
    quarter: both centred within strata (what projecting on their one-hots
    does), then correlated.

    From counts: of each stratum n, n_r, carriers and resistant carriers give
    the within sums of squares and products.
    """
    n = strata_.groupBy("drug", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_r")).withColumnRenamed("stratum", "g")
    t = counted.join(candidates.select(*KEY), KEY, "left_semi").groupBy(*KEY, F.col("stratum").alias("g")).agg(F.sum("n1").alias("n1"), F.sum("r1").alias("r1"))
    sxy = F.sum(F.col("r1") - F.col("n1") * F.col("n_r") / F.col("n"))
    sxx = F.sum(F.col("n1") - F.col("n1") * F.col("n1") / F.col("n"))
    within = t.join(n, ["drug", "g"]).groupBy(*KEY).agg(sxy.alias("sxy"), sxx.alias("sxx"))
    syy = n.groupBy("drug").agg(F.sum(F.col("n_r") - F.col("n_r") * F.col("n_r") / F.col("n")).alias("syy"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    r = F.when((F.col("sxx") > 1e-12) & (F.col("syy") > 1e-12), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    out = within.join(F.broadcast(syy), "drug").withColumn("r", r)  # a row for each drug
    stat = F.col("r") * F.sqrt((F.col("n") - F.col("k") - 1) / (1 - F.col("r") * F.col("r")))
    return out.select(*KEY, F.round("r", 6).alias("partial_r"), F.round(stat, 5).alias("t_stat")).withColumn(
        "residual_survives", F.coalesce((F.abs("t_stat") > CRITICAL) & (F.abs("partial_r") >= least_r), F.lit(False))
    )


def placebo(cohort: DataFrame, carried: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """The effect vote under labels permuted within each drug: how many
    candidates it still calls significant."""
    held = stored(cohort.select("drug", "uid", "lineage", "phenotype", "tb_depth"), "cohort")
    ranked = by_hash(held, ["drug"], seed, "_a")
    drawn = by_hash(held, ["drug"], seed + 1, "_a").select("drug", F.col("phenotype").alias("_p"), "_a")
    shuffled = ranked.join(drawn, ["drug", "_a"]).drop("phenotype", "_a").withColumnRenamed("_p", "phenotype")
    base = stored(strata(shuffled), "strata")
    votes = vote_effect(base, counts(base, carried), candidates)
    return votes.groupBy("drug").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("effect_significant").alias("n_significant"))


def concordance(effect: DataFrame, residual: DataFrame, importance: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Votes joined; a candidate without a row in a vote did not get it."""
    out = effect.select(*KEY, "ate", "effect_significant").join(residual.select(*KEY, "partial_r", "residual_survives"), KEY, "full_outer")
    flags = ["effect_significant", "residual_survives"]
    if importance is not None:
        out = out.join(importance.select(*KEY, "important"), KEY, "full_outer")
        flags.append("important")
    out = out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return out.withColumn("n_votes", votes).withColumn("is_concordant", votes >= least)


def sensitivity(votes: DataFrame) -> DataFrame:
    """How many features each rule of concordance would keep; with a vote of
    importance, also that rule's."""
    n = F.col("n_votes")
    more = [F.count_if(F.col("effect_significant") & F.col("important")).alias("n_effect_important")] if "important" in votes.columns else []
    return votes.groupBy("drug").agg(
        F.count_if(n >= 1).alias("n_any"), F.count_if(n >= 2).alias("n_two"), F.count_if(F.col("effect_significant")).alias("n_effect"),
        F.count_if(F.col("effect_significant") & F.col("residual_survives")).alias("n_pair"), F.count_if(n >= 3).alias("n_three"), F.count(F.lit(1)).alias("n_candidates"), *more,
    )


def benchmark_gene(votes: DataFrame, effects: DataFrame) -> DataFrame:
    """Selected genes beside the catalogue's distinct mutations and R ones."""
    genes = votes.filter("is_concordant").groupBy("drug", "gene").agg(F.count(F.lit(1)).alias("n_selected"))
    known = effects.groupBy("drug", "gene").agg(F.count_distinct("mutation").alias("n_known"), F.count_distinct(F.when(F.col("prediction") == "R", F.col("mutation"))).alias("n_known_r"))
    return genes.join(known, ["drug", "gene"], "left").na.fill(0, ["n_known", "n_known_r"])


def benchmark_mutation(votes: DataFrame, effects: DataFrame) -> DataFrame:
    """Each selected mutation's verdict in the catalogue, the smallest of
    several, `not_in_catalogue` without any."""
    verdict = effects.groupBy(*KEY).agg(F.min("prediction").alias("verdict"))
    return votes.filter("is_concordant").select(*KEY, "n_votes").join(verdict, KEY, "left").na.fill("not_in_catalogue", ["verdict"])


def benchmark_summary(verdicts: DataFrame) -> DataFrame:
    new = F.col("verdict") == "not_in_catalogue"
    return verdicts.groupBy("drug").agg(F.count(F.lit(1)).alias("n_concordant"), F.count_if(new).alias("n_novel"), F.count_if(F.col("verdict") == "R").alias("n_known_r"))


def with_arm(df: DataFrame, held_out: str | None) -> DataFrame:
    """Record on every row whether it evaluates (a group held out) or deploys."""
    return df.withColumn("arm", F.lit("deployment" if held_out is None else "evaluation")).withColumn("held_out", F.lit(held_out or "none"))
