"""The mart: core columns of each (drug, isolate) and its folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.ranks import by_hash
from cairn.operators.shared import stored


def raw_summary(mutations: DataFrame) -> DataFrame:
    """Per isolate over all its mutations."""
    return mutations.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_mutations"), F.avg("frs").alias("mean_frs"), F.avg("coverage").alias("mean_coverage"), F.count_if("is_minor").alias("n_minor")
    )


def cat_counts(effects: DataFrame) -> DataFrame:
    n = [F.count_if(F.col("prediction") == c).alias(f"n_{c.lower()}") for c in "RSUF"]
    return effects.groupBy("uid", "drug").agg(*n)


def coresist(cohort: DataFrame, drug: str, panel: Sequence[str]) -> DataFrame:
    """Other drugs' labels: 1, 0, or null without one; and how many are R."""
    others = [d for d in panel if d != drug]
    rows = cohort.filter(F.col("drug").isin(others)).select("uid", "drug", (F.col("phenotype") == "R").cast("int").alias("y"))
    wide = rows.groupBy("uid").agg(*[F.max(F.when(F.col("drug") == d, F.col("y"))).alias(f"coresist_{d}") for d in others], F.sum("y").alias("n_coresist"))
    return cohort.filter(F.col("drug") == drug).select("uid").join(wide, "uid", "left").withColumn("n_coresist", F.coalesce("n_coresist", F.lit(0).cast("long")))


def median_mic(measured: DataFrame, value: str = "mic") -> DataFrame:
    return measured.groupBy("uid", "drug").agg(F.median(value).alias("median_mic"))


def core(cohort: DataFrame, least_depth: float = 30.0) -> DataFrame:
    """Label, lineage one-hots, strings without nulls and quality flags, which
    are null where what they test is."""
    hot = [(F.coalesce("lineage", F.lit("")) == f"lineage{i}").cast("int").alias(f"lineage_l{i}") for i in range(1, 5)]
    high = F.col("quality") == "HIGH"
    deep = F.col("tb_depth") > least_depth
    return cohort.select(
        "uid", "drug", (F.col("phenotype") == "R").cast("int").alias("y"), *hot,
        F.coalesce("lineage", F.lit("unknown")).alias("lineage"), F.coalesce("country", F.lit("")).alias("country"),
        high.alias("is_high_quality"), deep.alias("is_deep"), (high & deep).alias("is_train_eligible"),
    )


def assemble(core_: DataFrame, summary: DataFrame, counts: DataFrame) -> DataFrame:
    """Core with summaries: counts default to 0, means to null."""
    out = core_.join(summary, "uid", "left").join(counts, ["uid", "drug"], "left")
    zero = ["n_mutations", "n_minor", "n_r", "n_s", "n_u", "n_f"]
    return out.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in zero else F.col(c) for c in out.columns])


def down_cast(df: DataFrame, presence: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Presence as bytes and counts as shorts, nulls as 0."""
    cast = {**dict.fromkeys(presence, "byte"), **dict.fromkeys(counts, "short")}
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).cast(cast[c]).alias(c) if c in cast else F.col(c) for c in df.columns])


def stratified_folds(cohort: DataFrame, n: int, seed: int) -> DataFrame:
    """Within each drug and class, dealt round robin in seeded hash order."""
    ranked = by_hash(stored(cohort.select("drug", "uid", "phenotype"), "folds"), ["drug", "phenotype"], seed, "_k")
    return ranked.select("drug", "uid", "phenotype", ((F.col("_k") - 1) % n).cast("int").alias("fold"))


def group_folds(cohort: DataFrame, group: str, known: Sequence[str]) -> DataFrame:
    """A fold for each known group in order; all others share the last."""
    fold = F.lit(len(known))
    for i, g in enumerate(sorted(known)):
        fold = F.when(F.col(group) == g, i).otherwise(fold)
    return cohort.select("drug", "uid", "phenotype", fold.cast("int").alias("fold"))


def stratified_group_folds(cohort: DataFrame, n: int, seed: int) -> DataFrame:
    """One fold for each isolate over all drugs, stratified by its number of
    resistant drugs: no isolate is in two folds."""
    own = cohort.groupBy("uid").agg(F.count_if(F.col("phenotype") == "R").alias("n_r"))
    ranked = by_hash(stored(own, "folds"), ["n_r"], seed, "_k")
    return ranked.select("uid", "n_r", ((F.col("_k") - 1) % n).cast("int").alias("fold"))


def assert_no_split(folds: DataFrame) -> None:
    if not folds.groupBy("uid").agg(F.count_distinct("fold").alias("k")).filter("k > 1").isEmpty():
        raise ValueError("an isolate is in two folds")


def fold_counts(folds: DataFrame) -> DataFrame:
    return folds.groupBy("drug", "fold", "phenotype").agg(F.count(F.lit(1)).alias("n"))


LINEAGES = ("lineage1", "lineage2", "lineage3", "lineage4")

#: Prefixes that a feature set drops, and strings that no model reads.
FEATURE_SETS = {"de_novo": ("cat__", "cov__coresist_"), "models": ("cov__coresist_",), "all": ()}
STRINGS = ("cov__lineage_raw", "cov__sublineage", "cov__country", "cov__dataset_version")


def in_feature_set(column: Column, name: str, held_out: bool) -> Column:
    """Whether a model may read the column of this name: the leakage boundary.
    Lineage one-hots go when a lineage is held out."""
    starts = lambda prefixes: F.coalesce(*[F.when(column.startswith(p), True) for p in prefixes], F.lit(False)) if prefixes else F.lit(False)
    gone = (*FEATURE_SETS[name], *(("cov__lineage_L",) if held_out else ()))
    return starts(("raw__", "cat__", "cov__")) & ~starts(gone) & ~column.isin(*STRINGS)


def multidrug_universe(correlated: DataFrame, k: int, least: int = 10) -> DataFrame:
    """Union over drugs of the `k` most correlated features with enough carriers."""
    w = Window.partitionBy("drug").orderBy(F.round(F.abs("r"), 9).desc(), "gene", "mutation")
    top = correlated.filter((F.col("carriers") >= least) & F.col("r").isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    return top.groupBy("gene", "mutation").agg(F.count(F.lit(1)).alias("n_drugs"))


def profile(cohort: DataFrame) -> DataFrame:
    r = F.count_if(F.col("phenotype") == "R")
    return cohort.groupBy("drug").agg(F.count(F.lit(1)).alias("n"), F.round(100 * r / F.count(F.lit(1)), 1).alias("pct_r"))


def multidrug_mart(cohort: DataFrame, classes: Mapping[str, str], carried: DataFrame, universe: DataFrame, lineages: Sequence[str] = LINEAGES) -> DataFrame:
    """One row per (isolate, drug): label, the drug and its class, covariates,
    and `features`, the names of the universe that the isolate carries, in
    order. An isolate's features are gathered once, not once for each drug; one
    that carries none has an empty array. Missing lineages are `unknown`,
    missing countries empty."""
    named = F.create_map(*[F.lit(x) for kv in sorted(classes.items()) for x in kv])
    chosen = universe.select("gene", "mutation").distinct()
    on = cohort.select("uid").distinct().join(carried.select("uid", "gene", "mutation").distinct().join(chosen, ["gene", "mutation"], "left_semi"), "uid")
    on = on.groupBy("uid").agg(F.array_sort(F.collect_list(F.concat(F.lit("raw__"), "gene", F.lit("_"), "mutation"))).alias("features"))
    one_hot = [F.coalesce((F.col("lineage") == name).cast("int"), F.lit(0)).alias(f"cov__lineage_L{k}") for k, name in enumerate(lineages, 1)]
    rows = cohort.join(on, "uid", "left")
    return rows.select(
        "uid", "drug", F.coalesce(named[F.col("drug")], F.lit("other")).alias("drug_class"), (F.col("phenotype") == "R").cast("int").alias("y"), *one_hot,
        F.coalesce("lineage", F.lit("unknown")).alias("lineage"), F.coalesce("country", F.lit("")).alias("country"), F.col("tb_depth").cast("float").alias("tb_depth"),
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
    )
