"""Derived features: support, burdens, spread, origins and risk scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.mutations import radicalness
from cairn.operators.carriage import FEATURE, two_by_two
from cairn.operators.shared import few, in_shuffle, stored
from cairn.operators.stats import log_odds, odds_ratio, phi

FUNCTIONAL = ["nonsynonymous", "indel", "minor_indel", "nonsense_Z", "promoter_nt"]
LOSS = ["indel", "nonsense_Z"]
KEY = ["drug", *FEATURE]


def quality_values(mutations: DataFrame) -> DataFrame:
    """Greatest read support of each carriage (infinite counts as 1, none as 0)
    and whether all its calls are minor."""
    support = F.when(F.col("frs").isNull() | F.isnan("frs"), 0.0).when(F.col("frs") > 1, 1.0).otherwise(F.col("frs"))
    return mutations.groupBy("uid", *FEATURE).agg(F.round(F.max(support), 6).alias("support"), F.min("is_minor").alias("only_minor"))


def quality_gate(values: DataFrame, taus: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Carriage left by each threshold of support, and without minor calls."""
    t = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    kept = values.select("uid", *FEATURE, "support", "only_minor", t).filter("support >= tau")
    return kept.groupBy("tau").agg(F.count(F.lit(1)).alias("n_carried"), F.count_if(~F.col("only_minor")).alias("n_major"), F.count_distinct("uid").alias("n_uid"))


def gene_burden(carried: DataFrame, features: DataFrame, determinants: DataFrame) -> DataFrame:
    """Functional and loss-of-function mutations per isolate and determinant gene."""
    rows = carried.join(features, FEATURE).join(F.broadcast(determinants), "gene")  # curated genes
    return rows.groupBy("drug", "uid", "gene").agg(F.count_if(F.col("mut_class").isin(FUNCTIONAL)).alias("n_functional"), F.count_if(F.col("mut_class").isin(LOSS)).alias("n_loss"))


def radical_burden(carried: DataFrame) -> DataFrame:
    return carried.groupBy("uid").agg(F.round(F.sum(radicalness(F.col("mutation"))), 4).alias("radical_burden"))


def category_burden(carried: DataFrame, features: DataFrame, annotations: DataFrame) -> DataFrame:
    rows = carried.join(features, FEATURE).filter(F.col("mut_class").isin("nonsynonymous")).join(F.broadcast(annotations.select("gene", "category")), "gene")  # curated genes
    return rows.groupBy("uid", "category").agg(F.count(F.lit(1)).alias("n_nonsynonymous"))


def resgene_burden(carried: DataFrame, annotations: DataFrame, drug: str) -> DataFrame:
    """Mutations in genes whose curated list of drugs has this one."""
    genes = annotations.filter(F.array_contains(F.split("drug_resistance", r"\s*,\s*"), drug)).select("gene").distinct()  # curated genes
    return carried.join(F.broadcast(genes), "gene", "left_semi").groupBy("uid").agg(F.count(F.lit(1)).alias("n_resgene"))  # curated genes


def weighted_burden(carried: DataFrame, scores: DataFrame) -> DataFrame:
    """Sum of -score over what an isolate carries."""
    return carried.join(scores, FEATURE).groupBy("uid").agg(F.round(F.sum(-F.col("score")), 4).alias("burden"))


def score_contrast(scores: DataFrame, selected: DataFrame) -> DataFrame:
    flagged = scores.join(selected.select(*FEATURE).distinct().withColumn("s", F.lit(True)), FEATURE, "left").withColumn("is_selected", F.coalesce("s", F.lit(False)))
    return flagged.groupBy("is_selected").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def enrichment(features: DataFrame, selected: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Two-by-two of selection against being of the classes."""
    s = selected.select(*FEATURE).distinct().withColumn("s", F.lit(True))
    rows = features.join(s, FEATURE, "left").select(F.coalesce("s", F.lit(False)).alias("s"), F.col("mut_class").isin(list(classes)).alias("k"))
    k, t = F.col("k"), F.col("s")
    return rows.agg(F.count_if(t & k).alias("a"), F.count_if(t & ~k).alias("b"), F.count_if(~t & k).alias("c"), F.count_if(~t & ~k).alias("d")).withColumn("odds_ratio", F.round(odds_ratio(), 6))


def invariance(pairs_by_lineage: DataFrame, totals_by_lineage: DataFrame, least_r: float = 0.1, least: int = 10, lineages: int = 3) -> DataFrame:
    """Features whose association is present, with one sign, in many lineages."""
    each = two_by_two(pairs_by_lineage, totals_by_lineage, ["lineage"]).withColumn("r", phi())
    present = each.filter((F.col("carriers") >= least) & (F.round(F.abs("r"), 9) >= least_r))
    out = present.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_lineages"), F.count_distinct(F.signum("r")).alias("n_signs"))
    return out.withColumn("is_invariant", (F.col("n_lineages") >= lineages) & (F.col("n_signs") == 1))


def spread(carried: DataFrame, isolates: DataFrame, least: int = 10) -> DataFrame:
    """How many sublineages and lineages a feature's carriers are of."""
    g = carried.join(isolates.select("uid", "lineage", "sublineage"), "uid").groupBy(*FEATURE)
    return g.agg(F.count(F.lit(1)).alias("carriers"), F.count_distinct("sublineage").alias("n_sublineages"), F.count_distinct("lineage").alias("n_lineages")).filter(F.col("carriers") >= least)


def spread_burden(carried: DataFrame, spread_: DataFrame, top: int) -> DataFrame:
    best = spread_.orderBy(F.desc("n_sublineages"), F.desc("carriers"), *FEATURE).limit(top)
    return carried.join(F.broadcast(best.select(*FEATURE, "n_sublineages")), FEATURE).groupBy("uid").agg(F.sum("n_sublineages").alias("burden"))


def origins(carried: DataFrame, isolates: DataFrame) -> DataFrame:
    """Independent gains of each feature by small parsimony (Fitch) on the tree
    of dotted sublineage labels, absent at the root; all features at once.

    A label has the feature where any of its isolates does. Sets of states are
    two bits (1 absent, 2 present), absent children of the long form are {0}.
    Up, level by level: the intersection of the children's sets, or their union
    where that is empty. Down: keep the parent's state where allowed, else
    absent before present; gains are steps from absent to present.
    """
    tips = isolates.select("uid", "sublineage").filter("sublineage IS NOT NULL")
    paths = tips.select("sublineage").distinct().withColumn("p", F.split("sublineage", r"\."))
    depth = paths.agg(F.max(F.size("p"))).first()[0] or 0
    node = lambda k: F.array_join(F.slice("p", 1, k), ".")
    kids = {k: paths.filter(F.size("p") > k).select(node(k).alias("parent"), node(k + 1).alias("node")).distinct() for k in range(depth)}
    n_kids = {k: d.groupBy("parent").agg(F.count(F.lit(1)).alias("n_kids")) for k, d in kids.items()}
    seen = carried.join(tips, "uid").select(*FEATURE, "sublineage").distinct()
    levels = {}
    state = seen.withColumn("p", F.split("sublineage", r"\.")).filter(F.size("p") == depth).select(*FEATURE, F.col("sublineage").alias("node"), F.lit(2).alias("s"))
    levels[depth] = state
    for k in range(depth - 1, -1, -1):
        g = state.join(kids[k], "node").groupBy(*FEATURE, "parent").agg(F.count(F.lit(1)).alias("n"), F.bit_and("s").alias("i"), F.bit_or("s").alias("u")).join(n_kids[k], "parent")
        some_absent = F.col("n") < F.col("n_kids")
        i = F.when(some_absent, F.col("i").bitwiseAND(1)).otherwise(F.col("i"))
        u = F.when(some_absent, F.col("u").bitwiseOR(1)).otherwise(F.col("u"))
        up = g.select(*FEATURE, F.col("parent").alias("node"), F.when(i != 0, i).otherwise(u).alias("s"))
        own = seen.withColumn("p", F.split("sublineage", r"\.")).filter(F.size("p") == k).select(*FEATURE, F.col("sublineage").alias("node"), F.lit(2).alias("s"))
        state = up.unionByName(own).groupBy(*FEATURE, "node").agg(F.max("s").alias("s")).filter("s > 1")
        levels[k] = state
    placed = levels[0].select(*FEATURE, "node", F.lit(0).alias("on")) if depth else None
    gains = []
    for k in range(depth):
        step = levels[k + 1].join(kids[k], "node").join(placed.withColumnsRenamed({"node": "parent", "on": "above"}), [*FEATURE, "parent"], "left")
        above = F.coalesce("above", F.lit(0))
        on = F.when((above == 1) & (F.col("s").bitwiseAND(2) != 0), 1).when(F.col("s").bitwiseAND(1) != 0, 0).otherwise(1)
        placed = step.select(*FEATURE, "node", on.alias("on"), ((above == 0) & (on == 1)).alias("gain"))
        gains.append(placed.filter("gain").select(*FEATURE))
        placed = placed.drop("gain")
    every = gains[0]
    for g in gains[1:]:
        every = every.unionByName(g)
    n = every.groupBy(*FEATURE).agg(F.count(F.lit(1)).alias("n_origins"))
    return seen.select(*FEATURE).distinct().join(n, FEATURE, "left").na.fill(0, ["n_origins"])


def risk_weights(pairs: DataFrame, totals: DataFrame, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Log-odds of the carriers against the training rows' own, for features
    with enough carriers and others."""
    t = two_by_two(pairs, totals, by).filter((F.col("carriers") >= least) & (F.col("c") + F.col("d") >= least))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return t.select("drug", *by, *FEATURE, (log_odds(F.col("a") / F.col("carriers")) - log_odds((F.col("a") + F.col("c")) / n)).alias("w"))


def residual_weights(pairs_by_lineage: DataFrame, totals_by_lineage: DataFrame, least: int = 5) -> DataFrame:
    """Mean lift within lineages that have both labels and enough on each side."""
    t = two_by_two(pairs_by_lineage, totals_by_lineage, ["lineage"])
    n, r = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("c")
    t = t.filter((F.col("carriers") >= least) & (n - F.col("carriers") >= least) & (r > 0) & (r < n))
    lift = log_odds(F.col("a") / F.col("carriers")) - log_odds(r / n)
    return t.groupBy(*KEY).agg(F.avg(lift).alias("w"))


def risk_score(cohort: DataFrame, carried: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of an isolate's weights for each drug; 0 with none."""
    s = cohort.select("drug", "uid").join(carried, "uid").join(weights, KEY).groupBy("drug", "uid").agg(F.sum("w").alias("s"))
    out = cohort.select("drug", "uid", "lineage", (F.col("phenotype") == "R").cast("int").alias("y")).join(s, ["drug", "uid"], "left")
    return out.select("drug", "uid", "lineage", "y", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("score"))


def coded_score(cohort: DataFrame, codes: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """The same as `risk_score` of carriage as numbers. Weights of all drugs
    are sums of one pass over an isolate's features, a column each; an isolate's
    rows then meet its sums, not its features."""
    drugs = [r[0] for r in weights.select("drug").distinct().orderBy("drug").collect()]  # few by nature
    w = weights.join(few(features), FEATURE).groupBy("f").agg(*[F.sum(F.when(F.col("drug") == x, F.col("w"))).alias(f"w{k}") for k, x in enumerate(drugs)])
    on = codes.select("uid", F.explode("on").alias("f")).join(few(stored(w, "weights")), "f")
    sums = on.groupBy("uid").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(drugs))])
    base = cohort.select("drug", "uid", "lineage", (F.col("phenotype") == "R").cast("int").alias("y")).join(in_shuffle(sums), "uid", "left")
    s = F.coalesce(*[F.when(F.col("drug") == x, F.col(f"w{k}")) for k, x in enumerate(drugs)], F.lit(0.0))
    return base.select("drug", "uid", "lineage", "y", F.round(s, 4).alias("score"))


def usable_groups(cohort: DataFrame, least: int = 100, least_class: int = 15) -> DataFrame:
    """Sites, read off the isolate's id, with enough rows of both labels."""
    g = cohort.withColumn("site", F.regexp_extract("uid", r"^site\.(\d+)\.", 1)).groupBy("drug", "site")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phenotype") == "R").alias("n_r")).filter((F.col("n") >= least) & F.col("n_r").between(F.lit(least_class), F.col("n") - least_class))
