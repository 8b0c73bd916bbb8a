"""Statistics of features and scores as closed forms over grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.ranks import running
from cairn.operators.shared import hot_join, stored


def _abcd() -> tuple[Column, ...]:
    return tuple(F.col(c).cast("double") for c in "abcd")


def chi2() -> Column:
    """Of the two-by-two table a, b, c, d; 0 where a margin is 0."""
    a, b, c, d = _abcd()
    n, below = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, n * (a * d - b * c) * (a * d - b * c) / below).otherwise(0.0)


def mutual_information() -> Column:
    a, b, c, d = _abcd()
    n = a + b + c + d

    def term(x: Column, row: Column, col: Column) -> Column:
        return F.when(x > 0, x / n * F.log(x * n / (row * col))).otherwise(0.0)

    return term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d)


def phi() -> Column:
    """Point-biserial correlation of two binaries; null where one is constant."""
    a, b, c, d = _abcd()
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, (a * d - b * c) / F.sqrt(below))


def odds_ratio() -> Column:
    a, b, c, d = _abcd()
    return F.when(b * c > 0, a * d / (b * c))


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def score_steps(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores of each group with their counts and average rank: ties
    share one, so the window runs over distinct scores, not rows."""
    steps = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_pos"))
    ranked = running(steps, by, score, "n", "_upto")
    return ranked.withColumn("avg_rank", F.col("_upto") - (F.col("n") - 1) / 2).drop("_upto")


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str], least_rows: int = 0) -> DataFrame:
    """Exact area under the ROC curve of each group, null with one class."""
    s = score_steps(df, score, positive, by)
    g = s.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.sum(F.col("n_pos") * F.col("avg_rank")).alias("ranks"))
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    value = F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / (pos * neg))
    return g.filter(F.col("n") >= least_rows).select(*by, "n", "n_pos", value.alias("auc"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """`df` with `out`: the rank of `value` in its group, ties share the mean.
    A value may be that of any share of the rows."""
    rows = stored(df, "ranked")
    ranks = running(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), by, value, "_n", "_upto")
    ranks = stored(ranks.select(*by, value, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), "ranks")
    return hot_join(rows, ranks, [*by, value], "_n").drop("_n")


def spearman_rmse(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df, a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman"), F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2)).alias("rmse")
    )


def benjamini_hochberg(df: DataFrame, p: str = "p", by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """`q`: p n / rank, made monotone from the largest p, at most 1."""
    part = Window.partitionBy(*by)
    up = part.orderBy(F.col(p), *ties)
    down = part.orderBy(F.col(p).desc(), *[F.col(t).desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_r", F.row_number().over(up))
    return ranked.withColumn("q", F.least(F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down), F.lit(1.0))).drop("_n", "_r")


def rank_graded(graded: DataFrame, carried: DataFrame, least: int) -> DataFrame:
    """Mann-Whitney U of carriers against the others on a graded phenotype,
    for (drug, uid, value): effect = |2U/(n1 n2) - 1|, ranks made once for the
    cohort, at least `least` carriers and others."""
    rows = graded.filter("value IS NOT NULL AND NOT isnan(value)")
    ranked = average_ranks(rows, "value", ["drug"], "rank")
    n = ranked.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    ties = rows.groupBy("drug", "value").agg(F.count(F.lit(1)).alias("t")).groupBy("drug").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranked.join(carried, "uid").groupBy("drug", "gene", "mutation").agg(F.count(F.lit(1)).alias("n1"), F.sum("rank").alias("ranks"))
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    out = sums.join(F.broadcast(n.join(ties, "drug")), "drug").filter((n1 >= least) & (n2 >= least))  # a row for each drug
    sd = F.sqrt(n1 * n2 / 12.0 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    return out.select("drug", "gene", "mutation", "n1", n2.alias("n2"), u.alias("u"), F.abs(2 * u / (n1 * n2) - 1).alias("effect"), F.when(sd > 0, (u - n1 * n2 / 2) / sd).alias("z"))
