"""Catalogues: grading mutations from cohorts, and comparing catalogues."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.tails import lower_tail, upper_tail
from cairn.operators.shared import in_shuffle, stored

Z95 = 1.959963984540054


def wilson(r: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval of a share."""
    p, z2 = r / n, Z95 * Z95
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def solo_counts(samples: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutations that are the only ones of a sample, with R and S samples."""
    one = mutations.groupBy("drug", "uid").agg(F.count(F.lit(1)).alias("k"), F.min("mutation").alias("mutation")).filter("k = 1")
    g = one.join(in_shuffle(samples), ["drug", "uid"]).groupBy("drug", "mutation")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phenotype") == "R").alias("n_r"))


def graded(solos: DataFrame, background: float, strict: bool = False) -> DataFrame:
    """S where the interval is below or holds the background and the share is
    not above it (strict: only below), R where it is above, U otherwise."""
    low, high = wilson(F.col("n_r"), F.col("n"))
    susceptible = (high < background) if strict else ((low <= background) & (F.col("n_r") <= background * F.col("n")))
    return solos.withColumn("prediction", F.when(low > background, "R").when(susceptible, "S").otherwise("U"))


#: A tail is below 1 - p only by more than this: what doubles make of 1 - 0.95
#: is not 0.05, and a tail of exactly 1 - p is not below it.
SLACK = 1e-12


def graded_exact(solos: DataFrame, background: float = 0.05, p: float | Column = 0.9, strict: bool = True) -> DataFrame:
    """Grades by the exact binomial test of a mutation's solos against the
    background, at confidence `p` (a column where rows differ in it). R: the
    share is above the background and so many resistant ones or more have less
    than 1 - p. Otherwise, `strict`: S if the share is below and so few or
    fewer have less than 1 - p, else U; not strict: S, unless shown otherwise."""
    p = F.lit(p) if isinstance(p, float) else p
    share, least = F.col("n_r") / F.col("n"), 1 - p - SLACK
    rows = solos.withColumn("p_over", upper_tail(background)("n_r", "n")).withColumn("p_under", lower_tail(background)("n_r", "n"))
    resistant = (share > background) & (F.col("p_over") < least)
    susceptible = (share < background) & (F.col("p_under") < least) if strict else F.lit(True)
    return rows.withColumn("prediction", F.when(resistant, "R").when(susceptible, "S").otherwise("U"))


def peeled(samples: DataFrame, mutations: DataFrame, grading: Callable[[DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """The grades of each `round`, stored: mutations graded S leave, which makes
    others solo, until none is S."""
    left = mutations.select("drug", "uid", "mutation").distinct()
    for k in count():
        found = stored(grading(solo_counts(samples, left)).withColumn("round", F.lit(k)))
        yield found
        s = found.filter("prediction = 'S'")
        if s.isEmpty():
            return
        left = stored(left.join(s.select("drug", "mutation"), ["drug", "mutation"], "left_anti"))


def grade(samples: DataFrame, mutations: DataFrame, background: float = 0.05, strict: bool = False, p: float | None = None) -> DataFrame:
    """Our own definition of grading by solos: mutations graded S leave, which
    makes others solo, until no more are S, however many rounds that takes (each
    has one mutation at least). Then R and U of the last counts. Grades are by
    the 95 % interval, or where `p` is given by the exact test at `p`.
    `samples(drug, uid, phenotype)`, `mutations(drug, uid, mutation)`."""
    by = (lambda solos: graded(solos, background, strict)) if p is None else (lambda solos: graded_exact(solos, background, p, strict))
    benign = found = None
    for found in peeled(samples, mutations, by):
        s = found.filter("prediction = 'S'")
        benign = s if benign is None else benign.unionByName(s)
    return benign.unionByName(found.filter("prediction <> 'S'"))


def grade_rounds(samples: DataFrame, mutations: DataFrame, confidences: Sequence[float], rounds: int, background: float = 0.05, strict: bool = False) -> DataFrame:
    """All grades of the first `rounds` rounds at each confidence: how a
    catalogue comes about. Where none is S no mutation leaves, and the rounds
    that follow grade the same again. The setting is a key of one job, `drug@p`."""
    each = F.explode(F.array(*map(F.lit, confidences))).alias("p")
    key = F.concat("drug", F.lit("@"), F.col("p").cast("string")).alias("drug")
    s = samples.select("drug", "uid", "phenotype", each).select(key, "uid", "phenotype")
    m = mutations.select("drug", "uid", "mutation", each).select(key, "uid", "mutation")
    part = lambda k: F.split_part("drug", F.lit("@"), F.lit(k))
    out = None
    for k, found in enumerate(peeled(s, m, lambda solos: graded_exact(solos, background, part(2).cast("double"), strict))):
        out = found if out is None else out.unionByName(found)
        if k + 1 == rounds:
            break
    for later in range(k + 1, rounds):
        out = out.unionByName(found.withColumn("round", F.lit(later)))
    return out.withColumn("p", part(2).cast("double")).withColumn("drug", part(1))


def grade_sweep(samples: DataFrame, mutations: DataFrame, taus: Sequence[float], background: float = 0.05) -> DataFrame:
    """First-round grades at each threshold of support (`frs`): the setting is
    a key of one job, `drug@tau`, not a loop."""
    t = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    key = F.concat("drug", F.lit("@"), F.col("tau").cast("string"))
    m = mutations.select("drug", "uid", "mutation", "frs", t).filter("frs >= tau").select(key.alias("drug"), "uid", "mutation").distinct()
    s = samples.select("drug", "uid", "phenotype", t).select(key.alias("drug"), "uid", "phenotype")
    g = graded(solo_counts(s, m), background)
    return g.groupBy(F.split_part("drug", F.lit("@"), F.lit(1)).alias("drug"), F.split_part("drug", F.lit("@"), F.lit(2)).cast("double").alias("tau"), "prediction").agg(F.count(F.lit(1)).alias("n"))


def catalogue_rows(catalogue: DataFrame, drug: str, order: str = "line") -> DataFrame:
    """A drug's rows, of repeated mutations the last line, blanks left out."""
    rows = catalogue.filter((F.col("drug") == drug) & (F.trim("mutation") != "") & (F.trim("prediction") != ""))
    w = Window.partitionBy("mutation").orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("drug", "mutation", "prediction")


def _both(built: DataFrame, ref: DataFrame) -> DataFrame:
    return built.withColumnRenamed("prediction", "built").join(ref.withColumnRenamed("prediction", "ref"), ["drug", "mutation"], "full_outer")


def compare(built: DataFrame, ref: DataFrame) -> DataFrame:
    b, r = F.col("built"), F.col("ref")
    shared = b.isNotNull() & r.isNotNull()
    return _both(built, ref).groupBy("drug").agg(
        F.count_if(shared).alias("n_shared"), F.count_if(shared & (b == r)).alias("n_agree"), F.count_if(shared & (b != r)).alias("n_disagree"),
        F.count_if(r.isNull()).alias("n_only_built"), F.count_if(b.isNull()).alias("n_only_ref"),
        F.round(100 * F.count_if(shared & (b == r)) / F.nullif(F.count_if(shared), F.lit(0)), 4).alias("pct_agree"),
    )


def recovery(built: DataFrame, ref: DataFrame) -> DataFrame:
    """R calls of the reference that the built catalogue has; kept apart from
    how many R calls either makes."""
    is_r = F.col("ref") == "R"
    return _both(built, ref).groupBy("drug").agg(
        F.count_if(is_r).alias("n_ref_r"), F.count_if(F.col("built") == "R").alias("n_built_r"), F.count_if(is_r & (F.col("built") == "R")).alias("n_recovered")
    )


def call_distribution(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("drug", "prediction").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_diff(built: DataFrame, ref: DataFrame) -> DataFrame:
    """Calls that only one catalogue uses: reported, never mapped."""
    a, b = built.agg(F.collect_set("prediction").alias("a")), ref.agg(F.collect_set("prediction").alias("b"))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return a.crossJoin(b).select(join(F.array_except("a", "b")).alias("only_built"), join(F.array_except("b", "a")).alias("only_ref"))  # one row each
