"""Labelled cohorts: phenotypes with a catalogue's call and the isolate's lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def resistant(col: str = "phenotype") -> Column:
    return F.col(col) == "R"


def cohort(phenotypes: DataFrame, predictions: DataFrame, isolates: DataFrame, catalogue: str, version: int, drug: str | None = None) -> DataFrame:
    """One row per (uid, drug) with truth and call both R or S. The catalogue's
    name and version are both pinned: two versions would repeat rows."""
    called = predictions.filter((F.col("catalogue_name") == catalogue) & (F.col("catalogue_version") == version) & F.col("prediction").isin("R", "S"))
    truth = phenotypes.filter(F.col("phenotype").isin("R", "S"))
    if drug is not None:
        called, truth = called.filter(F.col("drug") == drug), truth.filter(F.col("drug") == drug)
    return truth.join(called.select("uid", "drug", "prediction"), ["uid", "drug"]).join(isolates.drop("ck"), "uid")


# Columns that releases may lack, by table; numbers that are
# lacking are left out, for a column of nulls is no covariate.
GENOME_STRINGS = ("sublineage",)
GENOME_NUMBERS = ("tb_depth", "tb_coverage")
SAMPLE_STRINGS = ("country", "dataset")


def drug_cohort(phenotypes: DataFrame, predictions: DataFrame, genomes: DataFrame, samples: DataFrame, catalogue: str, version: int, drug: str) -> tuple[DataFrame, list[str]]:
    """The cohort of one drug and the columns that its release lacks. Truth and
    call are both R or S; genomes must be there, `samples` may be missing for
    an isolate. A missing string is null, a missing number no column. Raises
    where no row is left."""
    absent = [c for c in (*GENOME_STRINGS, *GENOME_NUMBERS) if c not in genomes.columns] + [c for c in SAMPLE_STRINGS if c not in samples.columns]
    string = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    own = genomes.select("uid", "lineage", *[string(genomes, c) for c in GENOME_STRINGS], *[c for c in GENOME_NUMBERS if c in genomes.columns])
    extra = samples.select("uid", *[string(samples, c) for c in SAMPLE_STRINGS])
    called = predictions.filter((F.col("catalogue_name") == catalogue) & (F.col("catalogue_version") == version) & (F.col("drug") == drug) & F.col("prediction").isin("R", "S"))
    truth = phenotypes.filter((F.col("drug") == drug) & F.col("phenotype").isin("R", "S"))
    rows = truth.join(called.select("uid", "drug", "prediction"), ["uid", "drug"]).join(own, "uid").join(extra, "uid", "left")
    return require_rows(rows, f"cohort of {drug}"), sorted(absent)


def require_rows(df: DataFrame, what: str = "cohort") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"empty {what}")
    return df


def per_drug_summary(rows: DataFrame) -> DataFrame:
    r, call = resistant(), resistant("prediction")
    return rows.groupBy("drug").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(r).alias("n_r"),
        F.count_if(~r).alias("n_s"),
        F.round(100 * F.count_if(r) / F.count(F.lit(1)), 2).alias("pct_r"),
        F.count_if(~r & call).alias("catalogue_fp"),
        F.count_if(r & ~call).alias("catalogue_fn"),
    )


def per_drug_lineage(rows: DataFrame) -> DataFrame:
    return rows.filter("lineage IS NOT NULL").groupBy("drug", "lineage").agg(F.count(F.lit(1)).alias("n"), F.count_if(resistant()).alias("n_r"))


def cohort_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("uid").alias("n_uid"), F.count_distinct("drug").alias("n_drug"))


def tag_cohort(samples: DataFrame, column: str, tag: str) -> DataFrame:
    """Samples of a release tag; a missing column or tag is refused."""
    if column not in samples.columns:
        raise ValueError(f"no column {column}")
    return require_rows(samples.filter(F.col(column) == tag).select("uid").distinct(), f"tag {tag}")


def resolve_phenotype(measured: DataFrame) -> DataFrame:
    """One row per (uid, drug) with any R or S: `phenotype`, null where the
    measurements contradict each other (`n_distinct` 2)."""
    valid = measured.filter(F.col("phenotype").isin("R", "S"))
    one = valid.groupBy("uid", "drug").agg(F.count_distinct("phenotype").alias("n_distinct"), F.min("phenotype").alias("least"))
    return one.select("uid", "drug", "n_distinct", F.when(F.col("n_distinct") == 1, F.col("least")).alias("phenotype"))


def phenotype_source(name: str, **sources: DataFrame) -> DataFrame:
    """Switch between sources of measurements, all as (uid, drug, phenotype)."""
    if name not in sources:
        raise ValueError(f"unknown source {name}: {sorted(sources)}")
    return sources[name].select("uid", "drug", "phenotype")


def cohort_mutations(mutations: DataFrame, samples: DataFrame, genes: Sequence[str], least_support: float | None = None) -> DataFrame:
    """`gene@mutation` rows of the samples, in the genes, by read support."""
    rows = mutations.filter(F.col("gene").isin(list(genes))).join(samples.select("uid").distinct(), "uid", "left_semi")
    if least_support is not None:
        rows = rows.filter(F.col("frs") >= least_support)
    return rows.select("uid", F.concat("gene", F.lit("@"), "mutation").alias("mutation")).distinct()


def cohort_report(samples: DataFrame, resolved: DataFrame, drug: str, expected: int) -> DataFrame:
    """How a cohort came about, one row."""
    n = samples.select("uid").distinct().agg(F.count(F.lit(1)).alias("n_cohort"))
    mine = resolved.join(samples.select("uid").distinct(), "uid", "left_semi")
    own = F.col("drug") == drug
    rest = mine.agg(
        F.count_distinct("uid").alias("n_phenotyped_any"),
        F.count_if(own).alias("n_phenotyped"),
        F.count_if(own & resistant()).alias("n_r"),
        F.count_if(own & (F.col("phenotype") == "S")).alias("n_s"),
        F.count_if(own & F.col("phenotype").isNull()).alias("n_conflicts"),
    )
    return n.crossJoin(rest).withColumn("delta", F.col("n_cohort") - F.lit(expected))  # one row each


def wildcards(mutations: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Default rules (pattern, call) for each gene that occurs: the rules are
    constants in the row's projection, so no join."""
    rule = F.explode(F.array(*[F.struct(F.lit(a).alias("pattern"), F.lit(b).alias("prediction")) for a, b in rules])).alias("r")
    genes = mutations.select(F.split_part("mutation", F.lit("@"), F.lit(1)).alias("gene")).distinct()
    return genes.select("gene", rule).select(F.concat("gene", F.lit("@"), "r.pattern").alias("mutation"), "r.prediction")
