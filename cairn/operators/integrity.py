"""Discovery views and integrity checks over release tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_faults(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique or hold a null, with their number of rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return n.filter((F.col("n_rows") > 1) | null).withColumn("has_null", null)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    bad = key_faults(df, keys).limit(3).collect()
    if bad:
        raise ValueError(f"not a key: {list(keys)}, e.g. {bad}")


def with_row_id(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surrogate `row_id` for facts that have no key: unique, not dense. A
    hash of the keys would collide, a global number would be one task's."""
    return df.repartition(*keys).sortWithinPartitions(*keys).withColumn("row_id", F.monotonically_increasing_id())


def catalogues(effects: DataFrame, predictions: DataFrame) -> DataFrame:
    cols = ["catalogue_name", "catalogue_version"]
    both = effects.select(*cols, F.lit("e").alias("src")).unionByName(predictions.select(*cols, F.lit("p").alias("src")))
    return both.groupBy(*cols).agg(F.count_if(F.col("src") == "e").alias("n_effects"), F.count_if(F.col("src") == "p").alias("n_predictions"))


def sample_coverage(anchors: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], key: str = "uid") -> DataFrame:
    """One row per sample of any anchor, a flag for each anchor and fact."""
    named = [d.select(key).distinct().withColumn(f"in_{n}", F.lit(True)) for n, d in anchors.items()]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    for n, d in facts.items():
        out = out.join(d.select(key).distinct().withColumn(f"has_{n}", F.lit(True)), key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in out.columns if c != key])


def population_overlap(coverage: DataFrame, a: str, b: str) -> DataFrame:
    return coverage.agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(F.col(a) & F.col(b)).alias("n_both"), F.count(F.lit(1)).alias("n_all")
    )


def sample_fanout(facts: Mapping[str, DataFrame], key: str = "uid") -> DataFrame:
    return union([d.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), key, "n_rows") for n, d in facts.items()])


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent. Null keys are not orphans (they are counted
    apart), and a null in the parent hides nothing: an anti join, never NOT IN."""
    return child.dropna(subset=list(keys)).join(parent.select(*keys).distinct(), list(keys), "left_anti")


def orphan_codes(child: DataFrame, parent: DataFrame, code: str) -> DataFrame:
    return orphans(child.select(code).distinct(), parent, [code])


def ri_check(name: str, child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    found = orphans(child, parent, keys).agg(F.count(F.lit(1)).alias("n_orphans"))
    nulls = child.agg(F.count_if(null).alias("n_null_keys"))
    return found.crossJoin(nulls).select(F.lit(name).alias("check_name"), "n_orphans", "n_null_keys")  # one row each


def integrity_gate(summary: DataFrame, analysis: Sequence[str], strict: bool = False) -> DataFrame:
    """Checks by scope: those on `analysis` tables block when they fail, the
    others advise, unless `strict`."""
    scoped = summary.withColumn("scope", F.when(F.split_part("check_name", F.lit("."), F.lit(1)).isin(list(analysis)), "analysis").otherwise("peripheral"))
    failed = F.col("n_orphans") > 0
    return scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(failed).alias("n_failed"), F.count_if(failed & ((F.col("scope") == "analysis") | F.lit(strict))).alias("n_blocking")
    )


def require_gate(summary: DataFrame, analysis: Sequence[str], strict: bool = False) -> None:
    if integrity_gate(summary, analysis, strict).filter("n_blocking > 0").count():
        raise ValueError("integrity gate: a blocking check failed")


def fill_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return union([df.agg(F.count(c).alias("n_filled"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(c).alias("column_name"), "n_filled", "n_rows") for c in cols])


def coverage_guard(df: DataFrame, col: str, least: float = 0.5) -> None:
    """Refuse a threshold on a column that is mostly empty in scope."""
    r = df.agg(F.count(col).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if r["all"] == 0 or r["n"] < least * r["all"]:
        raise ValueError(f"{col} is filled in {r['n']} of {r['all']} rows")
