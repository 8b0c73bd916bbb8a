"""Feature carriage in long form: (uid, gene, mutation), distinct. Statistics
group it; it becomes wide only for export."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.mutations import mut_class, region
from cairn.operators.ranks import numbered
from cairn.operators.shared import FEW, few, in_shuffle, stored

FEATURE = ["gene", "mutation"]


def carriage(mutations: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    rows = mutations if samples is None else mutations.join(samples.select("uid").distinct(), "uid", "left_semi")
    return rows.select("uid", *FEATURE).distinct()


def feature_dimension(carried: DataFrame) -> DataFrame:
    return carried.select(*FEATURE).distinct().select(*FEATURE, mut_class(F.col("mutation")).alias("mut_class"), region(F.col("gene")).alias("region"))


def labelled(cohort: DataFrame, carried: DataFrame) -> DataFrame:
    """A row for each feature that a cohort row carries, for all drugs;
    `carried` in long form or gathered."""
    core = cohort.select("drug", "uid", "lineage", "sublineage", (F.col("phenotype") == "R").cast("int").alias("y"))
    if "on" in carried.columns:
        return core.join(in_shuffle(carried), "uid").select(*core.columns, F.inline("on"))
    return in_shuffle(core).join(carried, "uid")


def totals(cohort: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cohort.groupBy("drug", *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phenotype") == "R").alias("n_r"))


def pair_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The kernel of most statistics: carriers, and resistant ones, of each
    feature for each drug. Partial sums leave each task, not rows."""
    return rows.groupBy("drug", *FEATURE, *by).agg(F.count(F.lit(1)).alias("carriers"), F.sum("y").alias("carriers_r"))


def two_by_two(pairs: DataFrame, totals_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """a, b: carriers resistant and not; c, d: the others."""
    t = F.broadcast(totals_)  # a row for each drug and group
    return pairs.join(t, ["drug", *by]).select(
        "drug", *by, *FEATURE, "carriers",
        F.col("carriers_r").alias("a"),
        (F.col("carriers") - F.col("carriers_r")).alias("b"),
        (F.col("n_r") - F.col("carriers_r")).alias("c"),
        (F.col("n") - F.col("n_r") - F.col("carriers") + F.col("carriers_r")).alias("d"),
    )


def eligible(pairs: DataFrame, totals_: DataFrame, least: int, most_share: float) -> DataFrame:
    """Features whose carriers are between `least` and a share of the cohort."""
    t = F.broadcast(totals_.select("drug", F.floor(F.lit(most_share) * F.col("n")).alias("most")))
    return pairs.join(t, "drug").filter(F.col("carriers").between(F.lit(least), F.col("most"))).drop("most")


def top_n(df: DataFrame, n: int | None, by: Column, part: Sequence[str] = ("drug",)) -> DataFrame:
    """The first `n` features of each drug by `by`, ties by name; None for all."""
    if n is None:
        return df
    w = Window.partitionBy(*part).orderBy(by, *FEATURE)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def seeded(universe: DataFrame, allowed: DataFrame, determinants: DataFrame) -> DataFrame:
    """`universe` with the drug's determinant genes' allowed features added."""
    extra = allowed.join(F.broadcast(determinants), ["drug", "gene"], "left_semi")
    return universe.select("drug", *FEATURE).unionByName(extra.select("drug", *FEATURE)).distinct()


def feature_long(carried: DataFrame, universe: DataFrame, cohort: DataFrame) -> DataFrame:
    """(drug, uid, feature) rows of the chosen universe."""
    rows = cohort.select("drug", "uid").join(carried, "uid").join(universe.select("drug", *FEATURE), ["drug", *FEATURE], "left_semi")
    return rows.select("drug", "uid", F.concat("gene", F.lit("_"), "mutation").alias("feature"))


def gathered(carried: DataFrame) -> DataFrame:
    """(uid, on): what each sample carries, as one row: a table that meets the
    rows of all drugs in one shuffle of samples instead of one of features."""
    return carried.groupBy("uid").agg(F.collect_list(F.struct(*FEATURE)).alias("on"))


#: Rows of carriage that one task gathers, about.
GATHERED_ROWS = 1_000_000


def numbered_features(named: DataFrame) -> DataFrame:
    """(f, gene, mutation): the distinct features of `named`, numbered from 0."""
    rows = stored(named.select(*FEATURE).distinct(), "named")
    return numbered(rows, [], [F.col(c) for c in FEATURE], "f").select((F.col("f") - 1).cast("int").alias("f"), *FEATURE)


def gathered_codes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(`key`, on): the distinct numbers `f` of each key's `n` rows in all. As
    many tasks as rows ask for: one never holds more because there are more."""
    dealt = rows.repartition(max(1, math.ceil(n / GATHERED_ROWS)), key)
    return dealt.groupBy(key).agg(F.collect_set("f").alias("on"))


def coded(carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long carriage as (uid, on) of numbers and the features they stand for."""
    features = stored(numbered_features(carried), "features")
    f = features.alias("f")
    rows = carried.alias("c").join(few(f), F.col("c.gene").eqNullSafe(F.col("f.gene")) & F.col("c.mutation").eqNullSafe(F.col("f.mutation"))).select("uid", "f.f")
    return stored(gathered_codes(rows, "uid", carried.count()), "coded"), features


def decoded(codes: DataFrame, features: DataFrame) -> DataFrame:
    """Carriage in long form of what `coded` makes."""
    return codes.select("uid", F.explode("on").alias("f")).join(few(features), "f").select("uid", *FEATURE)


#: Pairs of a feature and a group that a task counts at once, about.
TALLIED_PAIRS = 2_000_000


def tallied(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_k, f, n) of rows (on, _ks): how often each number of `_ks` meets each
    of `on` in one row, about `most` pairs at once. No row is made for a pair;
    what leaves is summed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, ks = batch.column("on"), batch.column("_ks")
            f, k = on.values.to_numpy(), ks.values.to_numpy()
            on_at, ks_at = on.offsets.to_numpy().astype(np.int64), ks.offsets.to_numpy().astype(np.int64)
            upto = np.cumsum(np.diff(on_at) * np.diff(ks_at))
            start = 0
            while start < len(upto):
                done = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
                groups, each = np.unique(k[ks_at[start] : ks_at[stop]], return_inverse=True)
                row = np.repeat(np.arange(start, stop), np.diff(ks_at[start : stop + 1]))
                size = on_at[row + 1] - on_at[row]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(on_at[row], size)
                if len(place):
                    width = int(f.max()) + 1
                    pair, n = np.unique(np.repeat(each, size) * width + f[place], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(groups[pair // width]), pa.array((pair % width).astype(np.int32)), pa.array(n)], ["_k", "f", "n"])
                start = stop

    return run


def coded_counts(rows: DataFrame, codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, f, n1, r1): carriers, and those with label `y` 1, of each feature
    in each group of `rows(uid, y, *by)`. Groups are few (of drugs, lineages,
    strata): rows that carry features are counted by two numbers, not by names."""
    groups = stored(rows.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    same = None
    for c in by:
        one = F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
        same = one if same is None else same & one
    met = rows.alias("r").join(few(groups).alias("g"), same).select("r.uid", (F.col("g._g") * 2 + F.col("r.y")).alias("_k"))
    met = met.groupBy("uid").agg(F.collect_list("_k").alias("_ks"))  # a row for each drug
    met = in_shuffle(met).join(codes, "uid").select("on", "_ks").mapInArrow(tallied(TALLIED_PAIRS), "_k long, f int, n long")
    n = met.groupBy(F.shiftright("_k", 1).alias("_g"), "f").agg(F.sum("n").alias("n1"), F.sum(F.when(F.col("_k") % 2 == 1, F.col("n")).otherwise(0)).alias("r1"))
    return n.join(few(groups), "_g").select(*by, "f", "n1", "r1")


def gene_flags_coded(codes: DataFrame, features: DataFrame) -> DataFrame:
    """The same as `gene_flags` of coded carriage: an isolate's genes are made
    distinct in its own row, so no row is dealt."""
    if features.count() > FEW:
        return gene_flags(decoded(codes, features))
    named = features.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "gene"))), lambda x: x["gene"]).alias("genes"))
    own = F.array_distinct(F.transform("on", lambda f: F.get("genes", f)))
    return codes.crossJoin(F.broadcast(named)).select("uid", F.explode(own).alias("gene"))  # one row


def gene_flags(carried: DataFrame) -> DataFrame:
    """Carriage at gene level: any mutation."""
    return carried.select("uid", "gene").distinct()
