"""The wide mart: 0/1 columns of a chosen universe, as many as it has.

Columns are numbered by name and written in blocks of so many, a folder of
Parquet for each, beside a table that says which column is where. No plan is
wider than a block, and who needs a few columns reads their blocks alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ranks import numbered
from cairn.operators.shared import in_shuffle, stored

BLOCK = 400  #: columns of a block, at most
FEATURE = ["gene", "mutation"]


def column_name() -> Column:
    return F.concat(F.lit("raw__"), "gene", F.lit("_"), "mutation")


def columns_of(universe: DataFrame, block: int = BLOCK) -> DataFrame:
    """(drug, gene, mutation, column, block): each drug's columns in the order
    of their names. Two features of one name would be one column: an error."""
    named = stored(universe.select("drug", *FEATURE).distinct().withColumn("column", column_name()), "named")
    twice = named.groupBy("drug", "column").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"columns of two features: {[r['column'] for r in twice.limit(5).collect()]}")
    ranked = numbered(named, ["drug"], [F.col("column")], "_k")
    return ranked.withColumn("block", F.floor((F.col("_k") - 1) / block).cast("int")).drop("_k")


def write_wide(cohort: DataFrame, carried: DataFrame, universe: DataFrame, path: str, block: int = BLOCK) -> None:
    """For each drug a wide table over the samples of `cohort(drug, uid)`, under
    `path`: `columns`, `samples`, and in `cells/<drug>/<block>` the columns of
    a block for the samples that have any of them."""
    spark = cohort.sparkSession
    columns_of(universe, block).write.parquet(f"{path}/columns")
    columns = spark.read.parquet(f"{path}/columns")
    samples = cohort.select("drug", "uid").distinct()
    samples.write.partitionBy("drug").parquet(f"{path}/samples")
    ones = in_shuffle(samples).join(carried.select("uid", *FEATURE).distinct(), "uid").join(columns, ["drug", *FEATURE])
    # dealt by block once: the job of a block reads no other's rows
    ones.select("drug", "block", "uid", "column").write.partitionBy("drug", "block").parquet(f"{path}/ones")
    ones = spark.read.schema("uid string, column string, drug string, block int").parquet(f"{path}/ones")
    for drug, number in columns.select("drug", "block").distinct().orderBy("drug", "block").collect():  # a row for each job
        at = (F.col("drug") == drug) & (F.col("block") == number)
        names = [r["column"] for r in columns.filter(at).orderBy("column").collect()]  # a block's
        cells = ones.filter(at).groupBy("uid").pivot("column", names).agg(F.max(F.lit(1).cast("byte")))
        cells.write.parquet(f"{path}/cells/{drug}/{number}")


def read_wide(spark: SparkSession, path: str, drug: str, names: Sequence[str] | None = None) -> DataFrame:
    """`uid` and the named columns of a drug's mart, all of them for None, for
    every sample; what a sample does not carry is 0. Only their blocks are
    read. A name that the mart has not raises `KeyError`."""
    columns = spark.read.parquet(f"{path}/columns").filter(F.col("drug") == drug)
    wanted = columns if names is None else columns.filter(F.col("column").isin(list(names)))
    at = {r["column"]: r["block"] for r in wanted.orderBy("column").collect()}  # the columns of the result
    names = list(at) if names is None else list(names)
    if gone := [n for n in names if n not in at]:
        raise KeyError(f"not in the mart: {gone}")
    out = spark.read.parquet(f"{path}/samples").filter(F.col("drug") == drug).select("uid")
    for number in sorted({at[n] for n in names}):
        own = [n for n in names if at[n] == number]
        cells = spark.read.parquet(f"{path}/cells/{drug}/{number}").select("uid", *[F.col(f"`{n}`") for n in own])
        out = out.join(in_shuffle(cells), "uid", "left")
    return out.select("uid", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("byte").alias(n) for n in names])


def melted(wide: DataFrame) -> DataFrame:
    """(uid, column, value) of every cell of a wide mart."""
    names = [c for c in wide.columns if c != "uid"]
    return wide.unpivot("uid", [F.col(f"`{n}`") for n in names], "column", "value")


def column_sums(wide: DataFrame) -> DataFrame:
    """(column, n_cells, n_ones) of a wide mart: sums of its columns, without a
    row for each cell."""
    names = [c for c in wide.columns if c != "uid"]
    one = wide.agg(F.count(F.lit(1)).alias("n_cells"), *[F.coalesce(F.sum(F.col(f"`{n}`").cast("long")), F.lit(0).cast("long")).alias(n) for n in names])
    return one.unpivot("n_cells", [F.col(f"`{n}`") for n in names], "column", "n_ones").select("column", "n_cells", "n_ones")
