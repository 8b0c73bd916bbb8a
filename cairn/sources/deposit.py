"""Publishable deposits of marts and selections, and their identities."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.integrity import union

VERSION = "1"


def _short(prefix: str, *said: object) -> str:
    """A prefix and the first 12 hexadecimal digits of a hash: the contract's form."""
    text = json.dumps(said, sort_keys=True, separators=(",", ":"))
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest():.12}"


def fe_id(mart: Mapping, selection: Mapping, steps: Sequence) -> str:
    """Identity of feature engineering: its settings, not its data."""
    return _short("fe", VERSION, dict(mart), dict(selection), list(steps))


def mart_id(fe: str, checksum: str) -> str:
    """Identity of a mart: its feature engineering and what the data sum to."""
    return _short("mart", fe, checksum)


def producer(stage: str, settings: Mapping) -> str:
    """The block that a stage leaves with what it made; consumers read the
    settings from here and take no others."""
    return json.dumps({"stage": stage, "version": VERSION, "settings": dict(settings)}, sort_keys=True)


def marts_index(marts: DataFrame) -> DataFrame:
    """One row for each drug and fold of a union of marts."""
    return marts.groupBy("drug", "held_out").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("n_r"), F.count_distinct("uid").alias("n_uid"))


def selections_union(parts: Sequence[tuple[str | None, DataFrame]]) -> DataFrame:
    """Selections of all folds, each row saying which and whether it evaluates."""
    from cairn.operators.select import with_arm

    return union([with_arm(df, h) for h, df in parts])


def create_deposit(marts: DataFrame, selections: DataFrame, path: str, mart: Mapping, selection: Mapping, steps: Sequence = ()) -> None:
    """Six tables: marts and selections by drug and held-out group, the index
    and the manifests of both, where it comes from, and its identity."""
    from cairn.sources.release import table_checksum

    spark = marts.sparkSession
    for name, df in (("marts", marts), ("selections", selections)):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("drug", "held_out").parquet(f"{path}/{name}")
    marts_index(marts).write.mode("overwrite").parquet(f"{path}/marts_index")
    manifests = selections.groupBy("drug", "held_out").agg(F.count(F.lit(1)).alias("n_features"))
    manifests.withColumn("producer", F.lit(producer("selection", selection))).write.mode("overwrite").parquet(f"{path}/selection_manifests")
    identity = fe_id(mart, selection, steps)
    checksum = str(tuple(table_checksum(marts).first()))
    said = [("release", str(mart.get("release", ""))), ("producer", producer("mart", mart)), ("checksum", checksum), ("steps", json.dumps(list(steps)))]
    spark.createDataFrame(said, "key string, value string").write.mode("overwrite").parquet(f"{path}/provenance")
    spark.createDataFrame([(identity, mart_id(identity, checksum))], "fe_id string, mart_id string").write.mode("overwrite").parquet(f"{path}/fe_identity")


def open_deposit(spark: SparkSession, path: str, table: str, drugs: Sequence[str], arm: str) -> DataFrame:
    """Training units of some drugs: only their partitions are read. The
    deployment arm is what has nothing held out."""
    rows = spark.read.parquet(f"{path}/{table}").filter(F.col("drug").isin(list(drugs)))
    return rows.filter(F.col("held_out") == "none") if arm == "deployment" else rows.filter(F.col("held_out") != "none")


def require_arm(df: DataFrame, arm: str) -> DataFrame:
    """Evaluation refuses rows with nothing held out, deployment all others."""
    none = F.col("held_out") == "none"
    if not df.filter(none if arm == "evaluation" else ~none).isEmpty():
        raise ValueError(f"rows of the other arm in {arm}")
    return df
