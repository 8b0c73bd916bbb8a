"""Written tables in the session's shared folder: results that several steps
read, and steps of iterative work, without a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a folder of our own only where the session names
    none and all of it runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """`df`, written and scanned again: computed once however often it is read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shuffle(df: DataFrame) -> DataFrame:
    """`df`, which has a row for each sample or more, for a join that deals it
    by its key. Spark takes a scan to be as large as its files: stored rows of
    few distinct values or of bytes are many times that when they are read, and
    would be broadcast through the driver."""
    return df.hint("merge")


#: Rows of a dimension (features, terms) that are broadcast, at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """A stored `df`, broadcast where it has `FEW` rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


#: A group that holds more than one row of so many is hot.
HOT = 1000


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """`rows` with the columns of `groups`, one row for each key, `size` its
    number of rows. Hot groups, of which there can be no more than `HOT`, are
    broadcast, so no task gets one whole; the others meet their rows in a
    shuffle. Both stored. Null keys meet nothing."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(size) * HOT > total))
    cold = rows.join(hot.select(*on), on, "left_anti").join(groups.filter(F.col(size) * HOT <= total), on)
    return rows.join(hot, on).unionByName(cold)


def at_once(run: Callable, items: Iterable, most: int = 4) -> list:
    """What `run` makes of each item, in order: fits of separate folds or
    settings are Spark jobs that need not wait for each other. The driver only
    starts them."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(run, items))
