"""What several training-data operators share: durable tables, gapless
numbering and connected components, all as plain DataFrame jobs."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hash space of `hash60`: 15 hexadecimal digits.
HASH_SPACE = 1 << 60


_remembered: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks of one operator, such as words
    looked up; another operator's goes first. Called inside tasks, so that it
    is the worker's own and never shipped."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = make()
    return _remembered[name]


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it one that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or one of
    our own where the session names none and all of it runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and return a scan of it: the lineage
    ends there, and a lost executor costs no more than the step after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str, text_col: str, scanned: bool = False) -> DataFrame:
    """`_row` (all columns of `docs`), `_text` and `_key`, a key of the row's
    own that sorts by id, null ids last. Rows are stored with a number first.
    `scanned` says that `docs` is a plain scan of stored files, each row of
    which comes once: then file and place in it are the key, and no copy of the
    texts is made. Not so after an explode, a union or a join."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if scanned and unused(docs, "_metadata") == "_metadata":
        rows = docs.select(row, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("_n"))
    else:
        rows = stored(docs.select(row, F.monotonically_increasing_id().cast("string").alias("_n")), "keyed")
    id_ = F.col("_row").getField(id_col)
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("_n").alias("n"))
    return rows.select("_row", F.col("_row").getField(text_col).alias("_text"), key.alias("_key"))


#: Groups that `spread_join` broadcasts, at most.
HOT_GROUPS = 10_000


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """`rows` with the columns of `groups`, one row for each key with `size`,
    the number of its rows. Groups of a ten-thousandth of all rows or more, of
    which there can't be more than `HOT_GROUPS`, are broadcast, so that no task
    gets a hot one; the others meet their rows in a shuffle. Both stored."""
    n = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_GROUPS >= n)
    cold = groups.filter(F.col(size) * HOT_GROUPS < n)
    by_task = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(by_task)


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, pieces: int = 1000) -> DataFrame:
    """`rows` with the columns of `table`, one row for each `key`. A key with
    more than a `pieces`-th of the rows is dealt by the hash of `by` into parts
    of that size, and its row of `table` goes to each: no task gets a hot key,
    and no row of `table` is broadcast, however large it is. At most `pieces`
    keys are hot, which bounds both the copies and the broadcast of their
    counts. `rows` stored."""
    share = max(64, math.ceil(rows.count() / pieces))
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def hash60(key: Column) -> Column:
    """60 uniform bits of a key of any type, equal in every SQL engine that
    has md5. Null counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def gapless(df: DataFrame, part: str, order: list[str], out: str, rows_per_block: int = 20_000) -> DataFrame:
    """Number the rows of each `part` from 0 without gaps, by `order`, whose
    first column holds `hash60` values.

    A part may hold any share of the rows: its hash range is cut into blocks
    of about `rows_per_block`, blocks are numbered on their own and the counts
    of the blocks before are added. Rows equal in all of `order` may swap.
    """
    n = df.count()
    blocks = max(1, math.ceil(n / rows_per_block))
    block, rank, same, other, offset = (unused(df, c) for c in ("_block", "_rank", "_part", "_other", "_offset"))
    cut = df.withColumn(block, F.floor(F.col(order[0]) / F.lit(HASH_SPACE / blocks)).cast("long"))
    before = Window.partitionBy(part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(part, block)
        .agg(F.count(F.lit(1)).alias(rank))
        .withColumn(offset, F.coalesce(F.sum(rank).over(before), F.lit(0)))
        .select(F.col(part).alias(same), F.col(block).alias(other), offset)
    )
    inside = Window.partitionBy(part, block).orderBy(*order)
    return (
        cut.withColumn(rank, F.row_number().over(inside).cast("long") - 1)
        .join(offsets, F.col(part).eqNullSafe(F.col(same)) & (F.col(block) == F.col(other)), "left")
        .withColumn(out, F.col(rank) + F.col(offset))
        .drop(block, rank, same, other, offset)
    )


def components(edges: DataFrame) -> DataFrame:
    """`(id, component)` for every id in `edges(a, b)`: the smallest id that it
    reaches. Alternating large-star and small-star steps, each a min per node
    and a salted join back, so a hub of any degree is pre-aggregated and split.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    while not _are_stars(now):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.unionByName(up).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(up, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "cc")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            salted_join(large, lower, "a", "b")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        )
        now = stored(small.filter("a <> b").distinct(), "cc")
    rows = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("a")).distinct().withColumn("component", F.col("a"))
    return rows.unionByName(roots).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    n = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return n.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()
