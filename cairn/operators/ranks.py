"""Row numbers and running sums within groups of any size.

Rows are dealt over tasks by ranges of (group, order) and written with the place
they got. What a group holds in the tasks before is a sum over one row for each
task and group, so a group that has a third of all rows is as many tasks as its
range has, and no plan or broadcast grows with the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import stored

_IN_TASK = 33  #: bits of `monotonically_increasing_id` for the place in a task


def drawn(seed: int, key: str = "uid") -> Column:
    return F.md5(F.concat(F.col(key), F.lit(f"|{seed}")))


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`df`, stored in the order of `by` and `order`, nulls first, with `_at`
    (task and place in it, ascending) and `_task`. Rows equal in all of `by`
    and `order` share a task."""
    keys = [*[F.col(c) for c in by], *order]
    rows = df.repartitionByRange(*keys) if keys else df
    rows = rows.sortWithinPartitions(*keys) if keys else rows
    at = F.monotonically_increasing_id()
    return stored(rows.select("*", at.alias("_at"), F.shiftright(at, _IN_TASK).cast("int").alias("_task")), "ranges")


def _before(rows: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """`rows` of `in_ranges` with `_first`, the group's first place in its
    task, and `_before`, the sum of `amount` over its tasks before."""
    earlier = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*by, "_task").agg(F.min("_at").alias("_first"), F.sum(amount).alias("_sum"))
    heads = heads.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    on = F.col("l._task") == F.col("r._task")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return rows.alias("l").join(heads.alias("r"), on).select("l.*", "r._first", "r._before")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """`df` with `out`: the row's number in its group, from 1, by `order`,
    nulls first; rows that are equal there may swap. `df` is read twice: store
    it where it is dear."""
    rows = _before(in_ranges(df, by, order), by, F.lit(1))
    number = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return rows.withColumn(out, number.cast("long")).drop("_at", "_task", "_first", "_before")


def by_hash(df: DataFrame, by: Sequence[str], seed: int, out: str) -> DataFrame:
    """Numbers in seeded hash order of `uid`, then `uid`."""
    return numbered(df, by, [drawn(seed), F.col("uid")], out)


def running(df: DataFrame, by: Sequence[str], value: str, amount: str, out: str) -> DataFrame:
    """`df` with `out`: the sum of `amount` up to the row in order of `value`,
    rows of the same `value` included."""
    inside = Window.partitionBy(*by, "_task").orderBy(value)
    rows = _before(in_ranges(df, by, [F.col(value)]), by, F.col(amount))
    return rows.withColumn(out, F.sum(amount).over(inside) + F.col("_before")).drop("_at", "_task", "_first", "_before")


def tile(rank: Column, n: Column, tiles: int) -> Column:
    """Which of `tiles` equal parts the `rank`-th of `n` is in: the first parts
    have one more where `n` does not divide."""
    size, more = F.floor(n / tiles), n % tiles
    head = more * (size + 1)
    return F.when(rank <= head, F.ceil(rank / (size + 1))).otherwise(more + F.ceil((rank - head) / F.greatest(size, F.lit(1)))).cast("int")
