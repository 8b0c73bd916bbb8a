"""Tables of a release that many queries start from, stored once for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.shared import new_path

_HELD: dict[tuple[str, str, str], tuple] = {}


def held(spark: SparkSession, release: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of `release`, made and written to the shared folder at
    its first use in an application and read from there after. A release does
    not change while an application runs."""
    key = (spark.sparkContext.applicationId, release, name)
    if key not in _HELD:
        df, path = make(), new_path(spark, f"release-{name}")
        df.write.parquet(path)
        _HELD[key] = path, df.schema
    path, schema = _HELD[key]
    return spark.read.schema(schema).parquet(path)
