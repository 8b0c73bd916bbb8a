"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import HASH_SPACE, gapless, hash60, unused


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """For each shard `struct(score, -shard)`: the largest wins, ties go to the
    lower shard. With u uniform on (0, 1), -w / ln u is largest for shard i
    with probability w_i / sum(w)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        u = (hash60(F.concat(text, F.lit("#"), s["shard"].cast("string"))) + F.lit(0.5)) / F.lit(float(HASH_SPACE))
        return F.struct((-s["w"] / F.log(F.least(u, F.lit(1 - 2.0**-53)))).alias("score"), (-s["shard"]).alias("rank"))

    return F.transform(shards, score)


def rendezvous(df: DataFrame, key: Column, weights: Sequence[float], grown: Sequence[float] = (), out: str = "shard") -> DataFrame:
    """`df` with `out`, the shard of `key` among `weights` (all above 0), and
    `grown_<out>`, its shard once the shards of weight `grown` are added: a
    row keeps its shard or goes to an added one. Null keys act as the empty
    string; equal keys share a shard. Columns of these two names are replaced.
    One projection: nothing is shuffled."""
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("each shard needs a weight above 0")
    n = len(weights)
    scores = unused(df, "_scores")
    scored = df.withColumn(scores, _scores(key, [*weights, *grown]))
    old = F.array_max(F.slice(scores, 1, n))
    return scored.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (out, f"grown_{out}")],
        (-old["rank"]).alias(out),
        (-F.array_max(scores)["rank"]).alias(f"grown_{out}"),
    )


def shard_records(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place of every row in a sharded copy of `docs`: id, `size` (UTF-8 bytes
    of the text, none for null, plus 16), `text_crc32`, `law` = key, `shard`,
    `slot` (from 0 without gaps in each shard, by hash of the id, id, checksum,
    size) and `grown_shard` (with one more shard). Rows that repeat an id share
    its shard. Null ids act as one key. The crc32 of a null text is 0. An empty
    table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hash60(F.col(id_col)).alias("_h"),
    )
    rows = rendezvous(rows, F.col(id_col), [1.0] * n_shards, [1.0])
    rows = gapless(rows, "shard", ["_h", id_col, "text_crc32", "size"], "slot")
    return rows.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
