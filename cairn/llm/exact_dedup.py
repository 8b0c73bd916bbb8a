"""Exact deduplication by progressive refinement, DataFrame functions only.

Texts are equal when identical after every run of ASCII white space became
one space. Length splits first, a hash of the opening next, and only groups
that are still not single have their whole text hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import keyed, spread_join, stored

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digests: bool = False) -> DataFrame:
    """One row per row of `docs`: id, `keep_id`, `group_size`, `kept`, and with
    `digests` the `text_sha256` of every normalised text.

    Of equal texts the row with the smallest id stays. Null texts count as
    empty, and empty texts equal each other. Rows that repeat an id within a
    group share its verdict and all count in `group_size`. Null ids lose to
    any other; a group of null ids only has a null `keep_id` and stays.
    Other columns of `docs` are not read. An empty table gives no rows.

    The first scan keeps two numbers a row. (Length, prefix hash) groups are
    counted with partial aggregation, so one group may hold any share of the
    rows; lengths are counted from those. The second scan joins texts to the
    surviving groups and hashes those alone; where the groups fit a broadcast,
    no text moves. With `digests` every text is hashed in the first scan,
    since all hashes are asked for, and there is no second.
    """
    text = normalised(F.col(text_col))
    sizes = [F.octet_length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_pre")]
    whole = F.sha2("_text", 256).alias("_full")
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    sized = stored(texts.select("_id", *sizes, *([whole] if digests else [])), "sized")

    counts = stored(sized.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n")), "counts")
    lengths = counts.groupBy("_len").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_len")
    prefixes = stored(counts.filter("_n > 1").join(lengths, "_len", "left_semi"), "prefixes")
    if digests:
        full = spread_join(sized, prefixes, ["_len", "_pre"], "_n").select("_id", "_len", "_full")
    else:
        full = spread_join(texts.select("_id", "_text", *sizes), prefixes, ["_len", "_pre"], "_n").select("_id", "_len", whole)
    full = stored(full, "full")

    groups = full.groupBy("_len", "_full").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = spread_join(full, stored(groups, "groups"), ["_len", "_full"], "group_size")
    single = sized.join(prefixes, ["_len", "_pre"], "left_anti").select("*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    shown = ["_full"] if digests else []
    out = many.select("_id", "keep_id", "group_size", *shown).unionByName(single.select("_id", "keep_id", "group_size", *shown))
    digest = [F.col("_full").alias("text_sha256")] if digests else []
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *digest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanned: bool = False) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts one
    row, with the smallest id; null ids lose to any other, and of rows equal in
    both any one stays. `scanned`: see `keyed`."""
    rows = keyed(docs, id_col, text_col, scanned)
    gone = exact_dedup(rows, "_key", "_text").filter("not kept").select(F.col("_key.n").alias("_n"))
    return rows.join(gone, rows["_key.n"] == gone["_n"], "left_anti").select("_row.*")
