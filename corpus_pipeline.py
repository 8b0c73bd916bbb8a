"""The corpus pipeline: from `documents` to token counts and digests.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import bpe, exact_dedup, mixing, near_dedup, quality, queries
from cairn.llm.common import stored

#: No SQL: a fitted model decides the first stage. tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a rating above the lowest is 0.5 or more."""
    model = queries.quality_model(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "labels"))
    return quality.filter_docs(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_copies(docs, scanned=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near_dedup.drop_near_copies(docs, scanned=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and rows follow it."""
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document, and
    its `mix_position`: the place that the stage before gave it, from 0."""
    rows = placed(docs).select(F.struct("doc_id", "mix_position").alias("_key"), "text")
    encoded = bpe.digests(bpe.encode_decode(rows, *queries.tokenizer(), id_col="_key"), id_col="_key")
    return encoded.select("_key.doc_id", *encoded.columns[1:], "_key.mix_position")


def placed(docs: DataFrame) -> DataFrame:
    """`docs`, a scan of a stored stage, with `mix_position`: the row's place
    in its file after the rows of the files before. Files are in the order of
    the tasks that wrote them, however the scan packs and splits them. Only
    counts of files meet in one task."""
    name, number = F.col("_metadata.file_name"), F.regexp_extract("_file", r"^part-(\d+)", 1)
    counts = docs.groupBy(name.alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.expr("try_cast(_number AS long)"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_number", number).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = docs.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.join(F.broadcast(firsts), "_file")  # a row for each file
    return rows.withColumn("mix_position", F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written as Parquet and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
