"""Release tables as sources and sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def with_optional(df: DataFrame, strings: Sequence[str] = (), renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Columns that come and go between releases: a missing string is a typed
    null, a renamed column gets its usual name; missing numbers stay out."""
    for old, new in (renamed or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for c in strings:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def load_lookup(spark: SparkSession, path: str, schema: str, names: Mapping[str, str]) -> DataFrame:
    """CSV with a header, projected and renamed (file's name -> ours)."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def write_mart(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_release(tables: Mapping[str, DataFrame], directory: str) -> None:
    for name, df in tables.items():
        write_mart(df, f"{directory}/{name}.parquet")


def slim_release(tables: Mapping[str, DataFrame], keep: Sequence[str], drop: Mapping[str, Sequence[str]]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Kept tables without their wide columns, and what was given up as
    (what, detail) rows, for the release's own metadata."""
    lost = [("table", n) for n in tables if n not in keep]
    lost += [("column", f"{n}.{c}") for n in keep if n in tables for c in drop.get(n, ()) if c in tables[n].columns]
    return {n: tables[n].drop(*drop.get(n, ())) for n in keep if n in tables}, sorted(lost)


# Functional categories of regions that hitchhike.
HITCHHIKERS = ("PE/PPE", "insertion seqs and phages")


def gff_fields(value: Column) -> dict[str, Column]:
    """Columns of one annotation line: nine by tab, the last a key=value map."""
    part = F.split(value, "\t")
    attr = F.str_to_map(F.get(part, F.lit(8)), F.lit(";"), F.lit("="))
    return {
        "feature_type": F.get(part, F.lit(2)),
        "start": F.get(part, F.lit(3)).cast("int"),
        "end": F.get(part, F.lit(4)).cast("int"),
        "strand": F.get(part, F.lit(6)),
        "locus": attr["Locus"],
        "gene": F.coalesce(attr["Name"], attr["Locus"]),
        "functional_category": attr["Functional_Category"],
        "is_pseudogene": F.coalesce(F.lower(attr["Is_Pseudogene"]) == "yes", F.lit(False)),
        "essential_hint": F.concat_ws(" ", attr["Product"], attr["Comments"]).rlike(r"(?i)\bessential\b"),
        "is_hitchhiker_region": F.coalesce(attr["Functional_Category"].isin(*HITCHHIKERS), F.lit(False)),
        "drug_resistance": F.coalesce(attr["Drug Resistance Mutations"], F.lit("")),
        "pfam": F.coalesce(attr["PFAM"], F.lit("")),
    }


def parse_gff(lines: DataFrame, column: str = "value") -> DataFrame:
    v = F.col(column)
    good = (v != "") & ~v.startswith("#") & (F.size(F.split(v, "\t")) >= 9)
    return lines.filter(good).select(*[c.alias(n) for n, c in gff_fields(v).items()])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def parse_bed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Half-open spans from 0 as spans from 1, ends included."""
    part = F.split(F.col(column), r"\s+")
    good = ~F.col(column).rlike("^(#|track|browser)") & (F.size(part) >= 3)
    return lines.filter(good).select((F.get(part, F.lit(1)).cast("int") + 1).alias("start"), F.get(part, F.lit(2)).cast("int").alias("end"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def verify_files(found: DataFrame, expected: DataFrame, optional: Sequence[str] = ()) -> DataFrame:
    """`found(name, size, sha256)` against `expected(name, size)`: a status for
    each name. A file may be there under its name with `.gz`."""
    here = found.select(F.regexp_replace("name", r"\.gz$", "").alias("name"), F.col("size").alias("found_size"), "sha256", F.col("name").endswith(".gz").alias("is_gz"))
    both = expected.join(here, "name", "full_outer")
    status = (
        F.when(F.col("found_size").isNull(), F.when(F.col("name").isin(list(optional)), "optional").otherwise("missing"))
        .when(F.col("size").isNull(), "unexpected")
        .when(~F.col("is_gz") & (F.col("size") != F.col("found_size")), "size differs")
        .otherwise("ok")
    )
    return both.select("name", "size", "found_size", "sha256", status.alias("status"))


def _opened(path: str):
    """A stream of a file's bytes, wherever Arrow's file systems reach."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def file_digests(spark: SparkSession, path: str, chunk: int = 1 << 23) -> DataFrame:
    """Path, name, size and SHA-256 of each file under `path`. A task reads its
    files in chunks, so a file may be of any size; files are dealt over tasks.
    Spark lists no files without content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            found = []
            for name in files["path"]:
                digest = hashlib.sha256()
                with _opened(name) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield files.assign(sha256=found)

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # no content is read
    rows = listed.repartition(F.col("path")).mapInPandas(run, "path string, length long, sha256 string")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "sha256")


def metadata(spark: SparkSession, items: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted((k, str(v)) for k, v in items.items()), "key string, value string")


def table_checksum(df: DataFrame) -> DataFrame:
    """Count and order-free hashes of a table's rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("sum_hash"))
