"""Delimited tables, id lists and the table store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated table with a header, ``#`` comments skipped, gzip by suffix, declared types."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("comment", "#").csv(path)


def read_headerless(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", False).csv(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def write_tsv(df: DataFrame, path: str, compress: bool = True, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option(
        "compression", "gzip" if compress else "none"
    ).csv(path)


def write_id_list(df: DataFrame, path: str, column: str = "id") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Typed Parquet table; the key column stays an ordinary column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_name() -> Column:
    """Last part of the path a row was read from."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -1)


def with_file_metadata(df: DataFrame, pattern: str, names: Sequence[str], name: Column | None = None) -> DataFrame:
    """Columns taken from the file name by the groups of a pattern."""
    source = file_name() if name is None else name
    return df.withColumns({n: F.regexp_extract(source, pattern, i + 1) for i, n in enumerate(names)})


def combine_tables(long: DataFrame, key: str, sample: str, value: str, samples: Sequence[str]) -> DataFrame:
    """One column per sample, outer on the key; the first value per cell in value order is kept."""
    return long.groupBy(key).agg(*[F.min(F.when(F.col(sample) == s, F.col(value))).alias(s) for s in samples])


def read_skip_preamble(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """Drop the first ``skip`` lines of each file and read the rest under a fixed header.

    A line's place in its file is its place in its split and the lines of the splits before, so a
    preamble may reach over any number of splits.  Only splits that begin within it are looked at
    line by line.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
        F.monotonically_increasing_id().alias("i"),
    )
    # One row per split; the lines of a split have consecutive numbers.
    splits = lines.groupBy("f", "s").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    held = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("before") < skip)
    kept = lines.join(held.select("f", "s", "first", "before"), ["f", "s"], "left").filter(
        F.col("first").isNull() | (F.col("before") + F.col("i") - F.col("first") >= skip)
    )
    return kept.select(F.from_csv("value", schema, {"sep": "\t"}).alias("r")).select("r.*")
