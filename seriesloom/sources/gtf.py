"""Interval records as GTF / BED text.  Coordinates are half-open inside, 1-based closed in GTF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_attributes(col: Column) -> Column:
    """``key "value"; key value;`` to a map."""
    pairs = F.filter(F.split(col, r"\s*;\s*"), lambda p: F.trim(p) != "")
    entry = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(F.trim(p), " ", 1).alias("key"),
            F.regexp_replace(F.regexp_replace(F.trim(p), r"^\S+\s*", ""), '"', "").alias("value"),
        ),
    )
    return F.map_from_entries(entry)


def parse_gtf(lines: DataFrame, column: str = "value") -> DataFrame:
    """GTF lines to typed intervals with an attribute map; ``#`` lines are dropped."""
    f = F.split(F.col(column), "\t")
    rows = lines.filter(~F.col(column).startswith("#") & (F.trim(column) != "")).select(f.alias("f"))
    attrs = parse_attributes(F.col("f")[8])
    return rows.select(
        F.col("f")[0].alias("seq"),
        F.col("f")[1].alias("source"),
        F.col("f")[2].alias("feature"),
        (F.col("f")[3].cast("long") - 1).alias("start"),
        F.col("f")[4].cast("long").alias("end"),
        F.col("f")[6].alias("strand"),
        attrs.alias("attrs"),
    ).withColumns({"gene_id": F.col("attrs").getItem("gene_id"), "transcript_id": F.col("attrs").getItem("transcript_id")})


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def format_gtf(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Intervals to GTF lines; ``attributes`` names the columns written as attributes."""
    attrs = F.concat_ws(" ", *[F.concat(F.lit(f'{a} "'), F.col(a).cast("string"), F.lit('";')) for a in attributes])
    return df.select(
        F.concat_ws(
            "\t", "seq", "source", "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
            F.lit("."), "strand", F.lit("."), attrs,
        ).alias("value")
    )


def write_gtf(df: DataFrame, path: str, attributes: list[str], compress: bool = True) -> None:
    format_gtf(df, attributes).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


# Fixed value: a peak id reads chr:start..end,strand
PEAK_ID = r"^([^:]+):(\d+)\.\.(\d+),([+-])"


def parse_peak_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """BED6 rows from peak ids in the first field; comment and non-chromosome lines are dropped."""
    first = F.substring_index(F.col(column), "\t", 1)
    rows = lines.filter(~F.col(column).startswith("##")).select(first.alias("name")).filter(F.col("name").rlike(PEAK_ID))
    part = {n: F.regexp_extract("name", PEAK_ID, i + 1) for i, n in enumerate(["seq", "start", "end", "strand"])}
    return rows.select(
        part["seq"].alias("seq"),
        part["start"].cast("long").alias("start"),
        part["end"].cast("long").alias("end"),
        F.col("name"),
        F.lit(0).alias("score"),
        part["strand"].alias("strand"),
    )
