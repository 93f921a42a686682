"""Sequence text: FASTA records and alignment blocks.

Records are cut by Spark's own line separator, so a record never spans tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fasta_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Records cut at ``\\n>`` to (id, piece) beside their other columns; sequence lines are joined."""
    text = F.regexp_replace(F.col(column), "^>", "")
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    rest = [c for c in records.columns if c != column]
    return records.filter(F.trim(column) != "").select(
        F.trim(F.substring_index(text, "\n", 1)).alias("id"), F.regexp_replace(body, r"\s", "").alias("piece"), *rest
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, place): ``place`` orders the pieces of one id by file and position."""
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", order.alias("place"))
    return parse_fasta_records(rows)


def splice(pieces: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """Concatenate the pieces of one record in order; a record's own pieces are few."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(piece))))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p[piece]), "").alias("sequence"))


def target_table(sequences: DataFrame, taxon: int) -> DataFrame:
    """(id, taxon, sequence) rows."""
    return sequences.select("id", F.lit(taxon).alias("taxon"), "sequence")


def parse_maf_blocks(blocks: DataFrame, species: Sequence[str], column: str = "value") -> DataFrame:
    """One row per sequence line of the wanted species, gaps removed, with its block's score."""
    lines = F.split(F.col(column), "\n")
    # Attribute lines look like: a score=12.0
    scored = blocks.select(
        F.regexp_extract(column, r"(?m)^a\s+(?:.*\s)?score=(\S+)", 1).alias("score_text"), F.explode(lines).alias("line")
    )
    f = F.split(F.col("line"), r"\s+")
    rows = scored.filter(F.col("line").rlike(r"^s\s")).select("score_text", f.alias("f"))
    return (
        rows.select(
            F.substring_index(F.col("f")[1], ".", 1).alias("species"),
            F.regexp_extract(F.col("f")[1], r"^[^.]*\.([^.]*)", 1).alias("src"),
            F.col("f")[2].cast("long").alias("start"),
            F.col("f")[3].cast("long").alias("size"),
            F.col("f")[4].alias("strand"),
            F.regexp_replace(F.col("f")[6], "-", "").alias("sequence"),
            F.col("score_text").cast("double").alias("score"),
        )
        .filter(F.col("species").isin(*species))
    )


def read_maf(spark: SparkSession, path: str, species: Sequence[str]) -> DataFrame:
    return parse_maf_blocks(spark.read.option("lineSep", "\n\n").text(path), species)


def block_scores(rows: DataFrame, reference: str) -> DataFrame:
    """Scores of the reference species as BED rows."""
    return rows.filter(F.col("species") == reference).select(
        F.col("src").alias("seq"), "start", (F.col("start") + F.col("size") - 1).alias("end"), "score"
    )
