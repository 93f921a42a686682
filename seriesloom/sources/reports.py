"""Reports of target predictors, turned into site intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the aligner report: what starts a target, a scan and a hit line.
TARGET_START = "Read Sequence:"
SCAN_START = "Performing Scan"
HIT_START = ">ID"


def _synthetic_id(name: Column) -> Column:
    return F.format_string("%s_%s:%d-%d", name, F.col("seq"), F.col("start"), F.col("end"))


def parse_aligner_blocks(blocks: DataFrame, min_length: int = 6, min_percent: float = 80.0, column: str = "value") -> DataFrame:
    """Site intervals from the report text of one target per row (cut at ``Read Sequence:``).

    The target line names exon, gene and place; a scan line names the token that the
    following hit lines belong to.  A hit is kept if it is longer than ``min_length`` and
    its identity exceeds ``min_percent``.  Cutting at targets keeps each header with its
    hits, so no header is carried between rows.
    """
    head = F.substring_index(F.col(column), "\n", 1)
    place = r"([^;:\s]+):([+-]):(\d+)-(\d+)\("
    target = blocks.select(
        F.regexp_extract(head, r'exon_number "?([^";]+)"?', 1).alias("exon_number"),
        F.regexp_extract(head, r'exon_status "?([^";]+)"?', 1).alias("exon_status"),
        F.regexp_extract(head, r'gene_id "?([^";]+)"?', 1).alias("target"),
        F.regexp_extract(head, place, 1).alias("seq"),
        F.regexp_extract(head, place, 2).alias("strand"),
        F.regexp_extract(head, place, 3).alias("target_start"),
        F.col(column).alias("text"),
    ).filter(F.col("target_start") != "")
    scans = target.select("*", F.explode(F.split("text", SCAN_START)).alias("scan")).drop("text")
    token = F.regexp_extract("scan", r"Name=([^;]+);", 1)
    lines = scans.select("*", token.alias("token"), F.explode(F.split("scan", "\n")).alias("line")).drop("scan")
    f = F.split("line", "\t")
    hits = lines.filter(F.col("line").startswith(HIT_START)).select("*", f.alias("f"))
    span = F.split(F.col("f")[4], " ")
    length = span[1].cast("long") - span[0].cast("long")
    start = F.split(F.col("f")[5], " ")[0].cast("long") + F.col("target_start").cast("long")
    out = hits.select(
        "seq", start.alias("start"), (start + length).alias("end"), "strand", "target", "token",
        F.regexp_replace(F.element_at("f", -1), "%", "").cast("double").alias("align_pc"),
        "exon_number", "exon_status", length.alias("_len"),
    )
    out = out.filter((F.col("_len") > min_length) & (F.col("align_pc") > min_percent)).drop("_len")
    return out.withColumns({"gene_id": _synthetic_id(F.col("token")), "transcript_id": _synthetic_id(F.col("target"))})


def read_aligner_report(spark: SparkSession, path: str, min_length: int = 6, min_percent: float = 80.0) -> DataFrame:
    blocks = spark.read.option("lineSep", TARGET_START).text(path)
    return parse_aligner_blocks(blocks, min_length, min_percent)


def first_exon(targets: DataFrame) -> DataFrame:
    """One row per transcript: its first exon."""
    names = [c for c in targets.columns if c != "transcript_id"]
    best = F.min(F.struct("start", *[c for c in names if c != "start"])).alias("_t")
    return targets.groupBy("transcript_id").agg(best).select("transcript_id", *[F.col(f"_t.{c}").alias(c) for c in names])


def place_site_report(report: DataFrame, targets: DataFrame, token_prefix: str = "") -> DataFrame:
    """Site report rows (target, token, rel_start, rel_end, seed_class) placed on their targets.

    ``targets`` has transcript_id, seq, start, source, strand, exon_number, exon_status.
    """
    located = first_exon(targets).withColumnRenamed("transcript_id", "target").withColumnRenamed("start", "_t0").drop("end")
    joined = report.join(located, "target")
    start = F.col("_t0") + F.col("rel_start")
    out = joined.select(
        "seq", start.alias("start"), (start + F.col("rel_end") - F.col("rel_start")).alias("end"), "source", "strand",
        "target", F.concat(F.lit(token_prefix), F.col("token")).alias("token"),
        F.coalesce("exon_number", F.lit(".")).alias("exon_number"),
        F.when(F.col("source") == "protein_coding", "protein_coding").otherwise(F.coalesce("exon_status", F.lit("."))).alias("exon_status"),
        "seed_class",
    )
    return out.withColumns({"gene_id": _synthetic_id(F.col("token")), "transcript_id": _synthetic_id(F.col("target"))})


def read_site_report(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated report with a header; columns 0, 1, 3, 4 and 8 are used."""
    schema = "target string, token string, c2 string, rel_start long, rel_end long, c5 string, c6 string, c7 string, seed_class string"
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(F.regexp_replace("target", '"', "").alias("target"), "token", "rel_start", "rel_end", "seed_class")
