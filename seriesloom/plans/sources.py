"""Readers and writers, each fed with text that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.plans.bindings import Tables, day_number, rounded, with_
from seriesloom.plans.registry import query
from seriesloom.session import scratch_path
from seriesloom.sources import gtf, reports, sequences, tables


@query("scan_tsv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def scan_tsv(t):
    path = scratch_path(t.spark, "parts-tsv")
    tables.write_tsv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path, compress=False)
    return tables.read_tsv(t.spark, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@query("tsv_sink", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity),4) AS total FROM lineitem GROUP BY 1")
def tsv_sink(t):
    """A gzip table with its key labelled, read back."""
    path = scratch_path(t.spark, "suppliers-tsv")
    out = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    tables.write_tsv(rounded(out, "total", digits=4), path)
    return tables.read_tsv(t.spark, path, "l_suppkey long, n long, total double")


@query("scan_headerless", "SELECT l_partkey AS gene_id, count(*) AS n_sites FROM lineitem GROUP BY 1")
def scan_headerless(t):
    path = scratch_path(t.spark, "counts")
    tables.write_tsv(t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), path, compress=False, header=False)
    return tables.read_headerless(t.spark, path, "gene_id long, n_sites long")


@query("scan_id_list", "SELECT DISTINCT l_partkey::VARCHAR AS id FROM lineitem")
def scan_id_list(t):
    path = scratch_path(t.spark, "ids")
    ids = t.lineitem.select(F.col("l_partkey").cast("string").alias("id")).distinct()
    tables.write_id_list(ids.union(ids.limit(1).select(F.lit("").alias("id"))), path)
    return tables.read_id_list(t.spark, path)


def gtf_rows(t: Tables):
    return t.iv.select(
        "seq", F.lit("events").alias("source"), "feature", "start", "end", "strand",
        F.col("seq").alias("gene_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("transcript_id"),
    )


@query("scan_gtf", with_("iv", "SELECT seq, feature, start, \"end\", strand, seq AS gene_id, 't'||CAST(id AS VARCHAR) AS transcript_id FROM iv"))
def scan_gtf(t):
    path = scratch_path(t.spark, "gtf")
    gtf.write_gtf(gtf_rows(t), path, ["gene_id", "transcript_id"])
    return gtf.read_gtf(t.spark, path).select("seq", "feature", "start", "end", "strand", "gene_id", "transcript_id")


@query(
    "gtf_sink",
    with_(
        "iv",
        """SELECT concat_ws(chr(9), seq, 'events', feature, CAST(start+1 AS VARCHAR), CAST("end" AS VARCHAR), '.', strand, '.',
           'gene_id "'||seq||'"; transcript_id "t'||CAST(id AS VARCHAR)||'";') AS value FROM iv""",
    ),
)
def gtf_sink(t):
    path = scratch_path(t.spark, "gtf-lines")
    gtf.write_gtf(gtf_rows(t), path, ["gene_id", "transcript_id"])
    return t.spark.read.text(path)


@query(
    "scan_peak_ids",
    with_("iv", "SELECT seq, start, \"end\", seq||':'||start||'..'||\"end\"||','||strand AS name, 0 AS score, strand FROM iv"),
)
def scan_peak_ids(t):
    name = F.format_string("%s:%d..%d,%s", "seq", "start", "end", "strand")
    lines = t.iv.select(F.concat_ws("\t", name, F.col("value").cast("string")).alias("value"))
    path = scratch_path(t.spark, "peaks")
    lines.union(lines.limit(1).select(F.lit("##ColumnVariables").alias("value"))).write.text(path)
    return gtf.parse_peak_ids(t.spark.read.text(path))


def fasta(t: Tables):
    """Letters of every document as one FASTA record each, lines kept."""
    body = F.regexp_replace("text", r"[^A-Za-z\n]", "")
    records = t.table("documents").select(F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"), body).alias("value"))
    path = scratch_path(t.spark, "fasta")
    records.write.text(path)
    pieces = sequences.read_fasta(t.spark, path)
    return sequences.splice(pieces, "id", "place", "piece")


SEQ = "regexp_replace(text,'[^A-Za-z]','','g')"


@query("scan_fasta_spliced", f"SELECT 'doc'||CAST(doc_id AS VARCHAR) AS id, length({SEQ}) AS n, md5({SEQ}) AS digest FROM documents")
def scan_fasta_spliced(t):
    return fasta(t).select("id", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


@query("fasta_to_target_table", f"SELECT 'doc'||CAST(doc_id AS VARCHAR) AS id, 10090 AS taxon, md5({SEQ}) AS digest FROM documents")
def fasta_to_target_table(t):
    return sequences.target_table(fasta(t), 10090).select("id", "taxon", F.md5("sequence").alias("digest"))


@query("ordered_splice", "SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS sequence FROM lineitem GROUP BY 1")
def ordered_splice(t):
    pieces = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").cast("string").alias("piece"))
    return sequences.splice(pieces, "id", "l_linenumber", "piece")


def maf_rows(t: Tables):
    """One alignment block per order, one sequence line per line item."""
    species = F.when(F.col("l_returnflag") == "A", "mm10").when(F.col("l_returnflag") == "N", "hg19").otherwise("rn5")
    line = F.concat_ws(
        " ", F.lit("s"), F.concat(species, F.lit(".chr"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"),
        F.col("l_quantity").cast("long").cast("string"), F.lit("+"), F.lit("100000"), F.expr("repeat('AC-G', l_linenumber)"),
    )
    blocks = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    text = F.concat(F.lit("a score="), F.col("l_orderkey").cast("string"), F.lit(".0\n"), F.col("lines"), F.lit("\n"))
    path = scratch_path(t.spark, "maf")
    blocks.select(text.alias("value")).write.text(path)
    return sequences.read_maf(t.spark, path, ["mm10", "hg19"])


MAF = """SELECT CASE l_returnflag WHEN 'A' THEN 'mm10' ELSE 'hg19' END AS species, 'chr'||CAST(l_suppkey AS VARCHAR) AS src, l_partkey AS start,
   CAST(l_quantity AS BIGINT) AS size, '+' AS strand, repeat('ACG', l_linenumber) AS sequence, l_orderkey::DOUBLE AS score FROM lineitem WHERE l_returnflag<>'R'"""


@query("scan_maf_blocks", MAF)
def scan_maf_blocks(t):
    return maf_rows(t)


@query("maf_block_scores", f"SELECT src AS seq, start, start+size-1 AS \"end\", score FROM ({MAF}) WHERE species='mm10'")
def maf_block_scores(t):
    return sequences.block_scores(maf_rows(t), "mm10")


def target_orders(t: Tables):
    """Orders as two-exon targets on one sequence per priority."""
    o = t.table("orders")
    exon = F.inline(
        F.array(
            F.struct(F.lit("1").alias("exon_number"), F.lit(0).alias("shift")),
            F.struct(F.lit("2").alias("exon_number"), F.lit(500).alias("shift")),
        )
    )
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("transcript_id"), F.substring("o_orderpriority", 3, 20).alias("seq"),
        day_number("o_orderdate").alias("d"), F.when(F.col("o_orderstatus") == "F", "protein_coding").otherwise("intergenic").alias("source"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise("m").alias("exon_status"), exon,
    )
    start = F.col("d") + F.col("shift")
    return rows.select(
        "transcript_id", "seq", start.alias("start"), (start + 100).alias("end"), "source", F.lit("+").alias("strand"), "exon_number", "exon_status"
    )


def site_report(t: Tables):
    """The predictor's report of all lines, written and placed on the targets."""
    path = scratch_path(t.spark, "site-report")
    cols = [
        F.col("l_orderkey").cast("string").alias("target"), F.col("l_partkey").cast("string").alias("token"), F.lit("x").alias("c2"),
        F.col("l_linenumber").alias("rel_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("rel_end"),
        F.lit("x").alias("c5"), F.lit("x").alias("c6"), F.lit("x").alias("c7"), F.col("l_returnflag").alias("seed_class"),
    ]
    tables.write_tsv(t.lineitem.select(*cols), path)
    return reports.place_site_report(reports.read_site_report(t.spark, path), target_orders(t), "mmu-")


PLACED = """SELECT substr(o_orderpriority,3,20) AS seq, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)+l_linenumber AS start,
   CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)+l_linenumber+CAST(l_quantity AS BIGINT) AS "end", 'mmu-'||l_partkey AS token, CAST(l_orderkey AS VARCHAR) AS target,
   CASE WHEN o_orderstatus='F' THEN 'protein_coding' WHEN o_orderstatus='P' THEN '.' ELSE 'm' END AS exon_status, l_returnflag AS seed_class FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""


@query(
    "scan_site_report",
    f"""SELECT seq, start, "end", token, target, '1' AS exon_number, exon_status, seed_class, token||'_'||seq||':'||start||'-'||"end" AS gene_id FROM ({PLACED})""",
)
def scan_site_report(t):
    return site_report(t).select("seq", "start", "end", "token", "target", "exon_number", "exon_status", "seed_class", "gene_id")


@query(
    "scan_aligner_report",
    """SELECT 'chr'||substr(o_orderpriority,1,1) AS seq, s AS start, s+q AS "end", '+' AS strand, 'g'||o_orderkey AS target, 'tok'||l_partkey AS token,
       pc::DOUBLE AS align_pc, '1' AS exon_number, 'm' AS exon_status, 'tok'||l_partkey||'_chr'||substr(o_orderpriority,1,1)||':'||s||'-'||(s+q) AS gene_id
       FROM (SELECT *, 1000+o_orderkey+l_linenumber AS s, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*1000) AS BIGINT) AS pc FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
       WHERE q>6 AND pc>60""",
)
def scan_aligner_report(t):
    """An aligner's report with one target per order and one scan per line."""
    rows = t.lineitem.join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    token = F.concat(F.lit("tok"), F.col("l_partkey").cast("string"))
    scan = F.concat(F.lit("Performing Scan: ID="), token, F.lit(";Alias=x;Name="), token, F.lit(";Derives_from=y vs g\n=-=-=-=\n"))
    hit = F.concat_ws(
        "\t", F.concat(F.lit(">ID="), token), F.lit("g"), F.lit("150.0"), F.lit("-20.0"),
        F.concat(F.lit("0 "), F.col("l_quantity").cast("long").cast("string")), F.concat(F.col("l_linenumber").cast("string"), F.lit(" 99")),
        F.lit("12"), F.concat(F.round(F.col("l_discount") * 1000).cast("long").cast("string"), F.lit("%")),
    )
    order = F.col("o_orderkey").cast("string")
    head = F.concat(
        F.lit('Read Sequence:exon_number "1"; exon_status "m"; exon_locus "m"; gene_id "g'), order, F.lit('"; transcript_id "t'), order,
        F.lit('"; chr'), F.substring("o_orderpriority", 1, 1), F.lit(":+:"), (F.col("o_orderkey") + 1000).cast("string"), F.lit("-9999999(100 nt)\n"),
    )
    blocks = rows.groupBy("o_orderkey", "o_orderpriority").agg(F.array_join(F.collect_list(F.concat(scan, hit)), "\n").alias("body"))
    path = scratch_path(t.spark, "aligner")
    blocks.select(F.concat(head, F.col("body")).alias("value")).write.text(path)
    return reports.read_aligner_report(t.spark, path, 6, 60.0).select(
        "seq", "start", "end", "strand", "target", "token", "align_pc", "exon_number", "exon_status", "gene_id"
    )


@query("table_sink", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),4) AS qty FROM lineitem GROUP BY 1,2")
def table_sink(t):
    path = scratch_path(t.spark, "lines")
    out = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    tables.write_table(rounded(out, "qty", digits=4), path, ["l_returnflag"])
    return tables.read_table(t.spark, path).select("l_returnflag", "l_linestatus", "n", "qty")


@query("table_scan", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE s_acctbal>5000")
def table_scan(t):
    """A stored table scanned with a pushed filter, joined to its dimension."""
    path = scratch_path(t.spark, "suppliers")
    tables.write_table(t.table("supplier"), path)
    rich = tables.read_table(t.spark, path).filter("s_acctbal > 5000")
    return rich.join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("file_metadata", "SELECT l_returnflag AS condition, l_linenumber AS replicate, count(*) AS n FROM lineitem GROUP BY 1,2")
def file_metadata(t):
    """One table per condition; the condition comes back from the path."""
    base = scratch_path(t.spark, "conditions")
    per = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    for c in ("A", "N", "R"):
        tables.write_tsv(per.filter(F.col("l_returnflag") == c).drop("l_returnflag"), f"{base}/{c}-time.tsv")
    rows = t.spark.read.schema("replicate int, n long").option("sep", "\t").option("header", True).csv(f"{base}/*-time.tsv")
    named = tables.with_file_metadata(
        rows.select("*", F.col("_metadata.file_path").alias("_p")), r"/([^/-]+)-time\.tsv/", ["condition"], F.col("_p")
    )
    return named.select("condition", "replicate", "n")


SAMPLES = ["A", "N", "R"]


@query(
    "combine_tables",
    "SELECT l_partkey AS gene, " + ", ".join(f"round(max(CASE WHEN l_returnflag='{s}' THEN v END),4) AS \"{s}\"" for s in SAMPLES)
    + " FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2) GROUP BY 1",
)
def combine_tables(t):
    long = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    out = tables.combine_tables(long.withColumnRenamed("l_partkey", "gene"), "gene", "l_returnflag", "v", SAMPLES)
    return rounded(out, *SAMPLES, digits=4)


@query(
    "scan_skip_preamble",
    "SELECT p_brand AS Name, CAST(sum(p_size) AS DOUBLE) AS Length, CAST(sum(p_size)-1 AS DOUBLE) AS EffectiveLength, round(round(avg(p_retailprice),9),4) AS TPM, CAST(count(*) AS DOUBLE) AS NumReads FROM part GROUP BY 1",
)
def scan_skip_preamble(t):
    """A quantifier's report: twelve comment lines, then headerless rows."""
    per = t.part.groupBy("p_brand").agg(F.sum("p_size").alias("l"), F.round(F.round(F.avg("p_retailprice"), 9), 4).alias("tpm"), F.count(F.lit(1)).alias("n"))
    lines = per.select(F.concat_ws("\t", "p_brand", F.col("l").cast("string"), (F.col("l") - 1).cast("string"), F.col("tpm").cast("string"), F.col("n").cast("string")).alias("value"))
    preamble = t.spark.range(0, 12, 1, 1).select(F.concat(F.lit("# comment\t"), F.col("id").cast("string")).alias("value"))
    path = scratch_path(t.spark, "quant")
    # One short file: the preamble and a line per brand.
    both = preamble.withColumn("k", F.lit(0)).union(lines.withColumn("k", F.lit(1)))
    both.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return tables.read_skip_preamble(
        t.spark, path, 12, "Name string, Length double, EffectiveLength double, TPM double, NumReads double"
    )


