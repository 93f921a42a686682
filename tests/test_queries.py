"""Registered queries: names, schemas, and agreement with their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for n in NAMES.split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def table(pdf):
    cols = sorted(pdf.columns)
    recs = pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()
    return cols, sorted(tuple(canon(v) for v in r) for r in recs)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["condition", "a", "b", "value"]
    assert {r["condition"] for r in df.collect()} == {"A", "N", "R"}


SAMPLE = [
    "xcorr_lag_k", "temporal_corr", "summary_se", "size_factors", "inner_enrich_expr", "shared_tokens", "nearest_feature",
    "stranded_coverage", "empirical_pvalue", "rank_sum_test", "fisher_2x2", "token_enrichment", "trend_test",
    "concordance_metrics", "scan_gtf", "scan_aligner_report", "scan_maf_blocks", "site_count_report", "annotate_pair_list",
    "filter_abs_threshold", "agreement_clusters", "odds_interval",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    got = table(entry.queries()[name](spark, sf).toPandas())
    want = table(con.sql(entry.oracle_sql()[name]).df())
    assert got == want
