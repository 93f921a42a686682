"""Pruned correlation joins: the rows of the full product, for a fraction of its scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import pairs as P
from seriesloom.operators import pruned
from seriesloom.session import materialize

TIMES = list(range(7))


def clustered(spark, clusters=40, each=15, seed=2, key="A", spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 7))
    rows = [(key, f"{key}{k:04d}", t, float(v)) for k in range(clusters * each) for t, v in enumerate(centres[k % clusters] + spread * rng.normal(size=7))]
    rows += [(key, f"{key}flat", t, 1.0) for t in TIMES]
    return spark.createDataFrame(rows, "condition string, entity string, time int, value double")


def values(df):
    return {(r["condition"], r["a"], r["b"]): round(r["value"], 9) for r in df.collect()}


@pytest.mark.parametrize("kind", [{"min_value": 0.9}, {"min_value": -0.8}, {"min_abs": 0.85}])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("method", ["cross", "temporal"])
def test_same_rows_as_the_full_product(spark, monkeypatch, kind, same, method):
    monkeypatch.setattr(pruned, "PART_ROWS", 5)
    df = clustered(spark, 12, 8).unionByName(clustered(spark, 3, 5, 4, "N", 1.0)).unionByName(clustered(spark, 2, 3, 5, "N").withColumn("condition", F.lit(None).cast("string")))
    other = None if same else df.filter(F.substring("entity", 5, 1).isin(*"02468"))
    full = P.pair_corr(df, other, TIMES, method, by=["condition"])
    t = kind.get("min_value", kind.get("min_abs"))
    wanted = F.abs("value") >= t if "min_abs" in kind else F.col("value") >= t if t > 0 else F.col("value") <= t
    found = P.pair_corr(df, other, TIMES, method, by=["condition"], **kind)
    want = values(full.filter(wanted))
    assert values(found) == want and want and found.count() == len(want)


def test_under_a_fifth_of_the_scores_on_clustered_series(spark):
    df = clustered(spark)
    units, n = P.scored_series(df, TIMES)
    units = units.withColumn("_all", F.lit(0))
    _, blocks = pruned.pivot_blocks(units, n, [])
    assert blocks.agg(F.sum("_n")).first()[0] == 600
    guests = pruned.visits(units, blocks, n, [], 0.9, False)
    scored = guests.join(blocks.select("_block", "_n"), "_block").agg(F.sum("_n")).first()[0]
    assert scored < 0.2 * 600 * 600
    plain = units.drop("_all")
    assert pruned.pruned_pairs(plain, plain, n, 0.9).count() == scored


def test_no_rows_and_no_matches(spark):
    df = clustered(spark, 2, 2)
    assert P.pair_corr(df.filter("false"), df, TIMES, min_value=0.9).count() == 0
    assert P.pair_corr(df.filter("false"), None, TIMES, min_abs=0.9).count() == 0


def test_placing_rows_at_pivots_is_dealt_to_tasks(spark):
    rng = np.random.default_rng(3)
    units = rng.normal(size=(6000, 4))
    units -= units.mean(axis=1, keepdims=True)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    # Nearly all rows have one condition, some have none.
    cond = [None if i % 10 == 0 else "A" for i in range(6000)]
    data = [(cond[i], f"e{i}", [float(x) for x in u]) for i, u in enumerate(units)]
    rows = materialize(spark.createDataFrame(data, "condition string, entity string, u array<double>").coalesce(1))
    placed, blocks = pruned.pivot_blocks(rows, 4, ["condition"])
    assert len(placed.inputFiles()) > 1
    assert sorted(r["entity"] for r in placed.select("entity").collect()) == sorted(d[1] for d in data)
    pivots = {r["_block"]: (r["condition"], np.array(r["_pivot"])) for r in blocks.collect()}
    every = {r["entity"]: r["_block"] for r in placed.collect()}
    for c, e, u in data[:40]:
        best = max(float(np.dot(p, u)) for k, p in pivots.values() if k == c)
        assert pivots[every[e]][0] == c and float(np.dot(pivots[every[e]][1], u)) == pytest.approx(best)
