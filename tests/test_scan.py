"""Chunked scans, as-of scans, quantiles and salted joins against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.scan import asof_running, exact_quantiles, global_row_number, running
from seriesloom.operators.skew import salted_join


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("chunks", [None, 1, 3, 7])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_matches_plain_scan(spark, chunks, reverse, inclusive):
    rng = random.Random(1)
    data = [(k, p, rng.randint(-5, 9)) for k, n in (("hot", 60), ("cold", 5), ("one", 1)) for p in rng.sample(range(100), n)]
    df = spark.createDataFrame(data, "k string, p long, v long")
    got = running(
        df, ["k"], "p", {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))},
        reverse=reverse, inclusive=inclusive, chunks=chunks,
    )
    want = []
    for k in ("hot", "cold", "one"):
        seq = sorted([d for d in data if d[0] == k], key=lambda d: d[1], reverse=reverse)
        for i, d in enumerate(seq):
            seen = [x[2] for x in seq[: i + 1 if inclusive else i]]
            want.append((*d, sum(seen), max(seen, default=None), min(seen, default=None)))
    assert rows(got, "k", "p") == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("chunks", [None, 5])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("reverse", [False, True])
def test_asof_running_counts_steps_up_to_point(spark, chunks, inclusive, reverse):
    rng = random.Random(2)
    steps = [("a", rng.randint(0, 20), rng.randint(1, 9)) for _ in range(40)]
    points = [(i, "a" if i < 30 else "b", rng.randint(-2, 22)) for i in range(35)]
    got = asof_running(
        spark.createDataFrame(points, "id int, k string, x long"),
        spark.createDataFrame(steps, "k string, p long, v long"),
        ["k"], "x", "p", {"s": ("sum", F.col("v"))}, inclusive, reverse, chunks,
    )

    def hit(p, x):
        return (p >= x if inclusive else p > x) if reverse else (p <= x if inclusive else p < x)

    want = {i: sum(v for k2, p, v in steps if k2 == k and hit(p, x)) for i, k, x in points}
    assert {r["id"]: r["s"] or 0 for r in got.collect()} == want


@pytest.mark.parametrize("chunks", [None, 4])
def test_global_row_number(spark, chunks):
    data = [(i % 7, i) for i in range(50)]
    got = global_row_number(spark.createDataFrame(data, "x int, id int"), ["x", "id"], "rn", chunks)
    assert [r["rn"] for r in got.orderBy("x", "id").collect()] == list(range(1, 51))


@pytest.mark.parametrize("chunks", [None, 6])
def test_exact_quantiles_match_numpy(spark, chunks):
    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.integers(0, 8, 101)] + [("b", float(v)) for v in rng.normal(size=10)]
    got = exact_quantiles(
        spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"q1": 0.25, "q5": 0.5, "q9": 0.9}, chunks
    )
    for r in got.collect():
        vals = [v for k, v in data if k == r["k"]]
        assert [r["q1"], r["q5"], r["q9"]] == pytest.approx(list(np.quantile(vals, [0.25, 0.5, 0.9])))
        assert r["n"] == len(vals)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("counted", [False, True])
def test_salted_join_equals_plain_join(spark, how, counted):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 9}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k5", 4)], "k string, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n")) if counted else None
    got = salted_join(left, right, "k", how, salts=4, key_counts=counts)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_null_and_hot_keys_are_groups_like_others(spark, chunks):
    data = [(None, i) for i in range(30)] + [("hot", i) for i in range(200)] + [("a", 3)]
    df = spark.createDataFrame(data, "k string, x int")
    got = running(df, ["k"], "x", {"s": ("sum", F.lit(1))}, chunks=chunks).collect()
    assert len(got) == len(data) and all(r["s"] == (1 if r["k"] == "a" else r["x"] + 1) for r in got)
    found = exact_quantiles(df, ["k"], "x", {"m": 0.5}, chunks).collect()
    assert {r["k"]: (r["n"], r["m"]) for r in found} == {None: (30, 14.5), "hot": (200, 99.5), "a": (1, 3.0)}
    numbered = global_row_number(df.withColumn("o", F.coalesce("k", F.lit(""))), ["x", "o"], "rn", chunks).collect()
    assert sorted(r["rn"] for r in numbered) == list(range(1, len(data) + 1))


def test_salted_join_of_nulls_and_bare_keys(spark):
    left = spark.createDataFrame([("h",)] * 90 + [(None,), ("x",)], "k string")
    right = spark.createDataFrame([("h", 1), (None, 2)], "k string, w int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    for meets, nulls in ((True, 2), (False, None)):
        got = salted_join(left, right, "k", "left", key_counts=counts, nulls_meet=meets).collect()
        assert len(got) == 92 and sum(r["w"] == 1 for r in got) == 90
        assert [r["w"] for r in got if r["k"] is None] == [nulls]
