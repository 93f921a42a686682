"""Conditional odds ratios against literal values and against sums over all counts."""

import math
import random

import pytest

from seriesloom.operators.odds import conditional_odds, odds_interval


def chances(a, b, c, d, w):
    row, column, total = a + b, a + c, a + b + c + d
    ks = range(max(0, row + column - total), min(row, column) + 1)
    logs = [math.log(math.comb(row, k)) + math.log(math.comb(total - row, column - k)) + k * math.log(w) for k in ks]
    p = [math.exp(v - max(logs)) for v in logs]
    return {k: v / sum(p) for k, v in zip(ks, p)}


def test_tea_tasting():
    """The published results of the tea-tasting and the twins' tables, whose roots were searched to about 1.2e-4."""
    assert conditional_odds(3, 1, 1, 3, 0.95, "greater") == pytest.approx((6.408309, 0.3135693, math.inf), rel=1e-4)
    assert conditional_odds(2, 10, 15, 3, 0.95, "two-sided") == pytest.approx((0.04693661, 0.003325764, 0.3631823), abs=1.3e-4)


def test_roots_meet_their_definitions():
    rng = random.Random(4)
    for _ in range(150):
        t = [rng.choice([0, 1, 3, 20, 150]) + rng.randrange(4) for _ in range(4)]
        a = t[0]
        estimate, low, high = conditional_odds(*t, 0.9, "two-sided")
        least, most = max(0, t[0] - t[3]), t[0] + min(t[1], t[2])
        if least == most:
            assert (estimate, low, high) == (None, 0.0, math.inf)
            continue
        if least < a < most:
            assert sum(k * p for k, p in chances(*t, estimate).items()) == pytest.approx(a, rel=1e-9)
        else:
            assert estimate == (0.0 if a == least else math.inf)
        assert low == 0.0 if a == least else sum(p for k, p in chances(*t, low).items() if k >= a) == pytest.approx(0.05, rel=1e-7)
        assert high == math.inf if a == most else sum(p for k, p in chances(*t, high).items() if k <= a) == pytest.approx(0.05, rel=1e-7)


def test_large_counts_tend_to_the_sample_ratio():
    estimate, low, high = conditional_odds(3 * 10**8, 10**8, 10**8, 3 * 10**8, 0.95, "two-sided")
    assert estimate == pytest.approx(9.0, rel=1e-8)  # apart by the order of 1 over the counts
    spread = 1.959964 * math.sqrt(2 / 3e8 + 2 / 1e8)
    assert math.log(high / 9) == pytest.approx(spread, rel=1e-3) and math.log(9 / low) == pytest.approx(spread, rel=1e-3)
    assert conditional_odds(1, 10**9, 10**9, 5, 0.95, "two-sided")[0] == pytest.approx(5e-18, rel=0.5)


def test_frames(spark):
    rows = [("x", 3, 1, 1, 3, 1.0), (None, 0, 0, 0, 0, 2.0), ("n", None, 1, 1, 1, 3.0), ("m", -1, 1, 1, 1, 4.0)]
    df = spark.createDataFrame(rows, "id string, a int, b int, c int, d int, low double")
    got = {r["id"]: (r["estimate"], r["low"], r["high"]) for r in odds_interval(df, alternative="greater").collect()}
    assert got == {"x": conditional_odds(3, 1, 1, 3, 0.95, "greater"), None: (None, 0.0, math.inf), "n": (None,) * 3, "m": (None,) * 3}
    assert odds_interval(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        odds_interval(df, alternative="both")
