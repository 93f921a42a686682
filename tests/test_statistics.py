"""Tests, adjustment and resampling against closed values and plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import numeric as U
from seriesloom.operators import expression as X
from seriesloom.operators import scan
from seriesloom.operators import sets as S
from seriesloom.operators import statistics as T


@pytest.fixture(params=[1, 7])
def mode(request, monkeypatch):
    monkeypatch.setattr(scan, "shuffle_width", lambda df: request.param)
    return request.param


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_scalar_functions(spark):
    assert one(spark, U.normal_sf(F.lit(1.959964))) == pytest.approx(0.025, abs=1e-6)
    assert one(spark, U.normal_sf(F.lit(-1.0))) == pytest.approx(0.8413447, abs=1e-6)
    assert one(spark, U.probit(F.lit(0.975))) == pytest.approx(1.96, abs=1e-3)
    for n in (0, 5, 7, 8, 9, 300):
        assert one(spark, F.expr(U.log_factorial(f"{n}D"))) == pytest.approx(math.lgamma(n + 1), rel=1e-11, abs=1e-12)
    assert one(spark, U.t_two_sided(F.lit(2.228139), F.lit(10))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, U.t_two_sided(F.lit(2.364624), F.lit(7))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, U.t_two_sided(F.lit(1.9612), F.lit(2001))) == pytest.approx(0.05, abs=1e-4)
    assert one(spark, U.t_quantile_975(F.lit(100))) == pytest.approx(1.983972, abs=1e-5)
    assert one(spark, U.round_significant(F.lit(0.00123456), 3)) == pytest.approx(0.00123)


def fisher_brute(a, b, c, d, greater):
    n1, n2, k = a + b, c + d, a + c
    pmf = {x: math.comb(n1, x) * math.comb(n2, k - x) / math.comb(n1 + n2, k) for x in range(max(0, k - n2), min(n1, k) + 1)}
    if greater:
        return sum(p for x, p in pmf.items() if x >= a)
    return min(1.0, sum(p for p in pmf.values() if p <= pmf[a] * (1 + 1e-7)))


@pytest.mark.parametrize("alternative", ["greater", "two-sided"])
def test_fisher_brute_force(spark, alternative):
    rng = random.Random(1)
    tables = [(3, 0, 0, 3), (0, 0, 5, 5), (1, 1, 1, 1), (0, 4, 4, 0), (200, 150, 90, 300), (5, 500, 30, 400), (0, 3, 0, 7)]
    tables += [tuple(rng.randint(0, 30) for _ in range(4)) for _ in range(60)]
    tables = [t for t in tables if sum(t)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in T.fisher(df, alternative).collect():
        want = fisher_brute(r["a"], r["b"], r["c"], r["d"], alternative == "greater")
        assert r["pvalue"] == pytest.approx(want, rel=1e-8, abs=1e-12), r


def adjust(ps, method):
    n = len(ps)
    order = sorted(range(n), key=lambda i: ps[i])
    out = [0.0] * n
    if method == "bonferroni":
        return [min(1.0, p * n) for p in ps]
    best = 1.0 if method == "BH" else 0.0
    for rank, i in reversed(list(enumerate(order, 1))) if method == "BH" else enumerate(order, 1):
        raw = ps[i] * n / rank if method == "BH" else ps[i] * (n - rank + 1)
        best = min(best, raw) if method == "BH" else max(best, raw)
        out[i] = min(1.0, best)
    return out


@pytest.mark.parametrize("method", ["BH", "holm", "bonferroni"])
def test_p_adjust(spark, mode, method):
    rng = random.Random(2)
    ps = [round(rng.random() ** 2, 2) for _ in range(60)] + [1.0] * 30
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(999, None)], "id int, pvalue double")
    got = {r["id"]: r["padj"] for r in T.p_adjust(df, method=method).collect()}
    assert got.pop(999) is None
    assert [got[i] for i in range(len(ps))] == pytest.approx(adjust(ps, method))


def test_p_adjust_hand_cases_and_groups(spark):
    df = spark.createDataFrame([("x", 0.01), ("x", 0.02), ("x", 0.03), ("y", 0.5)], "g string, pvalue double")
    bh = sorted((r["g"], r["padj"]) for r in T.p_adjust(df, by=["g"]).collect())
    assert bh == [("x", pytest.approx(0.03))] * 3 + [("y", 0.5)]
    x = df.filter("g = 'x'")
    assert sorted(r["padj"] for r in T.p_adjust(x, method="holm").collect()) == pytest.approx([0.03, 0.04, 0.04])
    assert sorted(r["padj"] for r in T.p_adjust(x, method="bonferroni").collect()) == pytest.approx([0.03, 0.06, 0.09])


def test_rank_sum(spark, mode):
    df = spark.createDataFrame([("x", v) for v in (3.0, 4.0, 5.0)] + [("y", v) for v in (1.0, 2.0)], "category string, value double")
    assert T.rank_sum(df).collect()[0]["w"] == 6.0
    rng = random.Random(3)
    data = [(c, float(rng.randint(0, 9) + (c == "b"))) for c in "abc" for _ in range(25)]
    got = T.rank_sum(spark.createDataFrame(data, "category string, value double"), alternative="two-sided", first=["c"]).collect()
    assert {(r["cat1"], r["cat2"]) for r in got} == {("c", "a"), ("c", "b"), ("a", "b")}
    for r in got:
        x = [v for c, v in data if c == r["cat1"]]
        y = [v for c, v in data if c == r["cat2"]]
        assert r["w"] == sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        assert (r["n1"], r["n2"]) == (25, 25)


def test_midrank_and_ecdf(spark, mode):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0)], "v double")
    assert sorted((r["v"], r["midrank"]) for r in T.midrank(df, "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (5.0, 3.5)]
    assert sorted((r["v"], r["ecdf"]) for r in T.ecdf_rank(df, "v").collect()) == [(1.0, 0.25), (2.0, 0.5), (5.0, 1.0)]


def test_unordered_pairs(spark):
    df = spark.createDataFrame([(c,) for c in "abca"], "c string")
    got = sorted(map(tuple, T.unordered_pairs(df, "c").collect()))
    assert got == list(combinations("abc", 2))


def test_empirical_pvalue_draws(spark):
    hosts = spark.createDataFrame([("c", 0, 100), ("d", 0, 10)], "seq string, start long, end long")
    sites = spark.createDataFrame([(1, "c", 40, 46), (2, "d", 2, 5), (3, "c", 60, 66)], "id int, seq string, start long, end long")
    track = spark.createDataFrame([("c", p, 1.0 if 40 <= p < 46 else 0.1) for p in range(100)], "seq string, pos long, score double")
    first = {r["id"]: tuple(r) for r in T.empirical_pvalue(sites, hosts, track, 50, seed=1).collect()}
    # The site itself is never drawn, so the only high bases cannot appear in its null.
    assert first[1][1:] == (1.0, 0.0)
    assert first[2][1:] == (0.0, 0.0)
    assert first[3][1] == pytest.approx(0.1) and 0 < first[3][2] < 1
    assert {r["id"]: tuple(r) for r in T.empirical_pvalue(sites, hosts, track, 50, seed=1).collect()} == first


def test_token_enrichment_forces_odds(spark):
    pairs = spark.createDataFrame([("l1", "g1"), ("l2", "g1"), ("l2", "g2")], "a string, b string")
    left = spark.createDataFrame([("l1", 1), ("l2", 1), ("l1", 2)], "entity string, token int")
    right = spark.createDataFrame([("g1", 1), ("g2", 1)], "entity string, token int")
    got = {r["token"]: r for r in T.token_enrichment(pairs, left, right, spark.createDataFrame([(1,), (2,), (3,)], "token int")).collect()}
    assert (got[1]["odds"], got[3]["odds"]) == (1.0, 1.0)
    assert (got[2]["n_a"], got[2]["t_a"], got[2]["n_b"], got[2]["t_b"]) == (1, 2, 0, 2)
    assert got[2]["pvalue"] == pytest.approx(0.5) and got[2]["qvalue"] == 1.0


def test_shared_tokens_empty_sides(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "none"), ("none", "b")], "a string, b string")
    left = spark.createDataFrame([("a", 1), ("a", 2)], "entity string, token int")
    right = spark.createDataFrame([("b", 2), ("b", 3)], "entity string, token int")
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in S.shared_tokens(pairs, left, right).collect()}
    assert got[("a", "b")] == (1, 1, 0.5, 0.5, "2")
    assert got[("a", "none")] == (0, 2, 0.0, 0.0, "")
    assert got[("none", "b")] == (0, 0, 0.0, 0.0, "")


def test_small_filters(spark):
    df = spark.createDataFrame([("e", "A", t, float(v)) for t, v in enumerate([1, 2, 4, 3])], "entity string, condition string, time int, value double")
    assert [r["diff"] for r in X.first_difference(df).orderBy("time").collect()] == [1.0, 2.0, -1.0]
    assert X.net_change_filter(df, "up").count() == 1
    with pytest.raises(ValueError):
        X.net_change_filter(df, "sideways")
    parts = X.split_sample_label(spark.createDataFrame([("A.3.R2",)], "sample string")).collect()[0]
    assert (parts["condition"], parts["time"], parts["replicate"]) == ("A", 3, "R2")
    assert X.to_series(df, range(5)).count() == 0 and X.to_series(df, range(4)).count() == 1


def test_tails_keep_their_relative_accuracy(spark):
    # Literal values to 15 digits.
    for z, want in ((0.0, 0.5), (1.0, 0.158655253931457), (3.0, 1.34989803163009e-3), (5.0, 2.86651571879194e-7), (8.0, 6.22096057427178e-16), (20.0, 2.75362411860623e-89)):
        assert one(spark, U.normal_sf(F.lit(z))) == pytest.approx(want, rel=1e-11)
    assert one(spark, U.normal_sf(F.lit(-8.0))) == 1.0 - 6.22096057427178e-16
    for p, want in ((0.975, 1.95996398454005), (0.5, 0.0), (0.025, -1.95996398454005), (1e-10, -6.36134090240406), (0.84134474606854, 1.0)):
        assert one(spark, U.probit(F.lit(p))) == pytest.approx(want, rel=1e-11, abs=1e-12)


def exact_t(t, n):
    """Two-sided tail for even degrees of freedom by the closed series, in 60 digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    t, n = Decimal(t), Decimal(n)
    cos2 = n / (n + t * t)
    term = total = Decimal(1)
    for j in range(1, int(n) // 2):
        term *= cos2 * (2 * j - 1) / (2 * j)
        total += term
    return float(1 - (1 - cos2).sqrt() * total)


def test_t_tail_far_out_and_with_many_degrees(spark):
    for t, n in ((30, 20), (60, 40), (2, 10), (1, 2), (4, 2000), (4, 2002), (7, 5000), (0, 6)):
        assert one(spark, U.t_two_sided(F.lit(float(t)), F.lit(n))) == pytest.approx(exact_t(t, n), rel=1e-9)
    assert one(spark, U.t_two_sided(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, rel=1e-12)


def test_both_tails_of_a_large_table(spark):
    df = spark.createDataFrame([(700, 300, 300, 700), (300, 700, 700, 300), (5, 5, 5, 5), (10, 0, 0, 10)], "a int, b int, c int, d int")
    got = [r["pvalue"] for r in T.fisher(df).orderBy(F.desc("a"), "b").collect()]
    tail = sum(math.comb(1000, k) * math.comb(1000, 1000 - k) for k in range(700, 1001)) / math.comb(2000, 1000)
    assert got[0] == pytest.approx(2 * tail, rel=1e-9) and got[0] == pytest.approx(3.5208e-73, rel=1e-4)
    assert got[1] == pytest.approx(2 * tail, rel=1e-9)
    assert got[2] == pytest.approx(2 / math.comb(20, 10), rel=1e-9) and got[3] == pytest.approx(1.0)


def test_adjustment_and_ranks_with_a_null_group(spark, mode):
    data = [(None, 0.01), (None, 0.02), (None, None), ("a", 0.01), ("a", 0.5)]
    df = spark.createDataFrame(data, "g string, pvalue double")
    got = sorted((str(r["g"]), str(r["pvalue"]), r["padj"]) for r in T.p_adjust(df, by=["g"]).collect())
    assert got == [("None", "0.01", 0.02), ("None", "0.02", 0.02), ("None", "None", None), ("a", "0.01", 0.02), ("a", "0.5", 0.5)]
    ranks = T.ecdf_rank(df.filter("pvalue IS NOT NULL"), "pvalue", ["g"]).collect()
    assert sorted((str(r["g"]), r["ecdf"]) for r in ranks) == [("None", 0.5), ("None", 1.0), ("a", 0.5), ("a", 1.0)]


def test_the_law_of_rank_sums_like_all_orders():
    for n1, n2 in [(1, 1), (1, 5), (3, 3), (3, 4), (4, 6), (5, 2)]:
        every = [sum(a > b for a in x for b in set(range(n1 + n2)) - set(x)) for x in combinations(range(n1 + n2), n1)]
        assert T.upper_tails(n1, n2) == pytest.approx([sum(e >= w for e in every) / len(every) for w in range(n1 * n2 + 1)])
    big = T.upper_tails(49, 49)
    assert big[0] == 1.0 and big[-1] == pytest.approx(1 / math.comb(98, 49), rel=1e-14)


def test_rank_sums_are_exact_for_small_samples_without_ties(spark, mode):
    rows = [("t", "x", v) for v in (3.0, 4.0, 5.0)] + [("t", "y", v) for v in (1.0, 2.0)]
    rows += [("tied", "x", v) for v in (3.0, 4.0, 5.0)] + [("tied", "y", v) for v in (1.0, 3.0)]
    rows += [("wide", "x", 2.0 * k) for k in range(5)] + [("wide", "y", 2.0 * k + 1) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, category string, value double")
    p = {r["g"]: r["pvalue"] for r in T.rank_sum(df, by=["g"], exact_below=5).collect()}
    near = {r["g"]: r["pvalue"] for r in T.rank_sum(df, by=["g"]).collect()}
    assert p["t"] == pytest.approx(0.1) and p["tied"] == near["tied"] and p["wide"] == near["wide"] and near["t"] != pytest.approx(0.1)
    two = {r["g"]: r["pvalue"] for r in T.rank_sum(df, alternative="two-sided", by=["g"], exact_below=5).collect()}
    assert two["t"] == pytest.approx(0.2)
    assert T.rank_sum(df.limit(0), by=["g"], exact_below=5).count() == 0
    with pytest.raises(ValueError):
        T.rank_sum(df, exact_below=51)


def test_draws_meet_their_values_in_parts(spark, monkeypatch):
    """No draw is a row: sites and values meet in parts, also where a sequence has several of both."""
    from hashlib import md5

    rng = np.random.default_rng(5)
    score = {p: [float(round(v, 3))] for p, v in zip(range(0, 60, 2), rng.normal(size=30))}
    score[8].append(2.5)  # a base with two scores counts twice
    track = spark.createDataFrame([("c", p, v) for p, vs in score.items() for v in vs], "seq string, pos long, score double")
    hosts = spark.createDataFrame([("c", 0, 60), ("d", 0, 40)], "seq string, start long, end long")
    spans = {f"s{k}": (k * 4, k * 4 + 6) for k in range(9)}
    sites = spark.createDataFrame([(i, "c", a, b) for i, (a, b) in spans.items()] + [("t", "d", 3, 9)], "id string, seq string, start long, end long")
    got = {}
    for held in (1_000_000, 7):
        monkeypatch.setattr(T, "VALUES_HELD", held)
        monkeypatch.setattr(T, "SITES_HELD", 4)
        monkeypatch.setattr(T, "DRAWS_AT_ONCE", 100)
        out = T.empirical_pvalue(sites, hosts, track, 40, seed=3)
        got[held] = {r["id"]: (r["score"], r["pvalue"]) for r in out.collect()}
    assert got[7] == got[1_000_000] and got[7]["t"] == (0.0, 0.0)
    for name, (a, b) in spans.items():
        m0, above = max(a, 5), 0
        masked = max(min(b, 56) - m0, 0)
        for p in range(1, 41):
            drawn = []
            for d in range(1, 7):
                at = 5 + int(md5(f"{name}|{p}|{d}|3".encode()).hexdigest()[:8], 16) % (60 - 9 - masked)
                drawn += score.get(at + masked if masked and at >= m0 else at, [0.0])
            above += round(sum(drawn) / len(drawn), 9) > round(got[7][name][0], 9)
        assert got[7][name][1] == above / 40


def _token_case(spark):
    rng = random.Random(11)
    left = sorted({(rng.choice(["l1", "l2", "l3", None]), rng.choice([None, *range(40)])) for _ in range(90)}, key=str)
    right = sorted({(f"g{rng.randrange(12)}", rng.randrange(45)) for _ in range(200)} | {(f"g{i}", 7) for i in range(12)})
    pairs = [("l1", f"g{i}") for i in range(12)] + [("l2", "g1"), ("l2", "g1"), ("l3", "none"), (None, "g2")]
    frames = [spark.createDataFrame(c, "entity string, token int") for c in (left, right)]
    want = {}
    for a, b in set(pairs):
        mine = {t for e, t in left if e == a and a is not None}
        both = sorted(mine & {t for e, t in right if e == b})
        want[a, b] = (len(both), len(mine) - len(both), ",".join(map(str, both)))
    return spark.createDataFrame(pairs, "a string, b string"), *frames, want


@pytest.mark.parametrize("meetings, holders", [(8, 100_000), (1, 100_000), (8, 5), (0, 0)])
def test_shared_tokens_whatever_tokens_are_crowded(spark, monkeypatch, meetings, holders):
    pairs, left, right, want = _token_case(spark)
    monkeypatch.setattr(S, "MEETINGS", meetings)
    monkeypatch.setattr(S, "HOLDERS", holders)
    got = S.shared_tokens(pairs, left, right).collect()
    assert len(got) == len(want)
    assert {(r["a"], r["b"]): (r["n_shared"], r["n_unshared"], r["tokens"]) for r in got} == want


def test_shared_tokens_lists_no_set_per_pair(spark, monkeypatch):
    pairs, left, right, want = _token_case(spark)
    monkeypatch.setattr(S, "_shared_by_pair", lambda *_: pytest.fail("sets listed per pair"))
    got = S.shared_tokens(pairs, left, right).collect()
    assert sum(r["n_shared"] for r in got) == sum(n for n, *_ in want.values())


def test_token_enrichment_tests_equal_counts_once(spark, monkeypatch):
    conditions = ["A", "B", None]
    pairs = [(c, f"l{i}", f"g{j}") for k, c in enumerate(conditions) for i in range(3 + k) for j in range(4) if (i + j + k) % 3]
    left = [(f"l{i}", t) for i in range(6) for t in range(60) if (i + t) % 3 == 0]
    right = [(f"g{j}", t) for j in range(4) for t in range(60) if (j * t) % 4 == 1]
    tested, exact = [], T.exact_p
    monkeypatch.setattr(T, "exact_p", lambda df, *a, **k: tested.append(df.count()) or exact(df, *a, **k))
    frames = [spark.createDataFrame(c, "entity string, token int") for c in (left, right)]
    listed = spark.createDataFrame([(t,) for t in range(70)], "token int")
    got = T.token_enrichment(spark.createDataFrame(pairs, "condition string, a string, b string"), *frames, listed, ["condition"]).collect()
    want = {}
    for c in conditions:
        a, b = {p[1] for p in pairs if p[0] == c}, {p[2] for p in pairs if p[0] == c}
        for t in range(70):
            want[c, t] = (sum((e, t) in left for e in a), sum((e, t) in right for e in b), len(a), len(b))
    assert {(r["condition"], r["token"]): (r["n_a"], r["n_b"], r["t_a"], r["t_b"]) for r in got} == want and len(got) == len(want)
    assert tested == [len(set(want.values()))]
    for r in got:
        held, lacking, chosen = r["n_a"] + r["n_b"], r["t_a"] + r["t_b"] - r["n_a"] - r["n_b"], r["t_a"]
        p = sum(math.comb(held, k) * math.comb(lacking, chosen - k) for k in range(r["n_a"], min(held, chosen) + 1)) / math.comb(held + lacking, chosen)
        assert r["pvalue"] == pytest.approx(p, abs=1e-9)
