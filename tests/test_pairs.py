"""Pair scores, warping, partners and matched random pairs against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clustering as C
from seriesloom.operators import models as M
from seriesloom.operators import pairs as P

TIMES = list(range(5))


def series_table(spark, named):
    data = [(e, t, float(v)) for e, s in named.items() for t, v in enumerate(s)]
    return spark.createDataFrame(data, "entity string, time int, value double")


@pytest.fixture(scope="module")
def named():
    rng = np.random.default_rng(5)
    out = {f"e{i:02d}": rng.normal(size=5).round(3) for i in range(23)}
    out["flat"] = np.ones(5)
    return out


def test_hand_cases(spark):
    df = series_table(spark, {"x": [1, 2, 3, 4, 5], "y": [2, 4, 6, 8, 10], "c": [3, 3, 3, 3, 3]})
    cross = {(r["a"], r["b"]): r["value"] for r in P.pair_corr(df, None, TIMES).collect()}
    assert cross[("x", "y")] == pytest.approx(1.0)
    assert ("c", "x") not in cross and ("c", "c") not in cross
    temporal = {(r["a"], r["b"]): r["value"] for r in P.pair_corr(df, None, TIMES, "temporal").collect()}
    assert temporal[("x", "y")] == pytest.approx(1.0)
    assert temporal[("c", "x")] == 0.0


def test_full_grid_has_every_pair_once(spark, named):
    df = series_table(spark, named)
    got = [(r["a"], r["b"], r["value"]) for r in P.pair_corr(df, None, TIMES).collect()]
    ids = sorted(n for n in named if n != "flat")
    assert sorted((a, b) for a, b, _ in got) == [(a, b) for i, a in enumerate(ids) for b in ids[i:]]
    for a, b, v in got:
        assert v == pytest.approx(np.corrcoef(named[a], named[b])[0, 1])
    both = P.mirror(P.pair_corr(df, None, TIMES)).count()
    assert both == len(ids) ** 2


@pytest.mark.parametrize("lag", [-3, -1, 0, 2])
def test_lagged_score_is_the_full_correlate(spark, named, lag):
    df = series_table(spark, {k: named[k] for k in ("e00", "e01", "e02")})
    got = {(r["a"], r["b"]): r["value"] for r in P.pair_corr(df, df, TIMES, lags=[lag]).collect()}
    for (a, b), v in got.items():
        t, s = named[a], named[b]
        full = np.correlate((t - t.mean()) / (t.std() * len(t)), (s - s.mean()) / s.std(), "full")
        assert v == pytest.approx(full[len(t) - 1 + lag])


def test_listed_pairs_and_threshold(spark, named):
    df = series_table(spark, named)
    listed = spark.createDataFrame([("e00", "e05", "x"), ("e00", "e07", "y"), ("e03", "e03", "z")], "a string, b string, tag string")
    got = {(r["a"], r["b"], r["tag"]): r["value"] for r in P.pair_corr(df, df, TIMES, pairs=listed).collect()}
    assert set(got) == {("e00", "e05", "x"), ("e00", "e07", "y"), ("e03", "e03", "z")}
    strong = P.pair_corr(df, df, TIMES, min_abs=0.8).collect()
    want = sum(abs(np.corrcoef(named[a], named[b])[0, 1]) >= 0.8 for a in named for b in named if "flat" not in (a, b))
    assert len(strong) == want


def dtw(x, y):
    acc = np.full((len(x) + 1, len(y) + 1), np.inf)
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            c = abs(a - b)
            steps = (acc[i - 1, j] + c, acc[i, j - 1] + c, acc[i - 1, j - 1] + 2 * c)
            acc[i, j] = c if i == j == 1 else min(steps)
    return acc[len(x), len(y)]


def test_dtw_and_its_tuned_form(spark, named):
    few = {k: named[k] for k in ("e00", "e01", "e02", "flat")}
    df = series_table(spark, few)
    for r in P.pair_dtw(df, df, TIMES).collect():
        assert r["distance"] == pytest.approx(dtw(few[r["a"]], few[r["b"]]))
        assert r["a"] != r["b"] or r["distance"] == 0
    for r in P.pair_dtw(df, df, TIMES, k=2.0).collect():
        dx, dy = np.diff(few[r["a"]]), np.diff(few[r["b"]])
        den = np.sqrt((dx**2).sum() * (dy**2).sum())
        cort = (dx * dy).sum() / den if den else 0.0
        assert r["distance"] == pytest.approx(dtw(few[r["a"]], few[r["b"]]) * 2 / (1 + np.exp(2 * abs(cort))))
    assert dtw([0, 0], [1, 1]) == 3


def test_best_partner_ties_go_to_smallest_id(spark):
    df = spark.createDataFrame([("a", "y", 0.5), ("a", "x", 0.5), ("a", "z", 0.1), ("b", "q", -1.0)], "a string, b string, value double")
    assert sorted(map(tuple, P.best_partner(df, "a", "b").collect())) == [("a", "x", 0.5), ("b", "q", -1.0)]
    assert sorted(map(tuple, P.best_partner(df, "a", "b", "min").collect())) == [("a", "z", 0.1), ("b", "q", -1.0)]


def test_orient_pairs(spark):
    df = spark.createDataFrame([("L_1", "G1", 1.0), ("L_2", "G2", 2.0)], "x string, y string, value double")
    assert sorted(map(tuple, P.orient_pairs(df, "x", "y").collect())) == [("G1", "L_1", 1.0), ("G2", "L_2", 2.0)]
    tie = spark.createDataFrame([("L_1", "G1", 1.0), ("G2", "L_2", 2.0)], "x string, y string, value double")
    with pytest.raises(Exception, match="which column holds genes"):
        P.orient_pairs(tie, "x", "y").collect()


def test_random_matched_pairs_match_brute_force_and_repeat(spark):
    rng = random.Random(9)
    people = [(f"L{i:03d}", rng.uniform(0, 12), rng.randint(0, 9000)) for i in range(150)]
    targets, pool = people[:40], people[30:]
    others = [(f"G{i:03d}",) for i in range(400)]
    schema = "entity string, mean double, length long"
    args = (spark.createDataFrame(targets, schema), spark.createDataFrame(pool, schema), spark.createDataFrame(others, "entity string"))
    want = {
        e for e, m, n in pool
        if any(t != e and abs(tm - m) <= 1.0 and abs(tn - n) <= 1000 for t, tm, tn in targets)
    }
    first = sorted(map(tuple, P.random_matched_pairs(*args, seed=3).collect()))
    assert {a for a, _ in first} == want
    assert len({b for _, b in first}) == len(first)
    assert sorted(map(tuple, P.random_matched_pairs(*args, seed=3).collect())) == first
    assert sorted(map(tuple, P.random_matched_pairs(*args, seed=4).collect())) != first


def test_co_occurrence_diagonal_and_values(spark):
    labels = {"a": [1, 1, 2], "b": [1, 2, 2], "c": [3, 3, 3]}
    df = spark.createDataFrame([(i, e, k) for e, ks in labels.items() for i, k in enumerate(ks)], "iteration int, entity string, cluster int")
    got = {(r["a"], r["b"]): r["fraction"] for r in C.co_occurrence(df, [0, 1, 2]).collect()}
    assert got[("a", "a")] == got[("c", "c")] == 1.0
    assert got[("a", "b")] == pytest.approx(2 / 3) and got[("a", "c")] == 0.0 and len(got) == 6


def test_concordance_hand_case(spark):
    df = spark.createDataFrame(
        [("x", e, k) for e, k in zip("pqr", (1, 1, 2))] + [("y", e, 1) for e in "pqr"], "clustering string, entity string, cluster int"
    )
    r = C.concordance(df).collect()[0]
    assert [r[x] for x in "abcd"] == [4.0, 0.0, 0.0, 2.0]


def test_connected_components_chain_and_star(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]
    star = [("s00", f"s{i:02d}") for i in range(1, 20)]
    edges = spark.createDataFrame(chain + star, "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(31)] + [(f"s{i:02d}",) for i in range(20)] + [("z",)], "entity string")
    got = {r["entity"]: r["component"] for r in C.connected_components(edges, nodes).collect()}
    assert all(got[f"n{i:02d}"] == "n00" for i in range(31)) and all(got[f"s{i:02d}"] == "s00" for i in range(20)) and got["z"] == "z"


def replicated(spark):
    rng = np.random.default_rng(11)
    data = [
        (f"e{e}", c, t, r, float(rng.normal() + (e + 1) * 0.3 * t * (c == "B")))
        for e in range(4) for c in ("A", "B", "C") for t in range(4) for r in range(5)
    ]
    return data, spark.createDataFrame(data, "entity string, condition string, time int, replicate int, value double")


def test_trend_models_match_numpy(spark):
    data, df = replicated(spark)
    for r in M.polynomial_trend(df, 2).collect():
        pts = [(t, v) for e, c, t, _, v in data if (e, c) == (r["entity"], r["condition"])]
        x, y = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts])
        fit = np.polyfit(x, y, 2)[::-1]
        assert r["coef"] == pytest.approx(list(fit), abs=1e-6)
        rss = ((np.polyval(fit[::-1], x) - y) ** 2).sum()
        assert r["r2"] == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    for r in M.trend_by_condition(df, ["A", "B", "C"], "A").collect():
        pts = [(c, t, v) for e, c, t, _, v in data if e == r["entity"]]
        x = np.array([[1, t, c == "B", c == "C", t * (c == "B"), t * (c == "C")] for c, t, _ in pts], float)
        y = np.array([p[2] for p in pts])
        coef, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert r["coef"] == pytest.approx(list(coef), abs=1e-6)
        f = ((((y - y.mean()) ** 2).sum() - rss[0]) / 5) / (rss[0] / (len(y) - 6))
        assert r["f"] == pytest.approx(f)


def test_f_tail_known_values():
    # F(1, n) is the square of Student's t; F(2, n) has a closed tail.
    assert M.f_tail([4.0], [2], [10])[0] == pytest.approx((1 + 2 * 4.0 / 10) ** (-5))
    assert M.f_tail([12.706205**2], [1], [1])[0] == pytest.approx(0.05, abs=1e-6)
    assert M.f_tail([0.0], [3], [7])[0] == pytest.approx(1.0)


def test_hotelling_matches_numpy(spark):
    data, df = replicated(spark)
    cell = {(e, c, t, r): v for e, c, t, r, v in data}
    for row in M.hotelling(df, range(4), ["A", "B", "C"], ridge=1.0).collect():
        d = np.array([[cell[(row["entity"], row["first"], t, r)] - cell[(row["entity"], row["second"], t, r)] for t in range(4)] for r in range(5)])
        cov = np.cov(d.T) + np.eye(4)
        t2 = 5 * d.mean(0) @ np.linalg.solve(cov, d.mean(0))
        assert row["t2"] == pytest.approx(t2)
        assert row["f"] == pytest.approx((40 - 4 - 1) / ((40 - 2) * 4) * t2)


def test_module_pc1_matches_svd(spark, named):
    clusters = {k: ("m1" if i % 2 else "m2") for i, k in enumerate(k for k in named if k != "flat")}
    got = {}
    out = M.module_pc1(series_table(spark, named), spark.createDataFrame(list(clusters.items()), "entity string, cluster string"), TIMES)
    for r in out.collect():
        got.setdefault(r["cluster"], {})[r["time"]] = (r["score"], r["var_explained"])
    for m, scores in got.items():
        x = np.array([(named[k] - named[k].mean()) / (named[k].std() * np.sqrt(5)) for k, c in clusters.items() if c == m])
        _, s, vt = np.linalg.svd(x)
        v = vt[0] * np.sign(vt[0] @ x.mean(0))
        assert [scores[t][0] for t in TIMES] == pytest.approx(list(v), abs=1e-6)
        assert scores[0][1] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_sample_pca_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    data = [(f"e{i}", f"s{j}", float(x[i, j])) for i in range(40) for j in range(6)]
    out = M.sample_pca(spark.createDataFrame(data, "entity string, sample string, value double"), [f"s{j}" for j in range(6)], top=500).collect()
    c = x - x.mean(1, keepdims=True)
    _, s, vt = np.linalg.svd(c)
    for k in (1, 2):
        v = vt[k - 1] * np.sign(vt[k - 1][np.argmax(np.abs(vt[k - 1]))])
        rows = sorted((r["sample"], r["score"], r["var_explained"]) for r in out if r["component"] == k)
        assert [r[1] for r in rows] == pytest.approx(list(v), abs=1e-6)
        assert rows[0][2] == pytest.approx(s[k - 1] ** 2 / (s**2).sum())


# Pairs within the values of a column --------------------------------------------------------


def keyed_rows(seed=6):
    """Condition A holds nine tenths of the entities, one condition is null, one has a single entity."""
    rng = np.random.default_rng(seed)
    named = [("A", 90), ("N", 6), (None, 3), ("R", 1)]
    return [(c, f"e{k:03d}", t, float(rng.normal())) for c, n in named for k in range(n) for t in TIMES]


def by_condition(rows):
    out = {}
    for c, e, t, v in rows:
        out.setdefault(c, {}).setdefault(e, [0.0] * len(TIMES))[t] = v
    return out


@pytest.mark.parametrize("cell", [4, 2000])
def test_keyed_pairs_are_those_of_every_condition(spark, monkeypatch, cell):
    monkeypatch.setattr(P, "CELL_ROWS", cell)
    rows = keyed_rows()
    df = spark.createDataFrame(rows, "condition string, entity string, time int, value double")
    other = df.filter("entity < 'e005'")
    want = {}
    for c, series in by_condition(rows).items():
        for a, x in series.items():
            for b, y in series.items():
                if b < "e005":
                    want[c, a, b] = np.corrcoef(x, y)[0, 1]
    got = {(r["condition"], r["a"], r["b"]): r["value"] for r in P.pair_corr(df, other, TIMES, by=["condition"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    half = P.pair_corr(df, None, TIMES, by=["condition"]).collect()
    assert len(half) == sum(n * (n + 1) // 2 for n in (90, 6, 3, 1)) and len({(r["condition"], r["a"], r["b"]) for r in half}) == len(half)
    assert all(r["a"] <= r["b"] for r in half)


def test_grids_follow_the_rows_of_their_key(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 10)
    df = spark.createDataFrame(sorted({r[:2] for r in keyed_rows()}, key=str), "condition string, entity string")
    found = {r["condition"]: r for r in P._grids(df, df, ["condition"], False, 16).collect()}
    assert len({r["_grid"] for r in found.values()}) == 4
    assert {c: (r["_rows"], r["_cols"]) for c, r in found.items()} == {"A": (9, 9), "N": (1, 1), None: (1, 1), "R": (1, 1)}
    # Where cells are fewer than tasks, the value with most pairs is cut further, the others are not.
    wide = {r["condition"]: r["_rows"] * r["_cols"] for r in P._grids(df, df, ["condition"], False, 400).collect()}
    assert wide["A"] >= 390 and wide["N"] <= 6 and wide["R"] == 1


def test_listed_pairs_without_the_key_count_for_every_condition(spark):
    df = spark.createDataFrame(keyed_rows(), "condition string, entity string, time int, value double")
    listed = spark.createDataFrame([("e000", "e001"), ("e002", "e089")], "a string, b string")
    got = P.pair_corr(df, df, TIMES, pairs=listed, by=["condition"]).collect()
    assert sorted((str(r["condition"]), r["a"], r["b"]) for r in got) == [("A", "e000", "e001"), ("A", "e002", "e089"), ("N", "e000", "e001"), ("None", "e000", "e001")]


def test_keyed_clusters_and_covariances_equal_those_of_each_condition(spark):
    from seriesloom.operators.clustering import threshold_clusters

    df = spark.createDataFrame([r for r in keyed_rows(9) if r[0] in ("A", "N")], "condition string, entity string, time int, value double")
    near = lambda some, **kw: P.distance_from_corr(P.pair_corr(some, None, TIMES, min_value=0.6, **kw))
    whole = threshold_clusters(near(df, by=["condition"]), df.select("condition", "entity").distinct(), 0.4, 2, ["condition"])
    whole = sorted(map(tuple, whole.collect()))
    kept = sorted(map(tuple, P.covariance_sum_filter(df, TIMES, 3, ["condition"]).collect()))
    each, cov = [], []
    for c in "AN":
        some = df.filter(F.col("condition") == c)
        each += [(c, *r) for r in threshold_clusters(near(some), some.select("entity").distinct(), 0.4, 2).collect()]
        cov += [(c, *r) for r in P.covariance_sum_filter(some, TIMES, 3).collect()]
    assert whole == sorted(each)
    assert [r[:2] for r in kept] == [r[:2] for r in sorted(cov)] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(kept, sorted(cov)))


# Agreement of clusterings -------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.2, 0.5, 5 / 7, 1.0, 1.2])
def test_agreement_equals_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(P, "CELL_ROWS", 8)
    rng = random.Random(11)
    # A third of the entities always fall into one cluster; some miss iterations.
    rows = [(f"e{e:03d}", i, "big" if e % 3 == 0 else rng.choice("abcd")) for e in range(75) for i in range(7) if e % 10 or rng.random() < 0.8]
    df = spark.createDataFrame(rows, "entity string, iteration int, cluster string")
    labels = {}
    for e, i, c in rows:
        labels.setdefault(e, {})[i] = c
    want = {}
    for a in labels:
        for b in labels:
            same = sum(labels[a].get(i) == c for i, c in labels[b].items())
            if a <= b and same / 7 >= share - 1e-9:
                want[a, b] = same / 7
    found = C.co_occurrence(df, range(7), share)
    got = found.collect()
    assert {(r["a"], r["b"]): pytest.approx(r["fraction"]) for r in got} == want and len(got) == len(want)


def test_equal_labels_are_compared_once(spark, monkeypatch):
    """Many entities share their labels: pairs come from classes, clusters from their representatives alone."""
    monkeypatch.setattr(C, "LIST", 4)
    kinds = [(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 1, 1), (2, 2, 2, 2), (3, 3, 3, None), (None, 5, 5, None), (6, None, None, None)]
    labels = {f"e{k:03d}": kinds[k % 7 if k < 90 else 0] for k in range(150)}
    rows = [(it, e, c) for e, ls in labels.items() for it, c in enumerate(ls) if c is not None]
    df = spark.createDataFrame([*rows, (0, None, 0)], "iteration int, entity string, cluster int")
    names, want = sorted(labels), {}
    for i, a in enumerate(names):
        for b in names[i:]:
            n = sum(x is not None and x == y for x, y in zip(labels[a], labels[b]))
            if n >= 3:
                want[a, b] = n / 4
    found = C.co_occurrence(df, range(4), 0.75).collect()
    assert {(r.a, r.b): r.fraction for r in found} == want and len(found) == len(want) > 2000
    near = C.co_occurrence(df, range(4), 0.75, representatives=True).withColumn("distance", 1 - F.col("fraction"))
    assert {(r.a, r.b) for r in near.collect()} == {("e000", "e000"), ("e000", "e001"), ("e001", "e001"), ("e001", "e002"), ("e002", "e002"), ("e003", "e003"), ("e004", "e004")}
    nodes = df.select("entity").distinct()
    got = C.threshold_clusters(near, nodes, 0.25, 3, members=C.agreement_classes(df, range(4), 0.75)).collect()
    plain = C.threshold_clusters(C.co_occurrence(df, range(4), 0.75).withColumn("distance", 1 - F.col("fraction")), nodes, 0.25, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) == 150
