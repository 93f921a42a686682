"""Interval operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import intervals as V
from seriesloom.operators import scan

SCHEMA = "id int, seq string, start long, end long, strand string"


@pytest.fixture(params=[1, 7])
def mode(request, monkeypatch):
    """Run every scan in one chunk and in several."""
    monkeypatch.setattr(scan, "shuffle_width", lambda df: request.param)
    return request.param


def make(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(0, 200)
        out.append((i, rng.choice(["c1", "c1", "c2"]), start, start + rng.randint(1, 25), rng.choice("+-")))
    return out


def test_hand_case(spark, mode):
    df = spark.createDataFrame([(1, "c", 0, 10, "+"), (2, "c", 5, 15, "+"), (3, "c", 20, 30, "+")], SCHEMA)
    pairs = [(r["a_id"], r["b_id"], r["width"]) for r in V.overlap_join(df, df, 4).collect() if r["a_id"] < r["b_id"]]
    assert pairs == [(1, 2, 5)]
    merged = sorted((r["start"], r["end"], r["n"]) for r in V.merge_intervals(df).collect())
    assert merged == [(0, 15, 2), (20, 30, 1)]
    depth = sorted((r["start"], r["end"], r["plus"], r["minus"]) for r in V.coverage(df).collect())
    assert depth == [(0, 5, 1, 0), (5, 10, 2, 0), (10, 15, 1, 0), (15, 20, 0, 0), (20, 30, 1, 0)]


@pytest.mark.parametrize("bin_size", [1, 7, 1000])
def test_overlap_join(spark, bin_size):
    a, b = make(1, 60), make(2, 50)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    over = [(x, y) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    got = sorted((r["a_id"], r["b_id"], r["width"]) for r in V.overlap_join(da, db, bin_size).collect())
    assert got == sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x, y in over)
    inside = sorted((r["a_id"], r["b_id"]) for r in V.overlap_join(da, db, bin_size, contained=True, stranded=True).collect())
    assert inside == sorted((x[0], y[0]) for x, y in over if x[2] >= y[2] and x[3] <= y[3] and x[4] == y[4])


def test_semi_joins(spark, mode):
    a, b = make(3, 60), make(4, 20)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = sorted(r["id"] for r in V.overlaps_any(da, db).collect())
    assert got == sorted(x[0] for x in a if any(x[1] == y[1] and x[2] < y[3] and y[2] < x[3] for y in b))
    got = sorted(r["id"] for r in V.contained_semi(da, db).collect())
    assert got == sorted(x[0] for x in a if any(x[1] == y[1] and x[2] >= y[2] and x[3] <= y[3] for y in b))


def test_subtract_fraction(spark, mode):
    a, b = make(5, 60), make(6, 30)
    got = sorted(r["id"] for r in V.subtract_fraction(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 0.5).collect())
    want = []
    for x in a:
        covered = {p for y in b if y[1] == x[1] and y[4] == x[4] for p in range(max(x[2], y[2]), min(x[3], y[3]))}
        if len(covered) / (x[3] - x[2]) < 0.5:
            want.append(x[0])
    assert got == sorted(want)


def test_nearest(spark, mode):
    a, b = make(7, 50), make(8, 12)
    got = {r["id"]: (r["closest_id"], r["distance"]) for r in V.nearest_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()}
    for x in a:
        near = [y for y in b if y[1] == x[1]]
        if not near:
            assert x[0] not in got
            continue
        gap = {y[0]: max(x[2] - y[3], y[2] - x[3], 0) for y in near}
        assert got[x[0]][1] == min(gap.values())
        assert gap[got[x[0]][0]] == got[x[0]][1]


def test_coverage_area_and_merged_length(spark, mode):
    a = make(9, 80)
    df = spark.createDataFrame(a, SCHEMA)
    area = sum((r["end"] - r["start"]) * (r["plus"] - r["minus"]) for r in V.coverage(df).collect())
    assert area == sum(x[3] - x[2] for x in a)
    got = {r["seq"]: r["length"] for r in V.merged_length(df, "seq").collect()}
    want = {}
    for x in a:
        want.setdefault(x[1], set()).update(range(x[2], x[3]))
    assert got == {k: len(v) for k, v in want.items()}


def test_bridging_pairs(spark, mode):
    reads = [(q, "c", s, s + 3) for q, s in [("p", 10), ("p", 50), ("q", 10), ("q", 11), ("r", 10), ("s", 50), ("s", 10), ("s", 90), ("t", 10), ("t", 90)]]
    df = spark.createDataFrame(reads, "qname string, seq string, start long, end long")
    j = spark.createDataFrame([("c", 8, 14)], "seq string, start long, end long")
    c = spark.createDataFrame([("c", 48, 60)], "seq string, start long, end long")
    assert sorted({r["qname"] for r in V.bridging_pairs(df, j, c).collect()}) == ["p"]


def test_extend_and_scores(spark):
    df = spark.createDataFrame([(1, "c", 50, 60, "+"), (2, "c", 500, 560, "-")], SCHEMA)
    lengths = spark.createDataFrame([("c", 600)], "seq string, length long")
    assert sorted((r["start"], r["end"]) for r in V.extend_intervals(df, lengths).collect()) == [(0, 160), (400, 600)]
    assert sorted((r["start"], r["end"]) for r in V.extend_intervals(df, lengths, five_prime_only=True).collect()) == [(0, 60), (500, 600)]
    track = spark.createDataFrame([("c", 50, 1.0), ("c", 51, 2.0), ("c", 52, 7.0)], "seq string, pos long, score double")
    gaps = spark.createDataFrame([("c", 52)], "seq string, pos long")
    got = {r["id"]: r["score"] for r in V.interval_scores(df, track, gaps).collect()}
    assert got == {1: pytest.approx(0.3), 2: 0.0}


def test_empty_site_has_no_score(spark):
    sites = spark.createDataFrame([(1, "c", 5, 5), (2, "c", 4, 6), (3, "c", 7, 5)], "id int, seq string, start long, end long")
    track = spark.createDataFrame([("c", p, float(p)) for p in range(10)], "seq string, pos long, score double")
    assert {r["id"]: r["score"] for r in V.interval_scores(sites, track).collect()} == {1: None, 2: 4.5, 3: None}


def test_extension_without_a_known_length(spark):
    df = spark.createDataFrame([(1, "c", 50, 60, "+"), (2, "x", 50, 60, "+")], SCHEMA)
    lengths = spark.createDataFrame([("c", 100)], "seq string, length long")
    got = {r["id"]: (r["start"], r["end"]) for r in V.extend_intervals(df, lengths).collect()}
    assert got == {1: (0, 100), 2: (0, 160)}


def levelled_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(-50_000, 4_000_000)
        rows.append((i, rng.choice(["x", "y"]), start, start + int(longest ** rng.random()) - rng.choice([0, 0, 1])))
    return rows + [(n, "x", -50_000, 5_000_000), (n + 1, "y", 10, 10), (n + 2, None, 0, 4_000_000), (n + 3, "x", 0, 1_000_000_000)]


@pytest.mark.parametrize("bin_size", [1, 100, 7000])
@pytest.mark.parametrize("left, right", [(4_000_000, 4_000_000), (500, 4_000_000), (2_000_000, 300)])
def test_levelled_bins_list_every_overlap_once(spark, bin_size, left, right):
    a, b = levelled_rows(1, 120, left), levelled_rows(2, 110, right)
    schema = "id long, seq string, start long, end long"
    got = V.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), bin_size)
    want = [(x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and x[1] and max(x[2], y[2]) < min(x[3], y[3])]
    assert sorted((r["a_id"], r["b_id"], r["width"]) for r in got.collect()) == sorted(want)


def test_a_sequence_long_interval_has_few_copies(spark):
    rows = [(i, "x", 100 * i, 100 * i + 90) for i in range(500)] + [(500, "x", 0, 3_000_000_000)]
    df = spark.createDataFrame(rows, "id long, seq string, start long, end long").selectExpr("id AS a_id", "seq AS a_seq", "start AS a_start", "end AS a_end")
    leveled = df.withColumn("_a", V._level(F.col("a_start"), F.col("a_end"), 100))
    every = F.filter(F.sequence(F.lit(0), F.lit(V.LEVELS)), lambda m: m >= F.col("_a"))
    copies = {r["a_id"]: r["n"] for r in V._filed(leveled, "a", every, 100).groupBy("a_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(copies.values()) <= 2 * (V.LEVELS + 1) and copies[500] <= 16
    assert V.overlap_join(df.toDF("id", "seq", "start", "end"), df.toDF("id", "seq", "start", "end"), 100).count() == 500 + 2 * 500 + 1


def _brute_scores(sites, runs, gaps):
    """Mean score base by base."""
    out = {}
    for i, seq, a, b in sites:
        held = [0.0 if any(g[0] == seq and g[1] <= p < g[2] for g in gaps) else sum(v or 0 for s, x, y, v in runs if s == seq and x <= p < y) for p in range(a, b)]
        out[i] = sum(held) / len(held) if held else None
    return out


@pytest.mark.parametrize("form", ["runs", "bases", "mixed"])
def test_scores_of_runs_and_gaps_like_base_by_base(spark, form):
    rng = random.Random(3)
    runs, gaps = [], []
    for seq in ("c", "d"):
        at = 0
        while at < 400:
            at, size = at + rng.randrange(0, 9), rng.randrange(1, 30)
            runs.append((seq, at, at + size, rng.choice([None, 0.0, -1.25, 0.1, 2.5, 100.001])))
            at += size
        gaps += [(seq, g, g + rng.randrange(1, 12)) for g in rng.sample(range(400), 12)]  # gaps may overlap
    sites = [(i, rng.choice("cde"), a, a + rng.randrange(0, 90)) for i, a in enumerate(rng.sample(range(450), 60))]
    track = spark.createDataFrame(runs, "seq string, start long, end long, score double")
    holes = spark.createDataFrame(gaps, "seq string, start long, end long")
    bases = lambda df: df.select("*", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).drop("start", "end").distinct()
    got = V.interval_scores(
        spark.createDataFrame(sites, "id long, seq string, start long, end long"),
        track if form == "runs" else bases(track),
        bases(holes) if form == "bases" else holes,
        bin_size=7,
    )
    want = _brute_scores(sites, runs, gaps)
    assert {r["id"]: r["score"] for r in got.collect()} == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_scores_far_along_a_sequence_keep_their_digits(spark):
    track = spark.createDataFrame([("c", 0, 2_000_000, 1000.0), ("c", 2_000_000, 2_000_001, 1e-9), ("c", 2_000_003, 2_000_004, float("nan"))], "seq string, start long, end long, score double")
    sites = spark.createDataFrame([(1, "c", 2_000_000, 2_000_002), (2, "c", 0, 2_000_000), (3, "c", 2_000_002, 2_000_009), (4, None, 0, 5)], "id long, seq string, start long, end long")
    assert {r["id"]: r["score"] for r in V.interval_scores(sites, track).collect()} == {1: 5e-10, 2: 1000.0, 3: 0.0, 4: 0.0}


def test_scores_list_no_bases(spark):
    sites = spark.createDataFrame([(1, "c", 0, 10**9)], "id long, seq string, start long, end long")
    track = spark.createDataFrame([("c", 5, 10**8 + 5, 0.5)], "seq string, start long, end long, score double")
    gaps = spark.createDataFrame([("c", 0, 15)], "seq string, start long, end long")
    assert V.interval_scores(sites, track, gaps).first()["score"] == pytest.approx((10**8 - 10) * 0.5 / 10**9)
    assert V.interval_scores(sites, track.limit(0)).first()["score"] == 0.0
    assert V.interval_scores(sites.limit(0), track).count() == 0


def test_flags_tell_proper_pairs_mates_and_strands(spark, mode):
    rows = [("p", 10, 99), ("p", 50, 147), ("q", 10, 83), ("q", 50, 163), ("improper", 10, 65), ("improper", 50, 129)]
    rows += [("unmapped", 10, 99 + 4), ("unmapped", 50, 147), ("out", 10, 99), ("out", 900, 147), ("none", 10, None), ("none", 50, 147)]
    reads = spark.createDataFrame([(q, "c", s, s + 3, f) for q, s, f in rows], "qname string, seq string, start long, end long, flag int")
    one = lambda *x: spark.createDataFrame([("c", *x)], "seq string, start long, end long")
    got = V.flagged_reads(reads, one(0, 100))
    assert sorted((r["qname"], r["start"], r["mate"], r["strand"]) for r in got.collect()) == [
        ("none", 50, 2, "-"), ("out", 10, 1, "-"), ("p", 10, 1, "-"), ("p", 50, 2, "-"), ("q", 10, 1, "+"), ("q", 50, 2, "+"), ("unmapped", 50, 2, "-"),
    ]
    bridged = V.bridging_pairs(got, one(8, 14), one(48, 60))
    assert sorted({r["qname"] for r in bridged.collect()}) == ["p", "q"]
    assert V.flagged_reads(reads).count() == 8
