"""Similarity of entity pairs and the selection of partners.

Series are scaled once per entity, so the score of a pair is one unrolled dot
product inside code generation.  Pair lists that are already known are scored by
two equi-joins.  Full products are laid out on a grid of block pairs: each row
carries the numbers of the blocks it must meet and both sides are joined on the
block pair.  Every task then holds two blocks of even size whatever the keys look
like, and a threshold is applied inside the join, so pairs that fail it are never
written.

``by`` names columns (such as a condition) that both entities of a pair must share.  Each of
their values has a grid of its own, as large as its own rows ask for, so one value with most of
the rows is cut into more blocks and the others stay small.  Nulls are a value like others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.vectors import mean, shifted_dot, unit_series
from seriesloom.operators.expression import to_series
from seriesloom.operators.pruned import pruned_pairs
from seriesloom.operators.scan import exact_quantiles, running
from seriesloom.operators.skew import null_safe, salted_join
from seriesloom.session import materialize, shuffle_width


#: Rows of either side that meet in one cell of the grid.
CELL_ROWS = 2000


def _grids(left: DataFrame, right: DataFrame, by: Sequence[str], same: bool, tasks: int) -> DataFrame:
    """``by, _grid, _rows, _cols, _l, _r`` per value of ``by``, stored: the blocks of its two sides.

    Cells hold at most ``CELL_ROWS`` rows a side on average; where that makes fewer cells than a
    value's share of ``tasks``, by its pairs, its longer side is cut further.
    """
    a, b = (df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_l"), (right, "_r")))
    sizes = materialize(null_safe(a, b, by))
    pairs = F.col("_l").cast("double") * F.col("_r")
    share = pairs / sizes.agg(F.sum(pairs)).scalar()
    l, r = F.col("_l"), F.col("_r")
    if same:
        side = F.greatest(F.ceil(l / CELL_ROWS), F.least(l, F.ceil(F.sqrt(share * (tasks / 2)))))
        rows = cols = side
    else:
        rows, cols = F.ceil(l / CELL_ROWS), F.ceil(r / CELL_ROWS)
        few = rows * cols < F.ceil(share * tasks)
        rows, cols = (
            F.when(few & (l > r), F.greatest(rows, F.least(l, F.ceil(share * tasks / cols)))).otherwise(rows),
            F.when(few & (l <= r), F.greatest(cols, F.least(r, F.ceil(share * tasks / rows)))).otherwise(cols),
        )
    return materialize(sizes.select(
        *by, F.monotonically_increasing_id().alias("_grid"), rows.cast("int").alias("_rows"), cols.cast("int").alias("_cols"), "_l", "_r"
    ))


def block_pairs(left: DataFrame, right: DataFrame, key: str, same: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Bring every left row together with every right row of equal ``by``, as an equi-join on block pairs.

    Returns ``by`` and the other columns of both sides as ``a_*`` and ``b_*``.  ``same`` keeps a <= b
    of one table and half of the grid.  Grids follow the rows of both sides, which are stored and
    counted per value of ``by`` first, so a cell never grows with the data.
    """
    by, width = list(by), shuffle_width(left)
    # Without columns to share, all rows share one constant.
    keys = by or ["_all"]
    left, right = (df if by else df.withColumn("_all", F.lit(0)) for df in (left, right))
    left = materialize(left)
    right = left if same else materialize(right)
    grids = _grids(left, right, keys, same, 4 * width)
    cells = grids.agg(F.sum(F.col("_rows").cast("long") * F.col("_cols"))).first()[0] or 1
    # Few rows go in and many pairs come out, so the number of tasks follows the cells and is not
    # left to the size of the shuffle.
    tasks = max(width, cells // 4)
    rows, cols, hashed = F.col("_rows"), F.col("_cols"), F.xxhash64(key)

    def tagged(df: DataFrame, count: str, blocks: Column, cell) -> DataFrame:
        placed = salted_join(df, grids, keys, key_counts=grids.select(*keys, F.col(count).alias("_n")), nulls_meet=True)
        return placed.withColumn("_b", F.pmod(hashed, blocks).cast("int")).withColumn("_cell", F.explode(cell))

    grid = ["_grid", "_cell"]
    mine, theirs = ([c for c in df.columns if c not in keys] for df in (left, right))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    if same:
        # Cells at or above the diagonal: a row is left in its block's row and right in its column.
        as_left = F.transform(F.sequence(F.col("_b"), rows - 1), lambda o: F.col("_b") * rows + o)
        as_right = F.transform(F.sequence(F.lit(0), F.col("_b")), lambda o: o * rows + F.col("_b"))
        a = tagged(left, "_l", rows, as_left).select(*grid, "_rows", *by, F.struct(*mine).alias("_x"))
        b = tagged(left, "_l", rows, as_right).select(*grid, F.struct(*mine).alias("_y"))
        ordered = F.col(f"_x.{key}") <= F.col(f"_y.{key}")
        diagonal = F.floor(F.col("_cell") / rows) == F.pmod(F.col("_cell"), rows)
        met = a.repartition(tasks, *grid).join(b.repartition(tasks, *grid), grid).filter(~diagonal | ordered)
        low = F.when(ordered, F.col("_x")).otherwise(F.col("_y"))
        high = F.when(ordered, F.col("_y")).otherwise(F.col("_x"))
        return met.select(*by, *[low[c].alias(f"a_{c}") for c in mine], *[high[c].alias(f"b_{c}") for c in mine])
    a = tagged(left, "_l", rows, F.transform(up_to(cols), lambda o: F.col("_b") * cols + o))
    b = tagged(right, "_r", cols, F.transform(up_to(rows), lambda o: o * cols + F.col("_b")))
    a = a.select(*grid, *by, *[F.col(c).alias(f"a_{c}") for c in mine])
    b = b.select(*grid, *[F.col(c).alias(f"b_{c}") for c in theirs])
    return a.repartition(tasks, *grid).join(b.repartition(tasks, *grid), grid).drop(*grid)


def scored_series(df: DataFrame, times: Sequence[int], method: str = "cross", by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Entities with their scaled series, and the length of the scaled series."""
    series = df if "series" in df.columns else to_series(df, times, ["entity", *by])
    scaled = unit_series(series, "series", len(times), method, "u").select(*by, "entity", "u")
    return scaled, len(times) - (1 if method == "temporal" else 0)


def pair_corr(
    left: DataFrame,
    right: DataFrame | None,
    times: Sequence[int],
    method: str = "cross",
    lags: Sequence[int] = (0,),
    pairs: DataFrame | None = None,
    min_value: float | None = None,
    min_abs: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Correlate entities of ``left`` with those of ``right``: ``by, a, b, lag, value``.

    ``right=None`` scores one table against itself (a <= b; see ``mirror``).
    ``pairs`` (columns a, b; further ones are kept) restricts the work to listed pairs
    before scoring; a list without the columns ``by`` counts for all their values.
    ``method`` is ``cross`` (Pearson at lag 0) or ``temporal``.
    """
    by = list(by)
    lu, n = scored_series(left, times, method, by)
    extra: list[str] = list(by)
    if pairs is not None:
        ru = lu if right is None else scored_series(right, times, method, by)[0]
        extra += [c for c in pairs.columns if c not in ("a", "b", *by)]
        listed = [c for c in by if c in pairs.columns]
        met = salted_join(pairs, lu.withColumnsRenamed({"entity": "a", "u": "a_u"}), ["a", *listed], nulls_meet=True)
        met = salted_join(met, ru.withColumnsRenamed({"entity": "b", "u": "b_u"}), ["b", *by], nulls_meet=True)
        met = met.select(F.col("a").alias("a_entity"), F.col("b").alias("b_entity"), "a_u", "b_u", *extra)
    elif list(lags) == [0] and (min_value or min_abs or 0):
        # Pairs that cannot reach the threshold are mostly never scored.
        ru = None if right is None else scored_series(right, times, method, by)[0]
        met = pruned_pairs(lu, ru, n, min_abs or min_value, min_abs is not None and min_value is None, by)
    elif right is None:
        met = block_pairs(lu, lu, "entity", same=True, by=by)
    else:
        ru, _ = scored_series(right, times, method, by)
        met = block_pairs(lu, ru, "entity", by=by)
    value = {k: shifted_dot("a_u", "b_u", n, k) for k in lags}
    ids = [F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), *extra]
    if len(lags) == 1:
        out = met.select(*ids, F.lit(lags[0]).alias("lag"), value[lags[0]].alias("value"))
    else:
        per_lag = F.array(*[F.struct(F.lit(k).alias("lag"), v.alias("value")) for k, v in value.items()])
        out = met.select(*ids, F.inline(per_lag))
    if min_value is not None:
        out = out.filter(F.col("value") >= min_value if min_value >= 0 else F.col("value") <= min_value)
    if min_abs is not None:
        out = out.filter(F.abs("value") >= min_abs)
    return out


def mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of a <= b pairs."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.inline(both), *rest)


def distance_from_corr(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", F.abs(F.col("value") - 1.0))


def abs_covariance_sums(df: DataFrame, times: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Sum over all entities j of |sample covariance(i, j)|, i itself included."""
    n = len(times)
    series = to_series(df, times, ["entity", *by])
    centred = series.withColumn("_m", mean("series", n)).select(*by, "entity", F.expr("transform(series, v -> v - _m)").alias("u"))
    met = block_pairs(centred, centred, "entity", same=True, by=by)
    cov = F.abs(shifted_dot("a_u", "b_u", n) / float(n - 1))
    scored = met.select(*by, F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), cov.alias("value"))
    return mirror(scored).groupBy(*by, F.col("a").alias("entity")).agg(F.sum("value").alias("cov_sum"))


#: Plotting positions that one task makes at a time.
POSITIONS = 4096


def covariance_sum_filter(df: DataFrame, times: Sequence[int], quantile: int, by: Sequence[str] = ()) -> DataFrame:
    """Entities above a quantile of the covariance sums and of the |normal| expectation, per value of ``by``.

    ``quantile`` is 1..5 for 0, 25, 50, 75 and 100 %.
    """
    from seriesloom.operators.statistics import normal_positions

    by = list(by)
    q = [0.0, 0.25, 0.5, 0.75, 1.0][quantile - 1]
    sums = materialize(abs_covariance_sums(df, times, by))
    stats = sums.groupBy(*by).agg(F.count("cov_sum").alias("n"), F.avg("cov_sum").alias("m"), F.stddev_samp("cov_sum").alias("s"))
    # The expectation depends on the number of sums alone, so positions are made in parts of even size.
    last = F.floor((F.col("n") - 1) / POSITIONS)
    parts = stats.filter("n > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = parts.repartition(shuffle_width(df), *by, "_part")
    top = F.least(F.col("n"), (F.col("_part") + 1) * POSITIONS)
    ranks = parts.withColumn("rank", F.explode(F.sequence(F.col("_part") * POSITIONS + 1, top)))
    normal = ranks.select(*by, F.abs(F.col("m") + F.col("s") * normal_positions(F.col("rank"), F.col("n"))).alias("v"))
    cut = exact_quantiles(sums, by, "cov_sum", {"q": q}).select(*by, F.col("q").alias("_cut"))
    normal_cut = exact_quantiles(normal, by, "v", {"q": q}).select(*by, F.col("q").alias("_normal"))
    if by:
        cuts = materialize(null_safe(cut, normal_cut, by))
        counts = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        met = salted_join(sums, cuts, by, key_counts=counts, nulls_meet=True)
    else:
        met = sums.withColumns({"_cut": cut.scalar(), "_normal": normal_cut.scalar()})
    return met.filter((F.col("cov_sum") > F.col("_cut")) & (F.col("cov_sum") > F.col("_normal"))).select(*by, "entity", "cov_sum")


@F.pandas_udf(T.DoubleType())
def _dtw(x: pd.Series, y: pd.Series) -> pd.Series:
    """Dynamic time warping of a batch of pairs at once: |x - y| cost, diagonal steps count twice."""
    if len(x) == 0:
        return pd.Series([], dtype="float64")
    xs, ys = np.stack(x.to_numpy()), np.stack(y.to_numpy())
    n, m = xs.shape[1], ys.shape[1]
    cost = np.abs(xs[:, :, None] - ys[:, None, :])
    acc = np.full((len(xs), n + 1, m + 1), np.inf)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            c = cost[:, i - 1, j - 1]
            if i == 1 and j == 1:
                acc[:, 1, 1] = c
                continue
            best = np.minimum(acc[:, i - 1, j] + c, acc[:, i, j - 1] + c)
            acc[:, i, j] = np.minimum(best, acc[:, i - 1, j - 1] + 2 * c)
    return pd.Series(acc[:, n, m])


def pair_dtw(
    left: DataFrame,
    right: DataFrame,
    times: Sequence[int],
    k: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Warping distance of every pair; with ``k`` it is tuned by the temporal correlation.

    The tuned form is distance * 2 / (1 + exp(k * |temporal correlation|)).
    """
    n = len(times)

    def prepared(df: DataFrame) -> DataFrame:
        series = to_series(df, times, ["entity", *by])
        if k is None:
            return series
        return unit_series(series, "series", n, "temporal", "u")

    met = block_pairs(prepared(left), prepared(right), "entity", by=by)
    out = met.withColumn("distance", _dtw("a_series", "b_series"))
    if k is not None:
        cort = F.abs(shifted_dot("a_u", "b_u", n - 1))
        out = out.withColumn("distance", F.col("distance") * 2.0 / (1.0 + F.exp(F.lit(float(k)) * cort)))
    return out.select(*by, F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), "distance")


def drop_nonfinite(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def flatten_matrix(wide: DataFrame, key: str, columns: Sequence[str], threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Wide matrix to ``left, right, value`` and ``by``; a threshold of 0 or None keeps every cell."""
    long = wide.unpivot([key, *by], list(columns), "right", "value").withColumnRenamed(key, "left")
    return long.filter(F.col("value") >= threshold) if threshold else long


def filter_pairs(pairs: DataFrame, threshold: float, mode: str = "signed") -> DataFrame:
    """``signed``: >= t, or <= t below zero; ``abs``: |v| >= t; ``pos``: |v| >= t and v >= t."""
    v = F.col("value")
    if mode == "abs":
        return pairs.filter(F.abs(v) >= threshold)
    if mode == "pos":
        return pairs.filter((F.abs(v) >= threshold) & (v >= threshold))
    return pairs.filter(v >= threshold if threshold >= 0 else v <= threshold)


def sign_filter_pairs(pairs: DataFrame, direction: str) -> DataFrame:
    if direction == "positive":
        return pairs.filter("value >= 0")
    if direction == "negative":
        return pairs.filter("value <= 0")
    raise ValueError("direction must be 'positive' or 'negative'")


def best_partner(
    pairs: DataFrame, by: str | Sequence[str], other: str, mode: str = "max", restrict: DataFrame | None = None, digits: int = 9
) -> DataFrame:
    """The partner with the largest (smallest) value per entity; ties go to the smallest id.

    One aggregation with map-side combine, so an entity with very many partners is
    reduced before the shuffle.  ``digits`` makes ties independent of summation order.
    """
    by = [by] if isinstance(by, str) else list(by)
    if restrict is not None:
        pairs = pairs.join(restrict, restrict.columns, "left_semi")
    v = F.round("value", digits)
    rank = -v if mode == "max" else v
    best = F.min(F.struct(rank.alias("rank"), F.col(other), F.col("value")))
    return pairs.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{other}").alias(other), F.col("_b.value").alias("value"))


def orient_pairs(pairs: DataFrame, first: str, second: str, pattern: str = "^G") -> DataFrame:
    """Name the column that mostly holds genes ``gene_id`` and the other ``lnc_id``.

    The majority is one scalar computed with the plan; a tie is an error.  The pairs are
    stored, since both that scalar and the result read them.
    """
    pairs = materialize(pairs)
    hits = pairs.agg(
        (
            F.sum(F.when(F.col(first).rlike(pattern), 1).otherwise(0))
            - F.sum(F.when(F.col(second).rlike(pattern), 1).otherwise(0))
        ).alias("d")
    ).scalar()
    rest = [c for c in pairs.columns if c not in (first, second)]
    lead = F.when(hits == 0, F.raise_error(F.lit("cannot tell which column holds genes")).cast("boolean")).otherwise(hits > 0)
    return pairs.select(
        F.when(lead, F.col(first)).otherwise(F.col(second)).alias("gene_id"),
        F.when(lead, F.col(second)).otherwise(F.col(first)).alias("lnc_id"),
        *rest,
    )


def cluster_gated_pairs(cluster_pairs: DataFrame, members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """Members of every listed cluster pair: ``a, b, a_cluster, b_cluster`` and the list's columns beside its sets and value.

    Both expansions are equi-joins salted on the cluster, so a cluster with a large
    share of the entities is spread over tasks.
    """
    extra = [c for c in cluster_pairs.columns if c not in ("set1", "set2", "value")]
    gated = cluster_pairs.select(F.col("set1").alias("a_cluster"), F.col("set2").alias("b_cluster"), *extra)
    ma = members_a.select(F.col("cluster").alias("a_cluster"), F.col("entity").alias("a"))
    mb = members_b.select(F.col("cluster").alias("b_cluster"), F.col("entity").alias("b"))
    first = salted_join(ma, gated, "a_cluster")
    return salted_join(first, mb, "b_cluster").select("a", "b", "a_cluster", "b_cluster", *extra)


def random_matched_pairs(
    targets: DataFrame,
    pool: DataFrame,
    others: DataFrame,
    seed: int,
    mean_tolerance: float = 1.0,
    length_tolerance: float = 1000.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Seeded null pairs: pool entities matched to some target of equal ``by``, each with a random other.

    ``targets`` and ``pool`` have entity, mean and length.  A pool entity qualifies if
    another target lies within both tolerances.  Mean and length are cut into cells as
    wide as the tolerances, so matching joins neighbouring cells; targets are first
    reduced to the extremes of (mean, length) needed per small cell, never paired out.
    """
    by, per_cell = list(by), 2
    wm, wl = mean_tolerance / per_cell, length_tolerance / per_cell

    def cell(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"_m": F.floor(F.col("mean") / wm).cast("long"), "_l": F.floor(F.col("length") / wl).cast("long")}
        )

    # Within a target's reach every cell closer than per_cell steps matches whole; only the
    # rim cells need exact comparison.  Rim and whole cells both come from one join on cells.
    span = F.sequence(F.lit(-per_cell), F.lit(per_cell))
    cells = cell(targets).groupBy(*by, "_m", "_l").agg(
        F.min("mean").alias("m_lo"),
        F.max("mean").alias("m_hi"),
        F.min("length").alias("l_lo"),
        F.max("length").alias("l_hi"),
        F.min("entity").alias("e_lo"),
        F.max("entity").alias("e_hi"),
    )
    near = cells.select("*", F.explode(span).alias("_dm")).select("*", F.explode(span).alias("_dl"))
    near = near.filter((F.abs("_dm") <= per_cell) & (F.abs("_dl") <= per_cell)).select(
        (F.col("_m") + F.col("_dm")).alias("_pm"), (F.col("_l") + F.col("_dl")).alias("_pl"), "_m", "_l",
        *by, "m_lo", "m_hi", "l_lo", "l_hi", "e_lo", "e_hi",
    )
    p = cell(pool).select(*by, "entity", "mean", "length", F.col("_m").alias("_pm"), F.col("_l").alias("_pl"))
    met = materialize(salted_join(p, near, [*by, "_pm", "_pl"], nulls_meet=True))
    whole = (
        (F.greatest(F.abs(F.col("mean") - F.col("m_lo")), F.abs(F.col("mean") - F.col("m_hi"))) <= mean_tolerance)
        & (F.greatest(F.abs(F.col("length") - F.col("l_lo")), F.abs(F.col("length") - F.col("l_hi"))) <= length_tolerance)
        & ((F.col("e_lo") != F.col("entity")) | (F.col("e_hi") != F.col("entity")))
    )
    none = (F.col("m_lo") - F.col("mean") > mean_tolerance) | (F.col("mean") - F.col("m_hi") > mean_tolerance)
    none = none | (F.col("l_lo") - F.col("length") > length_tolerance) | (F.col("length") - F.col("l_hi") > length_tolerance)
    sure = met.filter(whole).select(*by, "entity").distinct()
    known = F.lit(True)
    for c in [*by, "entity"]:
        known = known & F.col(f"_x.{c}").eqNullSafe(F.col(f"_s.{c}"))
    rim = met.filter(~whole & ~none).alias("_x").join(sure.alias("_s"), known, "left_anti")
    inside = cell(targets).select(*by, "_m", "_l", F.col("entity").alias("t"), F.col("mean").alias("tm"), F.col("length").alias("tl"))
    checked = (
        salted_join(rim.select(*by, "entity", "mean", "length", "_m", "_l"), inside, [*by, "_m", "_l"], nulls_meet=True)
        .filter((F.col("t") != F.col("entity")) & (F.abs(F.col("tm") - F.col("mean")) <= mean_tolerance))
        .filter(F.abs(F.col("tl") - F.col("length")) <= length_tolerance)
        .select(*by, "entity")
        .distinct()
    )
    matched = sure.union(checked)

    def numbered(df: DataFrame, out: str, salt: str) -> DataFrame:
        """``by``, the entity as ``out`` and its place ``_rn`` within ``by`` by a seeded hash."""
        key = F.md5(F.concat(F.col("entity"), F.lit(f"|{salt}|{seed}")))
        hashed = df.select(*by, F.col("entity").alias(out), F.conv(F.substring(key, 1, 12), 16, 10).cast("long").alias("_h"))
        hashed = materialize(hashed)
        counts = hashed.groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"))
        before = running(counts, by, "_h", {"_before": ("sum", F.col("_n"))}, inclusive=False).drop("_n")
        # Entities of one hash are few, they stand by name.
        own = F.row_number().over(Window.partitionBy(*by, "_h").orderBy(out))
        placed = null_safe(hashed.withColumn("_own", own), before, [*by, "_h"])
        return placed.select(*by, out, (F.coalesce("_before", F.lit(0)) + F.col("_own")).alias("_rn"))

    # With fewer others than pool entities the others are reused in the same order.
    there = materialize(numbered(others, "b", "other"))
    sizes = there.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    picked = numbered(matched, "a", "pool")
    if by:
        counts = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        picked = salted_join(picked, sizes, by, key_counts=counts, nulls_meet=True)
    else:
        picked = picked.withColumn("_size", F.greatest(sizes.scalar(), F.lit(1)))
    picked = picked.withColumn("_rn", F.pmod(F.col("_rn") - 1, F.col("_size")) + 1)
    return null_safe(picked, there, [*by, "_rn"]).select(*by, "a", "b")


def partners_per_entity(pairs: DataFrame, by: str | Sequence[str], other: str, name: str = "n_partners") -> DataFrame:
    by = [by] if isinstance(by, str) else by
    return pairs.groupBy(*by).agg(F.count_distinct(other).alias(name))


def any_exceeds(pairs: DataFrame, by: Sequence[str], threshold: float, direction: str) -> DataFrame:
    """Groups with at least one value above the threshold (below its negative)."""
    hit = F.col("value") > threshold if direction == "positive" else F.col("value") < -threshold
    return pairs.groupBy(*by).agg(F.bool_or(hit).alias("_hit")).filter("_hit").drop("_hit")


def classify_correlated(
    pairs: DataFrame, classes: DataFrame, wanted: str, direction: str, threshold: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Pairs whose left entity has the class, by sign, finite, one row per (``by``, pair, value)."""
    out = pairs.join(classes.filter(F.col("class") == wanted).select(F.col("entity").alias("a")), "a", "left_semi")
    out = drop_nonfinite(sign_filter_pairs(out, direction))
    if threshold is not None:
        out = out.filter(F.abs("value") >= threshold)
    return out.dropDuplicates([*by, "a", "b", "value"])


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the last row per key along an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
