"""Tests and multiple-testing adjustment as aggregations and chunked scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.numeric import (
    bisect_mode,
    hypergeometric_pmf,
    normal_sf,
    probit,
    safe_div,
    t_two_sided,
    walk_tail,
)
from seriesloom.operators.intervals import first_per_group, interval_scores, overlap_join
from seriesloom.operators.scan import global_row_number, running
from seriesloom.operators.skew import null_safe, salted_join
from seriesloom.session import materialize, shuffle_width

#: Sites and values of a sequence that meet in one task on average at most.
SITES_HELD, VALUES_HELD = 2000, 1_000_000
#: Draws of a task on average, and draws whose hashes are held at once.
DRAWS_A_TASK, DRAWS_AT_ONCE = 3_000_000, 100_000


def midrank(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value with its count (ties share their mean rank)."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_ties"))
    ranked = running(counts, keys, value, {"_cum": ("sum", F.col("n_ties"))})
    return ranked.select(*keys, value, "n_ties", (F.col("_cum") - (F.col("n_ties") - 1) / 2).alias("midrank"))


def ecdf_rank(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows up to each distinct value."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, value, {"_cum": ("sum", F.col("_n"))})
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
        weights = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        out = salted_join(ranked, sizes, keys, key_counts=weights, nulls_meet=True)
    else:
        out = ranked.withColumn("_size", counts.agg(F.sum("_n")).scalar())
    return out.select(*keys, value, (F.col("_cum") / F.col("_size")).alias("ecdf"))


def normal_positions(rank: Column, n: Column) -> Column:
    """Normal quantile of the plotting position (i - a) / (n + 1 - 2a); a is 3/8 up to n = 10, else 1/2."""
    a = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return probit((rank - a) / (n + 1 - 2 * a))


def plotting_positions(df: DataFrame, value: str, key: str) -> DataFrame:
    """Plotting position (i - a) / (n + 1 - 2a) by rank and its normal quantile; a is 3/8 up to n = 10, else 1/2."""
    numbered = global_row_number(df.select(key, value), [value, key], "rank")
    n = df.agg(F.count(F.lit(1))).scalar()
    a = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    p = (F.col("rank") - a) / (n + 1 - 2 * a)
    return numbered.withColumn("position", p).withColumn("quantile", probit(F.col("position")))


def label_pairs(df: DataFrame, label: str) -> Column:
    """Array of all ordered pairs (first < second) of the labels, as one scalar of the plan.

    Labels are design levels (conditions, categories), so the array is short.
    """
    labels = F.array_sort(F.collect_set(label))
    pairs = F.flatten(
        F.transform(
            labels,
            lambda x: F.transform(
                F.filter(labels, lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second"))
            ),
        )
    )
    return df.agg(pairs.alias("p")).scalar()


def unordered_pairs(df: DataFrame, label: str, with_self: bool = False) -> DataFrame:
    """One row per pair of labels."""
    out = df.agg(F.lit(1).alias("_one")).select(F.inline(label_pairs(df, label)))
    if with_self:
        own = df.select(label).distinct()
        out = out.unionByName(own.select(F.col(label).alias("first"), F.col(label).alias("second")))
    return out


#: The law of W is tabulated for samples smaller than this at most: under 2,401 pairs of sizes, of at most 2,402 chances each.
EXACT_MOST = 50


def upper_tails(n1: int, n2: int) -> list[float]:
    """P(W >= w) for w = 0 .. n1 * n2 when all orders of two samples without ties are equally likely.

    The orders with each w are counted by the product of (1 - q^(n2+i)) / (1 - q^i) over i = 1 .. n1, in whole numbers.
    """
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for w in range(len(counts) - 1, n2 + i - 1, -1):
            counts[w] -= counts[w - n2 - i]
        for w in range(i, len(counts)):
            counts[w] += counts[w - i]
    total, above, out = sum(counts), 0, []
    for n in reversed(counts):
        above += n
        out.append(above / total)
    return out[::-1]


def _tail_table(sizes: DataFrame) -> DataFrame:
    """``n1, n2, _tails`` for the distinct ``sizes(n1, n2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist()):
                columns = [pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([upper_tails(a, b)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["n1", "n2", "_tails"])

    return sizes.mapInArrow(run, "n1 bigint, n2 bigint, _tails array<double>")


def _with_tails(stats: DataFrame, below: int) -> DataFrame:
    """``stats`` and the chances ``_ge``, ``_le`` of a W as large, as small; null where a sample is too large or values are tied."""
    stats = materialize(stats)
    small = (F.col("n1") < below) & (F.col("n2") < below) & (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("_ties") == 0)
    table = _tail_table(stats.filter(small).select("n1", "n2").distinct())
    at = F.col("w").cast("int")
    found = stats.join(F.broadcast(table), ["n1", "n2"], "left").withColumn("_tails", F.when(small, F.col("_tails")))  # bounded by EXACT_MOST
    turned = (F.col("n1") * F.col("n2")).cast("int") - at  # the law is symmetric
    return found.withColumns({"_ge": F.get("_tails", at), "_le": F.get("_tails", turned)}).drop("_tails")


def rank_sum(
    df: DataFrame,
    category: str = "category",
    value: str = "value",
    alternative: str = "greater",
    first: Sequence[str] = (),
    by: Sequence[str] = (),
    exact_below: int = 0,
) -> DataFrame:
    """Wilcoxon rank-sum for every pair of categories of a value of ``by``, normal approximation.

    Where both samples are smaller than ``exact_below`` and no value is tied, the p-value comes from
    the exact law of W instead; ``z`` is that of the approximation everywhere.

    W counts the pairs (x, y) with x > y, ties half; tie and continuity correction as
    usual.  ``first`` lists categories that lead a pair in that order, the rest follow
    by name.  Values are counted per category before anything is ordered, and the
    order is scanned in chunks, so neither a hot value nor a hot category matters.
    """
    rank = F.lit(len(first))
    for i, name in enumerate(first):
        rank = F.when(F.col(category) == name, i).otherwise(rank)
    named = df.filter(F.col(value).isNotNull()).withColumn("_cat", F.concat(F.lpad(rank.cast("string"), 4, "0"), F.col(category)))
    counts = named.groupBy(*by, "_cat", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    mine = F.filter(F.col("_pairs"), lambda p: (p["first"] == F.col("_cat")) | (p["second"] == F.col("_cat")))
    counts = materialize(counts)
    pair = [*by, "first", "second"]
    listed = counts.withColumn("_pairs", label_pairs(counts, "_cat"))
    paired = listed.select(*by, "_cat", "_v", "_n", F.inline(mine)).groupBy(*pair, "_v").agg(
        F.sum(F.when(F.col("_cat") == F.col("first"), F.col("_n")).otherwise(0)).alias("nx"),
        F.sum(F.when(F.col("_cat") == F.col("second"), F.col("_n")).otherwise(0)).alias("ny"),
    )
    below = running(paired, pair, "_v", {"_ycum": ("sum", F.col("ny"))})
    t = (F.col("nx") + F.col("ny")).cast("double")
    stats = below.groupBy(*pair).agg(
        F.sum("nx").alias("n1"),
        F.sum("ny").alias("n2"),
        F.sum(F.col("nx") * (F.col("_ycum") - F.col("ny") / 2)).alias("w"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    if by:  # a value of ``by`` need not have all categories
        stats = stats.filter("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - safe_div(F.col("_ties"), n * (n - 1.0))))
    centred = F.col("w") - n1 * n2 / 2.0
    if not 0 <= exact_below <= EXACT_MOST:
        raise ValueError(f"exact_below must be from 0 to {EXACT_MOST}")
    if exact_below:
        stats = _with_tails(stats, exact_below)
    if alternative == "greater":
        z = safe_div(centred - 0.5, sigma)
        p = normal_sf(F.col("z"))
        exact = F.col("_ge")
    elif alternative == "two-sided":
        z = safe_div(centred - F.signum(centred) * 0.5, sigma)
        p = F.least(2.0 * normal_sf(F.abs("z")), F.lit(1.0))
        exact = F.least(2.0 * F.least("_ge", "_le"), F.lit(1.0))
    else:
        raise ValueError("alternative must be 'greater' or 'two-sided'")
    if exact_below:
        p = F.when(F.col("_ge").isNotNull(), exact).otherwise(p)
    return stats.withColumn("z", z).select(
        *by, F.substring("first", 5, 1 << 20).alias("cat1"), F.substring("second", 5, 1 << 20).alias("cat2"), "n1", "n2", "w", "z", p.alias("pvalue")
    )


def exact_p(
    df: DataFrame, hits: Column, good: Column, drawn: Column, total: Column, alternative: str, out: str = "pvalue"
) -> DataFrame:
    """Hypergeometric p-value per row: ``greater`` (upper tail) or ``two-sided`` (Fisher).

    Tails are summed away from the mode, where they fall: the table's own from its count on, the
    other one from the first count that is no likelier, found by bisection.  From wherever a tail
    starts, terms more than twelve standard deviations further out lie below double precision of
    its first, which bounds the number of steps.
    """
    d = df.withColumns({"_k": hits.cast("double"), "_g": good.cast("double"), "_n": drawn.cast("double"), "_t": total.cast("double")})
    d = d.withColumns(
        {
            "_lo": F.expr("greatest(0D, _n + _g - _t)"),
            "_hi": F.expr("least(_n, _g)"),
            "_mode": F.expr("double(floor((_n + 1) * (_g + 1) / (_t + 2)))"),
            "_reach": F.expr("60 + ceil(12 * sqrt(coalesce(try_divide(_n * _g * (_t - _g) * (_t - _n), _t * _t * (_t - 1)), 0D)))"),
            "_pk": hypergeometric_pmf("_k", "_g", "_n", "_t"),
        }
    )
    law = ("_g", "_n", "_t")
    up = walk_tail("_k", "_pk", "least(_hi - _k + 1, _reach)", *law, True)
    k, lo, mode = F.col("_k"), F.col("_lo"), F.col("_mode")
    if alternative == "greater":
        d = d.withColumn("_before", F.greatest(k - 1.0, lo)).withColumn("_pb", hypergeometric_pmf("_before", *law))
        below = walk_tail("_before", "_pb", "least(_k - _lo, _reach)", *law, False)
        p = F.when(k <= lo, F.lit(1.0)).when(k > mode, up).otherwise(1.0 - below)
    elif alternative == "two-sided":
        d = d.withColumns({"_pm": hypergeometric_pmf("_mode", *law), "_cap": F.expr("_pk * (1 + 1e-7D)")})
        down = walk_tail("_k", "_pk", "least(_k - _lo + 1, _reach)", *law, False)
        d = d.withColumns({"_down": bisect_mode(False, *law), "_up": bisect_mode(True, *law)})
        d = d.withColumns({"_pd": hypergeometric_pmf("_down", *law), "_pu": hypergeometric_pmf("_up", *law)})
        other_down = walk_tail("_down", "_pd", "least(_down - _lo + 1, _reach)", *law, False)
        other_up = walk_tail("_up", "_pu", "least(_hi - _up + 1, _reach)", *law, True)
        p = F.when(k > mode, up + other_down).when(k < mode, down + other_up).otherwise(F.lit(1.0))
    else:
        raise ValueError("alternative must be 'greater' or 'two-sided'")
    kept = [c for c in df.columns if c != out]
    return d.select(*kept, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias(out))


def fisher(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Exact test of 2x2 counts a, b, c, d (rows a b / c d) with the sample odds ratio."""
    a, b, c, d = (F.col(x) for x in "abcd")
    odds = safe_div(a.cast("double") * d, (b * c).cast("double"))
    return exact_p(df.withColumn("odds", odds), a, a + b, a + c, a + b + c + d, alternative)


def p_adjust(
    df: DataFrame, p: str = "pvalue", method: str = "BH", out: str = "padj", by: Sequence[str] = ()
) -> DataFrame:
    """Benjamini-Hochberg, Holm or Bonferroni over all rows or per group; null stays null.

    Equal p-values share their result, so distinct values are counted and scanned and
    the result is joined back by value.  The input is materialized first, so that both
    sides hold the same bits.  Null group keys are a group like others.
    """
    by = list(by)
    df = materialize(df)
    counts = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))

    def sized(part: DataFrame) -> DataFrame:
        if by:
            sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
            weights = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
            return salted_join(part, sizes, by, key_counts=weights, nulls_meet=True)
        return part.withColumn("_size", counts.agg(F.sum("_n")).scalar())

    if method == "bonferroni":
        table = sized(counts).withColumn("_adj", F.col(p) * F.col("_size"))
    else:
        ranked = sized(running(counts, by, p, {"_cum": ("sum", F.col("_n"))}))
        if method == "BH":
            raw = ranked.withColumn("_raw", F.col(p) * F.col("_size") / F.col("_cum"))
            table = running(raw, by, p, {"_adj": ("min", F.col("_raw"))}, reverse=True)
        elif method == "holm":
            raw = ranked.withColumn("_raw", F.col(p) * (F.col("_size") - F.col("_cum") + F.col("_n")))
            table = running(raw, by, p, {"_adj": ("max", F.col("_raw"))})
        else:
            raise ValueError(f"unknown method {method!r}")
    lookup = table.select(*by, p, F.least(F.col("_adj"), F.lit(1.0)).alias(out))
    return salted_join(df, lookup, by + [p], "left", key_counts=counts, nulls_meet=True).select(*df.columns, out)


def de_contrast(df: DataFrame, first: str, second: str, group: str = "condition", value: str = "value") -> DataFrame:
    """log2 ratio of means, Welch statistic with normal p and BH per entity (first / second)."""

    def part(agg, name: str) -> Column:
        return agg(F.when(F.col(group) == name, F.col(value)))

    stats = df.groupBy("entity").agg(
        part(F.avg, first).alias("m1"), part(F.avg, second).alias("m2"),
        part(F.var_samp, first).alias("v1"), part(F.var_samp, second).alias("v2"),
        part(F.count, first).alias("n1"), part(F.count, second).alias("n2"),
    )
    se = F.sqrt(safe_div(F.col("v1"), F.col("n1")) + safe_div(F.col("v2"), F.col("n2")))
    z = safe_div(F.col("m1") - F.col("m2"), se)
    ratio = safe_div(F.col("m1"), F.col("m2"))
    out = stats.select(
        "entity",
        F.when(ratio > 0, F.ln(ratio) / F.ln(F.lit(2.0))).alias("log2fc"),
        F.least(2.0 * normal_sf(F.abs(z)), F.lit(1.0)).alias("pvalue"),
    )
    return p_adjust(out, "pvalue", "BH", "padj")


def token_enrichment(pairs: DataFrame, left: DataFrame, right: DataFrame, tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per value of ``by`` and token: is it commoner among the left than among the right entities of the pairs?

    One-sided exact test per listed token, Holm-adjusted within ``by``.  Entities count once however
    many pairs they are in.
    """
    by = list(by)
    pairs = materialize(pairs.select(*by, "a", "b"))
    sides = []
    for side, catalog, n, t in (("a", left, "n_a", "t_a"), ("b", right, "n_b", "t_b")):
        chosen = materialize(pairs.select(*by, F.col(side).alias("entity")).distinct())
        # An entity's values of ``by`` stay together as a list: its rows of the catalog, which is read once, meet one row.
        where = chosen.groupBy("entity").agg(F.collect_list(F.struct(*by)).alias("_where")) if by else chosen
        holders = salted_join(catalog.select("entity", "token"), where, "entity")
        held = holders.select("token", F.inline("_where")) if by else holders
        sides.append((held.groupBy(*by, "token").agg(F.count(F.lit(1)).alias(n)), chosen.groupBy(*by).agg(F.count(F.lit(1)).alias(t))))
    (with_a, t_a), (with_b, t_b) = sides
    listed = tokens.select("token").distinct()
    if by:
        # Every token is tested under every value of ``by``; these are design levels, so the array is short.
        totals = null_safe(t_a, t_b, by).agg(F.collect_list(F.struct(*by, "t_a", "t_b"))).scalar()
        per = listed.withColumn("_totals", totals).select("token", F.inline("_totals"))
    else:
        per = listed.withColumns({"t_a": t_a.scalar(), "t_b": t_b.scalar()})
    per = null_safe(null_safe(per, with_a, [*by, "token"], "left"), with_b, [*by, "token"], "left").na.fill({"n_a": 0, "n_b": 0})
    a, b, ta, tb = F.col("n_a"), F.col("n_b"), F.col("t_a"), F.col("t_b")
    forced = (a + b == 0) | ((a == ta) & (b == tb))
    odds = safe_div(a.cast("double") * (tb - b), (b * (ta - a)).cast("double"))
    per = materialize(per.withColumn("odds", F.when(forced, F.lit(1.0)).otherwise(odds)))
    # Many tokens have the same counts; each set of counts is tested once, in as many tasks as there are.
    table = ["n_a", "n_b", "t_a", "t_b"]
    counts = materialize(per.groupBy(*table).agg(F.count(F.lit(1)).alias("_n")))
    tested = exact_p(counts.select(*table).repartition(shuffle_width(per), *table), a, a + b, ta, ta + tb, "greater")
    per = salted_join(per, materialize(tested), table, key_counts=counts).select(*per.columns, "pvalue")
    return p_adjust(per, "pvalue", "holm", "qvalue", by)


def over_representation(
    hits: DataFrame, members: DataFrame, by: Sequence[str] = (), strata: DataFrame | None = None
) -> DataFrame:
    """Categories over-represented among hit ids, against all ids of ``members``.

    ``members`` holds (id, category) of the whole background, ``hits`` the chosen ids
    (with the columns ``by`` for several hit sets).  Upper hypergeometric tail, fold
    enrichment, BH within each hit set.  ``strata`` (id, stratum) adds the count expected
    if hits had the same strata, which removes a length bias.
    """
    by = list(by)
    ids = members.select("id").distinct()
    total = ids.agg(F.count(F.lit(1))).scalar()
    kept = hits.select(*by, "id").distinct().join(ids, "id", "left_semi")
    hit_sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hits"))
    cats = members.select("id", "category").distinct()
    in_cat = cats.groupBy("category").agg(F.count(F.lit(1)).alias("n_cat"))
    hit_cat = kept.join(cats, "id").groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n_hit"))
    # Hit sets and categories are dimensions: one row each after aggregation.
    out = hit_cat.join(in_cat, "category")
    out = out.join(hit_sizes, by) if by else out.withColumn("n_hits", hit_sizes.select("n_hits").scalar())
    out = out.withColumn("n_total", total)
    fold = (F.col("n_hit") / F.col("n_hits")) / (F.col("n_cat") / F.col("n_total"))
    out = out.withColumn("fold", F.round(fold, 3))
    out = exact_p(out, F.col("n_hit"), F.col("n_cat"), F.col("n_hits"), F.col("n_total"), "greater")
    if strata is not None:
        layered = strata.select("id", "stratum")
        rate_hits = kept.join(layered, "id").groupBy(*by, "stratum").agg(F.count(F.lit(1)).alias("_h"))
        rate_all = ids.join(layered, "id").groupBy("stratum").agg(F.count(F.lit(1)).alias("_all"))
        rates = rate_hits.join(rate_all, "stratum").withColumn("_rate", F.col("_h") / F.col("_all"))
        cat_strata = cats.join(layered, "id").groupBy("category", "stratum").agg(F.count(F.lit(1)).alias("_c"))
        expected = cat_strata.join(rates, "stratum").groupBy(*by, "category").agg(
            F.sum(F.col("_c") * F.col("_rate")).alias("expected")
        )
        out = out.join(expected, [*by, "category"], "left")
    return p_adjust(out, "pvalue", "BH", "padj", by=by)


def category_overlap_test(
    cluster_pairs: DataFrame, terms: DataFrame, max_q: float | None = 0.01, by: Sequence[str] = ()
) -> DataFrame:
    """Do the term sets of two clusters overlap more than expected?  Two-sided, BH over the pairs of a value of ``by``.

    ``cluster_pairs`` has ``by``, set1 and set2; ``terms`` has cluster and term.  A pair that several
    values of ``by`` list is counted once.
    """
    terms = terms.select("cluster", "term").distinct()
    sizes = terms.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    universe = terms.select("term").distinct().agg(F.count(F.lit(1))).scalar()
    listed = cluster_pairs.select(*by, "set1", "set2").filter("set1 <> set2")
    listed = materialize(listed) if by else listed
    pairs = listed.select("set1", "set2").distinct() if by else listed
    first = salted_join(pairs, terms.select(F.col("cluster").alias("set1"), "term"), "set1")
    both = salted_join(first, terms.select(F.col("cluster").alias("set2"), "term"), ["set2", "term"])
    shared = both.groupBy("set1", "set2").agg(F.count(F.lit(1)).alias("a"))
    table = (
        pairs.join(sizes.select(F.col("cluster").alias("set1"), F.col("n").alias("_n1")), "set1")
        .join(sizes.select(F.col("cluster").alias("set2"), F.col("n").alias("_n2")), "set2")
        .join(shared, ["set1", "set2"], "left")
        .na.fill({"a": 0})
        .withColumn("b", F.col("_n2") - F.col("a"))
        .withColumn("c", F.col("_n1") - F.col("a"))
        .withColumn("d", universe - F.col("a") - F.col("b") - F.col("c"))
        .drop("_n1", "_n2")
    )
    tested = fisher(table)
    if by:
        tested = listed.join(tested, ["set1", "set2"])
    out = p_adjust(tested, "pvalue", "BH", "qvalue", by)
    return out if max_q is None else out.filter(F.col("qvalue") < max_q)


def empirical_pvalue(
    sites: DataFrame,
    hosts: DataFrame,
    track: DataFrame,
    perms: int = 100,
    seed: int = 1,
    edge: int = 5,
    host_bin: int = 1000,
    gaps: DataFrame | None = None,
) -> DataFrame:
    """Score of each site and its upper-tail p under random draws from its host.

    Every permutation draws as many single bases as the site is long, from the first
    host that overlaps it, leaving out ``edge`` bases at both ends and the site itself;
    hosts of at most 2 * edge bases have a null of 0.  Draws are hashes of (site,
    permutation, draw, seed), so they do not depend on partitioning.
    """
    observed = materialize(interval_scores(sites, track, gaps))
    site_cols = sites.select("id", "seq", "start", "end")
    hosted = first_per_group(
        overlap_join(site_cols, hosts.select("seq", "start", "end"), host_bin), ["a_id"], ["b_start", "b_end"]
    ).select(
        F.col("a_id").alias("id"),
        F.col("a_seq").alias("seq"),
        F.col("b_start").alias("h0"),
        (F.col("b_end") - F.col("b_start")).alias("size"),
        (F.col("a_end") - F.col("a_start")).alias("len"),
        # the site as offsets in the host, cut to the part that may be drawn
        F.greatest(F.col("a_start") - F.col("b_start"), F.lit(edge)).alias("m0"),
        F.least(F.col("a_end") - F.col("b_start"), F.col("b_end") - F.col("b_start") - edge + 1).alias("m1"),
    )
    located = materialize(hosted)
    masked = F.greatest(F.col("m1") - F.col("m0"), F.lit(0))
    room = located.withColumn("masked", masked).withColumn("room", F.col("size") - 2 * edge + 1 - F.col("masked"))
    room = room.filter((F.col("size") > 2 * edge) & (F.col("room") > 0) & (F.col("len") > 0)).drop("size")
    values = track.select("seq", "pos", F.col("score").cast("double").alias("score"))
    if gaps is not None:
        values = values.join(gaps.select("seq", "pos"), ["seq", "pos"], "left_anti")
    room = room.join(observed, "id")
    compared = _nulls_above(room, values, perms, seed, edge)
    # A null of 0 lies above the observed score only if that is negative.
    short = F.when(F.col("score") < 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        observed.join(located.select("id"), "id", "left_semi")
        .join(compared, "id", "left")
        .select("id", "score", F.coalesce(F.col("_above") / F.lit(perms), short).alias("pvalue"))
    )


@lru_cache(4)
def _endings(perms: int, seed: int, first: int, last: int) -> list[bytes]:
    """What follows the id in the hashed text of draws ``first`` to ``last``, permutation by permutation."""
    return [f"|{p}|{d}|{seed}".encode() for p in range(1, perms + 1) for d in range(first, last)]


def _nulls_above(room: DataFrame, values: DataFrame, perms: int, seed: int, edge: int) -> DataFrame:
    """``id, _above``: permutations whose mean over the drawn bases is above the observed score.

    Draws are made beside the values they look up, so that no draw is a row that travels.  The sites of a sequence
    come in parts of bounded size, and so do its values: every part of the sites meets every one of the
    values.  Only sites of a sequence with several parts of values have their sums added up by a shuffle.
    """
    part = ["seq", "_i", "_j"]
    room = materialize(room)
    values = materialize(values.filter(F.col("seq").isNotNull()).select("seq", "pos", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("value")))
    held = values.groupBy("seq").agg(F.count(F.lit(1)).alias("_values"))
    sizes = room.groupBy("seq").agg(F.count(F.lit(1)).alias("_sites")).join(held, "seq", "left").na.fill({"_values": 1})
    sizes = materialize(sizes.select("*", F.ceil(F.col("_sites") / SITES_HELD).cast("int").alias("_is"), F.ceil(F.col("_values") / VALUES_HELD).cast("int").alias("_js")))
    own = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    draws = room.agg(F.sum(F.col("len") * perms)).first()[0] or 1
    tasks = max(shuffle_width(room), draws // DRAWS_A_TASK)

    def met(df: DataFrame, count: str, i: Column, j: Column) -> DataFrame:
        counts = sizes.select("seq", F.col(count).alias("_n"))
        return salted_join(df, sizes.select("seq", "_is", "_js"), "seq", key_counts=counts).withColumn("_i", i).withColumn("_j", j)

    drawn = ["h0", "m0", "masked", "room", "len"]
    longs = [F.col(c).cast("long").alias(c) for c in drawn]
    left = met(room, "_sites", own("id", "_is"), up_to("_js")).select(*part, "id", F.col("id").cast("string").alias("name"), *longs, "score", "_js")
    right = met(values, "_values", up_to("_is"), own("pos", "_js")).select(*part, F.col("pos").cast("long").alias("pos"), "value")
    kept = ["id", "len", "score", "_js"]

    def run(sites: pa.Table, track: pa.Table) -> pa.Table:
        pos, at = np.unique(track["pos"].to_numpy(), return_inverse=True)
        # A base with several scores counts as often; places after the last one stand for no score.
        total, more = np.zeros(len(pos) + 1), np.zeros(len(pos) + 1)
        np.add.at(total, at, track["value"].to_numpy())
        np.add.at(more, at, 1)
        more = np.maximum(more - 1, 0)
        pos = np.r_[pos, np.iinfo(np.int64).max]
        sums, extra = np.zeros((2, sites.num_rows, perms))
        for k, (name, h0, m0, masked, free, size) in enumerate(zip(*(sites[c].to_pylist() for c in ["name", *drawn]))):
            start, step = name.encode(), max(1, DRAWS_AT_ONCE // perms)
            for first in range(1, size + 1, step):
                digests = b"".join([md5(start + end).digest() for end in _endings(perms, seed, first, min(size + 1, first + step))])
                offset = edge + np.frombuffer(digests, ">u4")[::4].astype(np.int64) % free
                if masked > 0:
                    offset[offset >= m0] += masked
                offset += h0
                found = np.searchsorted(pos, offset)
                found[pos[found] != offset] = len(pos) - 1
                sums[k] += total[found].reshape(perms, -1).sum(1)
                extra[k] += more[found].reshape(perms, -1).sum(1)
        lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (sums, extra)]
        return pa.table([*[sites[c] for c in kept], *lists], [*kept, "sums", "extra"])

    fields = [*[left.schema[c] for c in kept], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("sums", "extra")]]
    found = left.repartition(tasks, *part).groupBy(*part).cogroup(right.repartition(tasks, *part).groupBy(*part)).applyInArrow(run, T.StructType(fields))
    above = lambda null: F.round(null, 9) > F.round(F.col("score"), 9)
    nulls = F.zip_with("sums", "extra", lambda s, e: s / (F.col("len") + e))
    if sizes.filter("_js > 1").isEmpty():
        return found.select("id", F.size(F.filter(nulls, above)).alias("_above"))
    found = materialize(found)
    pieces = found.filter("_js > 1").select("id", "len", "score", F.posexplode(F.arrays_zip("sums", "extra")).alias("perm", "_at"))
    whole = pieces.groupBy("id", "perm").agg(F.first("len").alias("len"), F.first("score").alias("score"), F.sum("_at.sums").alias("s"), F.sum("_at.extra").alias("e"))
    counted = whole.groupBy("id").agg(F.sum(F.when(above(F.col("s") / (F.col("len") + F.col("e"))), 1).otherwise(0)).cast("int").alias("_above"))
    return found.filter("_js = 1").select("id", F.size(F.filter(nulls, above)).alias("_above")).unionByName(counted)


def conservation_summary(scored: DataFrame, by: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """Mean score, sites, significant sites and their percentage per target."""
    sig = F.sum(F.when(F.col("pvalue") < alpha, 1).otherwise(0))
    return (
        scored.groupBy(*by)
        .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_sites"), sig.alias("n_sig"))
        .withColumn("pct_sig", F.coalesce(safe_div(F.col("n_sig") * 100.0, F.col("n_sites")), F.lit(0.0)))
    )


def linear_trend(df: DataFrame, by: Sequence[str] = ("entity", "condition"), fdr: float | None = None, min_r2: float | None = None) -> DataFrame:
    """Regression of value on time per series: slope, intercept, R2, F, p and BH.

    Only sums are aggregated, so a series of any length is combined map-side.
    """
    stats = df.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("time").alias("mx"), F.avg("value").alias("my"),
        F.var_pop("time").alias("vx"), F.var_pop("value").alias("vy"), F.covar_pop("time", "value").alias("cxy"),
    )
    slope = safe_div(F.col("cxy"), F.col("vx"))
    r2 = F.least(safe_div(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")), F.lit(1.0))
    fit = stats.filter("n > 2 AND vx > 0 AND vy > 0").withColumns({"slope": slope, "r2": r2})
    fit = fit.withColumn("f", safe_div(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    fit = fit.withColumn("pvalue", F.when(F.col("f").isNull(), F.lit(0.0)).otherwise(t_two_sided(F.sqrt("f"), F.col("n") - 2)))
    out = fit.select(
        *by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2", "f", "pvalue"
    )
    out = p_adjust(out, "pvalue", "BH", "padj", by=[c for c in by if c != "entity"])
    if fdr is not None:
        out = out.filter(F.col("padj") <= fdr)
    return out if min_r2 is None else out.filter(F.col("r2") >= min_r2)
