"""Running aggregates over an order without putting one key into one task.

A plain window partitioned by key sends a whole key to one task, and a window
without a key sends the whole table there.  ``running`` splits the order into
chunks, scans every chunk on its own and adds what the earlier chunks hold, so a
key with a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.skew import null_safe, salted_join
from seriesloom.session import materialize, shuffle_width

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def with_chunk(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """Add ``_chunk``, the number of the chunk a row falls into along ``order``.

    The split points are approximate quantiles from one bounded sketch; whatever they
    are, the scan stays exact, they only decide how even the chunks get.  A row finds
    its chunk by binary search.
    """
    order = F.col(order)
    points = [i / chunks for i in range(1, chunks)]
    if not points:
        return df.withColumn("_chunk", F.lit(0))
    splits = df.agg(F.percentile_approx(order.cast("double"), points, max(2000, 10 * chunks)).alias("s")).scalar()
    step, steps = 1, []
    while step < chunks:
        steps.insert(0, step)
        step *= 2
    value = order.cast("double")
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(F.col("_splits"), at + s - 1) <= value, at + s).otherwise(at),
    )
    return df.withColumn("_splits", splits).withColumn("_chunk", found).drop("_splits")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: Mapping[str, tuple[str, Column]],
    reverse: bool = False,
    inclusive: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """Add running aggregates ``{name: (sum|max|min, column)}`` along ``order`` within ``keys``.

    ``df`` must hold at most one row per (keys, order): collapse equal positions
    first, which also removes any hot position.  ``order`` is numeric; null keys are a
    group like others.  The input is materialized, because the split points, the chunk
    totals and the scan all read it.
    """
    df = materialize(df)
    keys = list(keys)
    names = list(aggs)
    by = F.col(order).desc() if reverse else F.col(order).asc()
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    chunks = chunks or shuffle_width(df)
    base = with_chunk(df, order, chunks).select(
        "*",
        *[col.alias(f"_v_{n}") for n, (_, col) in aggs.items()],
    )
    part = keys + ["_chunk"]
    local = Window.partitionBy(*part).orderBy(by).rowsBetween(*frame)
    totals = base.groupBy(*part).agg(*[_AGG[aggs[n][0]](f"_v_{n}").alias(f"_t_{n}") for n in names])
    by_chunk = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    before = Window.partitionBy(*keys).orderBy(by_chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[_AGG[aggs[n][0]](f"_t_{n}").over(before).alias(f"_c_{n}") for n in names])
    scanned = base.select(
        *[c for c in base.columns if not c.startswith("_v_")],
        *[_AGG[aggs[n][0]](f"_v_{n}").over(local).alias(f"_l_{n}") for n in names],
    )

    def combined(name: str) -> Column:
        kind = aggs[name][0]
        here, prior = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        return F.greatest(here, prior) if kind == "max" else F.least(here, prior)

    return null_safe(scanned, carry, part).select(*df.columns, *[combined(n).alias(n) for n in names])


def asof_running(
    points: DataFrame,
    steps: DataFrame,
    keys: Sequence[str],
    at: str,
    position: str,
    aggs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """For every point the aggregate over the steps up to it (from it, if ``reverse``).

    ``at`` is the integer position column of ``points``, ``position`` that of
    ``steps``.  Both sides are collapsed to one row per position before the scan.
    """
    keys = list(keys)
    # A doubled position leaves room to sort points before or after steps of equal position.
    after = inclusive != reverse
    collapsed = steps.groupBy(*keys, F.col(position).alias("_pos")).agg(
        *[_AGG[kind](col).alias(n) for n, (kind, col) in aggs.items()]
    )
    step_rows = collapsed.select(
        *keys, (F.col("_pos") * 2 + F.lit(0 if after else 1)).alias("_o"), F.lit(0).cast("long").alias("_w"), *aggs
    )
    types = {f.name: f.dataType for f in collapsed.schema.fields}
    distinct_points = points.groupBy(*keys, F.col(at).alias("_pos")).agg(F.count(F.lit(1)).alias("_w"))
    point_rows = distinct_points.select(
        *keys,
        (F.col("_pos") * 2 + F.lit(1 if after else 0)).alias("_o"),
        "_w",
        *[F.lit(None).cast(types[n]).alias(n) for n in aggs],
    )
    merged = step_rows.unionByName(point_rows).select(
        *keys, "_o", "_w", *[F.col(n).alias(f"_s_{n}") for n in aggs]
    )
    found = (
        running(merged, keys, "_o", {n: (k, F.col(f"_s_{n}")) for n, (k, _) in aggs.items()}, reverse, True, chunks)
        .filter("_w > 0")
        .select(*keys, F.floor(F.col("_o") / 2).cast("long").alias("_at"), *aggs)
    )
    left = points.withColumn("_at", F.col(at).cast("long"))
    weights = distinct_points.select(*keys, F.col("_pos").cast("long").alias("_at"), F.col("_w").alias("_n"))
    return salted_join(left, found, keys + ["_at"], "left", key_counts=weights).drop("_at")


def global_row_number(df: DataFrame, order: Sequence[str], name: str, chunks: int | None = None) -> DataFrame:
    """Row numbers 1..n over the whole table, scanned chunk by chunk.

    The first order column is numeric and cuts the chunks; the columns together
    must identify a row.
    """
    df = materialize(df)
    chunks = chunks or shuffle_width(df)
    base = with_chunk(df, order[0], chunks)
    sizes = base.groupBy("_chunk").count()
    before = sizes.select(
        "_chunk",
        F.coalesce(
            F.sum("count").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        base.withColumn("_rn", local)
        .join(F.broadcast(before), "_chunk")
        .select(*df.columns, (F.col("_rn") + F.col("_before")).cast("long").alias(name))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], chunks: int | None = None
) -> DataFrame:
    """Interpolated quantiles per key, exact at any group size.

    Values are counted first, so the scan sees each distinct value once and no
    group is ever gathered.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counts = materialize(counts)
    ranked = running(counts, keys, "_x", {"_cum": ("sum", F.col("_n"))}, chunks=chunks)
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
        weights = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        ranked = salted_join(ranked, sizes, keys, key_counts=weights, nulls_meet=True)
    else:
        ranked = ranked.withColumn("_size", counts.agg(F.sum("_n")).scalar())
    aggs = []
    for name, q in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(q))
        first = F.col("_cum") - F.col("_n")

        def at(rank: Column) -> Column:
            return F.max(F.when((first <= rank) & (rank < F.col("_cum")), F.col("_x")))

        frac = F.max(h - F.floor(h))
        low, high = at(F.floor(h)), at(F.ceil(h))
        aggs.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_size").alias("n"), *aggs)
