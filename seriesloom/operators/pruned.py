"""Threshold joins of unit series that leave out what cannot reach the threshold.

For unit series a correlation c is a distance sqrt(2 - 2c), and distances obey the triangle
inequality.  Every right series joins the block of its nearest pivot; a block knows its radius, the
largest distance of a member from the pivot.  A left series can only reach correlation t in a block
whose pivot is no further away than the radius and sqrt(2 - 2t) together; for correlations of -t or
less, the pivot is turned round.  It visits these blocks and no others.  Blocks with many rows or
visitors are cut into parts, so that no cell of the join grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.vectors import shifted_dot
from seriesloom.operators.skew import null_safe, salted_join
from seriesloom.session import materialize, shuffle_width

#: Pivots of a value of ``by``: so many times the root of its rows, and so many at most.
PIVOTS_EACH, MAX_PIVOTS = 4, 256
#: Rows or visitors of a part of a block on average at most.
PART_ROWS = 1000
#: Distances are off by less than this.
SLACK = 1e-7


def _distance(dot: Column, turned: bool = False) -> Column:
    """Distance of two unit series, or of one and the other turned round, from their product."""
    return F.sqrt(F.greatest(F.lit(2.0) + (dot if turned else -dot) * 2.0, F.lit(0.0)))


def _product(pivot: Column, length: int) -> Column:
    return sum((F.col("u")[i] * pivot[i] for i in range(1, length)), F.col("u")[0] * pivot[0])


def _beside(rows: DataFrame, counts: DataFrame, listed: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the list of their value of ``by``, in parts of about ``PART_ROWS`` that tasks share evenly.

    Every row is held against a whole list, so the work is far larger than the rows: the number of tasks
    follows the parts and is not left to the size of the shuffle.
    """
    parts = counts.select(*by, F.monotonically_increasing_id().alias("_group"), F.ceil(F.col("_n") / PART_ROWS).cast("int").alias("_parts"))
    parts = materialize(parts)
    tasks = max(shuffle_width(rows), parts.agg(F.sum("_parts")).first()[0] or 1)
    placed = salted_join(rows, parts, by, key_counts=counts, nulls_meet=True).withColumn("_part", F.pmod(F.xxhash64("entity"), "_parts").cast("int"))
    copies = null_safe(listed, parts, by).drop(*by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    cell = ["_group", "_part"]
    return placed.repartition(tasks, *cell).join(copies.repartition(tasks, *cell), cell).drop(*cell, "_parts")


def pivot_blocks(rows: DataFrame, length: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_block``, blocks ``by, _block, _pivot, _radius, _n``), both stored.

    ``rows`` has ``by``, entity and the unit series ``u``.  Pivots are rows of the smallest hashes.
    """
    by = list(by) or ["_all"]
    mark = F.pmod(F.xxhash64("entity", F.lit("pivot")), F.lit(1 << 31))
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(mark.alias("h"), "entity")).alias("_first")))
    counts = sizes.select(*by, "_n")
    sized = salted_join(rows, sizes.withColumnRenamed("_n", "_rows"), by, key_counts=counts, nulls_meet=True)
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(PIVOTS_EACH * F.sqrt("_rows")))
    chosen = sized.filter((mark < wanted / F.col("_rows") * (1 << 31)) | (F.col("entity") == F.col("_first.entity")))
    pivots = materialize(chosen.select(*by, F.col("u").alias("_pivot")).distinct().withColumn("_block", F.monotonically_increasing_id()))
    # About MAX_PIVOTS short series a value of ``by``.
    listed = pivots.groupBy(*by).agg(F.collect_list(F.struct("_block", "_pivot")).alias("_pivots"))
    met = _beside(rows, counts, listed, by)
    nearest = F.array_max(F.transform("_pivots", lambda p: F.struct(_product(p["_pivot"], length).alias("dot"), p["_block"].alias("block"))))
    met = met.withColumn("_near", nearest)
    placed = materialize(met.select(*rows.columns, F.col("_near.block").alias("_block"), _distance(F.col("_near.dot")).alias("_away")))
    blocks = placed.groupBy("_block").agg(F.max("_away").alias("_radius"), F.count(F.lit(1)).alias("_n")).join(pivots, "_block")
    return placed.drop("_away"), materialize(blocks)


def visits(rows: DataFrame, blocks: DataFrame, length: int, by: Sequence[str], threshold: float, both_ways: bool) -> DataFrame:
    """``rows`` once for every block in which they can reach the threshold, as ``_block``; stored.

    ``threshold`` below zero asks for correlations down to it; ``both_ways`` for either sign.
    """
    by = list(by) or ["_all"]
    listed = blocks.groupBy(*by).agg(F.collect_list(F.struct("_block", "_pivot", "_radius")).alias("_blocks"))
    reach = math.sqrt(max(0.0, 2 - 2 * abs(threshold))) + SLACK

    def near(block: Column) -> Column:
        dot, fits = _product(block["_pivot"], length), F.lit(False)
        if both_ways or threshold >= 0:
            fits = fits | (_distance(dot) <= block["_radius"] + reach)
        if both_ways or threshold < 0:
            fits = fits | (_distance(dot, True) <= block["_radius"] + reach)
        return fits

    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    met = _beside(rows, counts, listed, by)
    return materialize(met.select(*rows.columns, F.explode(F.transform(F.filter("_blocks", near), lambda b: b["_block"])).alias("_block")))


def pruned_pairs(
    left: DataFrame, right: DataFrame | None, length: int, threshold: float, both_ways: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """``by, a_entity, a_u, b_entity, b_u`` of left rows with all rows of the blocks they visit.

    ``left`` and ``right`` have ``by``, entity and ``u``; ``right=None`` pairs one table with itself
    (a <= b).  All pairs over the threshold are among the rows; which of the others are, depends on
    the pivots.
    """
    by, width, same = list(by), shuffle_width(left), right is None
    norm = shifted_dot("u", "u", length)

    def whole(df: DataFrame) -> DataFrame:  # series without a direction reach no threshold
        return materialize((df if by else df.withColumn("_all", F.lit(0))).filter(norm > 0.5))

    left = whole(left)
    rows, blocks = pivot_blocks(left if same else whole(right), length, by)
    guests = visits(left, blocks, length, by, threshold, both_ways)
    seen = guests.groupBy("_block").agg(F.count(F.lit(1)).alias("_guests"))
    parts = lambda n: F.ceil(F.col(n) / PART_ROWS).cast("int")
    sizes = materialize(blocks.join(seen, "_block").select("_block", "_n", "_guests", parts("_guests").alias("_is"), parts("_n").alias("_js")))
    cells = sizes.agg(F.sum(F.col("_is").cast("long") * F.col("_js"))).first()[0] or 1
    tasks, cell, hashed = max(width, cells // 4), ["_block", "_i", "_j"], F.xxhash64("entity")

    def dealt(df: DataFrame, count: str, own: str, owns: str, far: str, fars: str) -> DataFrame:
        counts = sizes.select("_block", F.col(count).alias("_n"))
        met = salted_join(df, sizes.select("_block", "_is", "_js"), "_block", key_counts=counts)
        return met.withColumns({own: F.pmod(hashed, F.col(owns)).cast("int"), far: F.explode(F.sequence(F.lit(0), F.col(fars) - 1))})

    a = dealt(guests, "_guests", "_i", "_is", "_j", "_js").select(*cell, *by, F.col("entity").alias("a_entity"), F.col("u").alias("a_u"))
    b = dealt(rows, "_n", "_j", "_js", "_i", "_is").select(*cell, F.col("entity").alias("b_entity"), F.col("u").alias("b_u"))
    met = a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).drop(*cell)
    # Of a table with itself, the smaller entity visits the block of the larger one.
    return met.filter("a_entity <= b_entity") if same else met
