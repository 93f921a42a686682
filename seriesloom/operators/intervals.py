"""Interval algebra on half-open ranges ``seq, start, end``; an empty range overlaps nothing.

Joins that must list every overlapping pair cut the axis into bins and join on
(seq, bin).  Questions that need one answer per interval - is it covered, contained,
how many bases, what is nearest - are running aggregates along the axis instead
(``scan``), so they list no pairs and one crowded sequence is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import safe_div
from seriesloom.operators.scan import asof_running, running
from seriesloom.operators.skew import salted_join
from seriesloom.session import materialize


#: Bins of a level are so many times (as a power of two) as wide as those of the one below, and there are so many levels at most.
LEVEL_BITS, LEVELS = 3, 14


def _level(start: Column, end: Column, bin_size: int) -> Column:
    """The first level whose bins are no narrower than the interval."""
    return sum((((end - start) > bin_size << LEVEL_BITS * k).cast("int") for k in range(1, LEVELS)), ((end - start) > bin_size).cast("int"))


def _filed(df: DataFrame, side: str, levels: Column, bin_size: int) -> DataFrame:
    """``df`` once for every bin ``_level, _bin`` that it touches on each of ``levels``: one or two a level from its own on."""
    start, end = F.col(f"{side}_start"), F.col(f"{side}_end")

    def bins(level: Column) -> Column:
        width = F.lit(bin_size) * F.pow(F.lit(1 << LEVEL_BITS), level)
        first = F.floor(start / width)
        return F.transform(F.sequence(first, F.greatest(F.floor((end - 1) / width), first)), lambda b: F.struct(level.alias("_level"), b.alias("_bin")))

    return df.select("*", F.inline(F.flatten(F.transform(levels, bins))))


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    bin_size: int,
    contained: bool = False,
    stranded: bool = False,
) -> DataFrame:
    """All overlapping pairs: columns ``a_*``, ``b_*`` and the overlap ``width``.

    ``contained`` keeps pairs with a inside b.  Bins have levels, each ``2**LEVEL_BITS`` times as wide
    as the one before.  An interval's own level is the first with bins as wide as itself, so it lies in
    at most two of them; a pair meets on the higher one of both levels, and shorter intervals
    are filed on the levels that the other side has above them.  So the copies of an interval do not
    grow with its length.  A pair met in two bins is kept only in the one where the later of both
    starts lies.  Crowded bins are salted.
    """
    key = ["_seq", "_level", "_bin"]

    def solid(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]).filter(F.col(f"{side}_start") < F.col(f"{side}_end"))
        own = _level(F.col(f"{side}_start"), F.col(f"{side}_end"), bin_size)
        return named.withColumns({"_seq": F.col(f"{side}_seq"), f"_{side}": own})

    left, right = solid(a, "a"), solid(b, "b")
    have = {c: sorted(df.agg(F.collect_set(c)).first()[0]) for df, c in ((left, "_a"), (right, "_b"))}  # at most LEVELS + 1 numbers

    def above(levels: list[int], own: str, least: int) -> Column:
        return F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda m: m >= F.col(own) + least)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        crowd = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        return salted_join(x, y, key, key_counts=crowd)

    # Left intervals on their own level meet right ones up to it; then right ones on their own level meet shorter left ones.
    pairs = met(_filed(left, "a", F.array("_a"), bin_size), _filed(right, "b", above(have["_a"], "_b", 0), bin_size))
    if have["_a"] and have["_b"] and have["_b"][-1] > have["_a"][0]:
        pairs = pairs.unionByName(met(_filed(left, "a", above(have["_b"], "_a", 1), bin_size), _filed(right, "b", F.array("_b"), bin_size)))
    low, high = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    keep = (low < high) & (F.col("_bin") == F.floor(low / (F.lit(bin_size) * F.pow(F.lit(1 << LEVEL_BITS), F.col("_level")))))
    if contained:
        keep = keep & (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    if stranded:
        keep = keep & (F.col("a_strand") == F.col("b_strand"))
    return pairs.filter(keep).withColumn("width", high - low).drop(*key, "_a", "_b")


def contained_semi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that lie fully inside some interval of ``b``.

    Among the intervals starting no later than ``a`` the one reaching farthest decides.
    """
    reach = asof_running(a, b, ["seq"], "start", "start", {"_far": ("max", F.col("end"))})
    return reach.filter(F.col("_far") >= F.col("end")).select(*a.columns)


def overlaps_any(a: DataFrame, b: DataFrame, flag: str | None = None, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows of ``a`` that overlap some interval of ``b``, or all rows with a flag column."""
    solid = b.filter(F.col("start") < F.col("end"))
    reach = asof_running(a, solid, keys, "end", "start", {"_far": ("max", F.col("end"))}, inclusive=False)
    hit = F.coalesce(F.col("_far") > F.col("start"), F.lit(False)) & (F.col("start") < F.col("end"))
    if flag:
        return reach.select(*a.columns, hit.alias(flag))
    return reach.filter(hit).select(*a.columns)


def merge_intervals(df: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Union of overlapping or touching intervals per key, with the number merged."""
    by = list(by)
    at = df.groupBy(*by, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    seen = running(at, by, "start", {"_far": ("max", F.col("end"))}, inclusive=False)
    opened = F.when(F.col("_far").isNull() | (F.col("start") > F.col("_far")), F.col("start"))
    marked = running(seen.withColumn("_open", opened), by, "start", {"_island": ("max", F.col("_open"))})
    return marked.groupBy(*by, F.col("_island").alias("start")).agg(F.max("end").alias("end"), F.sum("n").alias("n"))


def covered_bases(points: DataFrame, merged: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """Bases of disjoint intervals to the left of a position."""
    upto = asof_running(
        points,
        merged,
        keys,
        at,
        "start",
        {"_sum": ("sum", F.col("end") - F.col("start")), "_last": ("max", F.col("end"))},
        inclusive=False,
    )
    # Only the last interval can reach beyond the position.
    beyond = F.greatest(F.col("_last") - F.col(at), F.lit(0))
    return upto.withColumn(out, F.coalesce(F.col("_sum") - beyond, F.lit(0))).drop("_sum", "_last")


def subtract_fraction(a: DataFrame, b: DataFrame, fraction: float = 0.75, stranded: bool = True) -> DataFrame:
    """Drop rows of ``a`` whose total overlap with ``b`` reaches a fraction of their length."""
    keys = ["seq", "strand"] if stranded else ["seq"]
    merged = materialize(merge_intervals(b, keys))
    out = materialize(covered_bases(a, merged, keys, "end", "_to_end"))
    out = covered_bases(out, merged, keys, "start", "_to_start")
    share = safe_div(F.col("_to_end") - F.col("_to_start"), F.col("end") - F.col("start"))
    return out.filter(F.coalesce(share, F.lit(0.0)) < fraction).select(*a.columns)


def nearest_join(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Closest ``b`` per ``a`` on the same seq: ``id, closest_id, distance``.

    Overlap counts as 0.  Ties: the preceding side first, then the one reaching
    farthest (preceding) or starting first (following), then the largest id.
    """
    before = materialize(
        asof_running(
            a.select(key, "seq", "start", "end"),
            b,
            ["seq"],
            "end",
            "start",
            {"_prev": ("max", F.struct(F.col("end").alias("reach"), F.col(key).alias("id")))},
            inclusive=False,
        )
    )
    after = asof_running(
        before,
        b,
        ["seq"],
        "end",
        "start",
        {"_next": ("max", F.struct((-F.col("start")).alias("neg_start"), F.col(key).alias("id")))},
        inclusive=True,
        reverse=True,
    )
    back = F.greatest(F.col("start") - F.col("_prev.reach"), F.lit(0))
    ahead = -F.col("_next.neg_start") - F.col("end")
    use_prev = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead))
    return after.select(
        key,
        F.when(use_prev, F.col("_prev.id")).otherwise(F.col("_next.id")).alias("closest_id"),
        F.when(use_prev, back).otherwise(ahead).alias("distance"),
    ).filter(F.col("closest_id").isNotNull())


def coverage(df: DataFrame) -> DataFrame:
    """Depth per strand between break points: ``seq, start, end, plus, minus`` (minus negated)."""
    plus = F.when(F.col("strand") == "+", 1).otherwise(0)
    deltas = df.select(
        "seq",
        F.inline(
            F.array(
                F.struct(F.col("start").alias("pos"), plus.alias("p"), (1 - plus).alias("m")),
                F.struct(F.col("end").alias("pos"), (-plus).alias("p"), (plus - 1).alias("m")),
            )
        ),
    )
    steps = deltas.groupBy("seq", "pos").agg(F.sum("p").alias("p"), F.sum("m").alias("m")).filter("p <> 0 OR m <> 0")
    depth = running(steps, ["seq"], "pos", {"plus": ("sum", F.col("p")), "depth_m": ("sum", F.col("m"))})
    ends = running(depth, ["seq"], "pos", {"end": ("min", F.col("pos"))}, reverse=True, inclusive=False)
    return ends.filter(F.col("end").isNotNull()).select(
        "seq", F.col("pos").alias("start"), "end", "plus", (-F.col("depth_m")).alias("minus")
    )


def extend_intervals(
    df: DataFrame, lengths: DataFrame, offset: int = 100, five_prime_only: bool = False
) -> DataFrame:
    """Widen intervals within their sequence; ``lengths`` has seq and length (a small dimension).

    Where a sequence's length is not known its end is no bound.
    """
    left = F.greatest(F.col("start") - offset, F.lit(0))
    right = F.least(F.col("end") + offset, F.col("length"))  # least skips a null
    if five_prime_only:
        left = F.when(F.col("strand") == "+", left).otherwise(F.col("start"))
        right = F.when(F.col("strand") == "-", right).otherwise(F.col("end"))
    joined = df.join(lengths, "seq", "left")
    cols = [left.alias("start") if c == "start" else right.alias("end") if c == "end" else F.col(c) for c in df.columns]
    return joined.select(*cols)


def spliced_length(exons: DataFrame, key: str) -> DataFrame:
    """Sum of all record lengths per entity."""
    return exons.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def merged_length(exons: DataFrame, key: str) -> DataFrame:
    """Bases covered per entity, shared exons counted once."""
    return spliced_length(merge_intervals(exons, list(dict.fromkeys([key, "seq"]))), key)


def extents(df: DataFrame, key: str, labels: Sequence[str] = ()) -> DataFrame:
    """First start, last end and the smallest of each label per entity."""
    return df.groupBy(key).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *[F.min(c).alias(c) for c in labels]
    )


def count_sites_zero_filled(entities: DataFrame, sites: DataFrame, key: str, name: str = "n_sites") -> DataFrame:
    """Sites per entity, 0 where there is none.  Sites are counted before the join."""
    per = sites.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return entities.select(key).distinct().join(per, key, "left").na.fill({name: 0})


#: Bits of an alignment's ``flag`` as the alignment format fixes them.
PROPER_PAIR, UNMAPPED, REVERSE, FIRST_MATE = 2, 4, 16, 64


def flagged_reads(reads: DataFrame, locus: DataFrame | None = None) -> DataFrame:
    """Mapped reads of proper pairs that overlap ``locus(seq, start, end)``, with ``strand`` and ``mate`` from ``flag``.

    The strand is that of the fragment: + where a first mate lies reversed or a second one
    forward, else -.  A null flag says nothing of a pair, so such reads go.  A pair with one
    mate outside the locus keeps the other.
    """
    def has(bit: int) -> Column:
        return F.col("flag").bitwiseAND(F.lit(bit)) != 0

    first = has(FIRST_MATE)
    kept = reads.filter(has(PROPER_PAIR) & ~has(UNMAPPED)).withColumns(
        {"strand": F.when(first == has(REVERSE), F.lit("+")).otherwise(F.lit("-")), "mate": F.when(first, 1).otherwise(2)}
    )
    return kept if locus is None else overlaps_any(kept, locus)


def bridging_pairs(
    reads: DataFrame, set_j: DataFrame, set_c: DataFrame, pad: int = 1, by: Sequence[str] = ("qname",)
) -> DataFrame:
    """Reads of names with exactly two reads, one touching set J and the other set C.

    Returns both reads of each bridging pair.  ``pad`` widens both sets to the left;
    ``by`` names a pair (with a sample column, all samples are done at once).
    """
    by = list(by)
    pair_names = reads.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(*by)
    two = materialize(reads.join(pair_names, by, "left_semi"))

    def padded(df: DataFrame) -> DataFrame:
        return df.select("seq", (F.col("start") - pad).alias("start"), "end")

    in_j = materialize(overlaps_any(two, padded(set_j), "in_j"))
    flagged = overlaps_any(in_j, padded(set_c), "in_c")
    j, c = F.col("in_j").cast("int"), F.col("in_c").cast("int")
    # One read in J and the other in C: both reads touch a set, and both sets are touched.
    touched = flagged.groupBy(*by).agg(F.sum(j).alias("j"), F.sum(c).alias("c"), F.sum(F.greatest(j, c)).alias("touching"))
    return two.join(touched.filter("j >= 1 AND c >= 1 AND touching = 2").select(*by), by, "left_semi")


def bridge_counts(reads: DataFrame, set_c: DataFrame, bin_size: int, by: Sequence[str] = ("qname",)) -> DataFrame:
    """Bridging pairs overlapping each constant segment symbol; symbols without any are left out.

    With a sample column in ``by`` the counts are per symbol and sample.
    """
    by = list(by)
    samples = [c for c in by if c != "qname"]
    named = set_c.withColumn("symbol", F.substring_index("transcript_name", "-", 1))
    merged = merge_intervals(named, ["seq", "symbol"]).drop("n")
    hits = overlap_join(reads.select(*by, "seq", "start", "end"), merged, bin_size)
    per = hits.select(F.col("b_symbol").alias("symbol"), *[F.col(f"a_{c}").alias(c) for c in by]).distinct()
    return per.groupBy("symbol", *samples).agg(F.count(F.lit(1)).alias("n_pairs"))


def _runs(df: DataFrame, *more: str) -> DataFrame:
    """``seq, start, end`` and ``more`` of a table of runs, or of one of single bases ``seq, pos``."""
    if "pos" in df.columns:
        df = df.select("seq", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), *more)
    return df.select("seq", "start", "end", *more).filter(F.col("start") < F.col("end"))


def _score_before(points: DataFrame, runs: DataFrame, at: str, out: str) -> DataFrame:
    """Sum of ``value`` over the bases of disjoint ``runs`` to the left of a position."""
    upto = asof_running(
        points,
        runs,
        ["seq"],
        at,
        "start",
        {"_sum": ("sum", F.col("value") * (F.col("end") - F.col("start"))), "_last": ("max", F.struct("start", "end", "value"))},
        inclusive=False,
    )
    # Only the last run can reach beyond the position.
    beyond = F.greatest(F.col("_last.end") - F.col(at), F.lit(0)) * F.col("_last.value")
    return upto.withColumn(out, F.coalesce(F.col("_sum") - beyond, F.lit(0))).drop("_sum", "_last")


def interval_scores(sites: DataFrame, track: DataFrame, gaps: DataFrame | None = None, digits: int = 9, bin_size: int = 1000) -> DataFrame:
    """Mean per-base score of each site (``id``); bases without score or in a gap count 0, an empty site has none.

    ``track`` and ``gaps`` hold single bases ``seq, pos`` or runs ``seq, start, end``; runs of the
    track do not overlap each other.  A site's sum is the difference of two running sums along
    its sequence, so no bases are listed however long sites and runs are.  Scores are rounded to
    ``digits`` decimals and summed as whole numbers: differences of sums far along a sequence are
    exact, and a sum beyond 64 bits is an error.  Null and non-finite scores count 0.
    """
    scaled = F.round(F.col("score") * F.lit(10.0**digits)).try_cast("long")
    scored = track.withColumn("value", scaled)
    if gaps is not None and "pos" in track.columns and "pos" in gaps.columns:
        scored, gaps = scored.join(gaps.select("seq", "pos"), ["seq", "pos"], "left_anti"), None
    runs = _runs(scored, "value").filter(F.col("value") != 0)
    solid = sites.filter(F.col("start") < F.col("end"))
    ends = F.array(F.struct(F.lit(-1).alias("sign"), F.col("start").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("end").alias("at")))
    points = solid.select("id", "seq", F.inline(ends))
    whole = F.col("_whole")
    if gaps is not None:
        runs = materialize(runs)
        cut = overlap_join(runs, merge_intervals(_runs(gaps)).drop("n"), bin_size)
        inside = cut.select(
            F.col("a_seq").alias("seq"), F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), F.col("a_value").alias("value")
        )
        points = materialize(_score_before(points, inside, "at", "_gone"))
        whole = whole - F.col("_gone")
    sums = _score_before(points, runs, "at", "_whole").groupBy("id").agg(F.sum(F.col("sign") * whole).alias("_sum"))
    sizes = sites.groupBy("id").agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("_size"))
    return sizes.join(sums, "id", "left").select("id", safe_div(F.col("_sum") / F.lit(10.0**digits), F.col("_size")).alias("score"))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per group along an explicit order; pruned before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
