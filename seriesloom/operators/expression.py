"""Replicated time series: labels, replicate summaries, filters and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import safe_div, t_quantile_975
from seriesloom.operators.scan import exact_quantiles


def split_sample_label(df: DataFrame, label: str = "sample") -> DataFrame:
    """``condition.time.replicate`` into three typed columns."""
    parts = F.split(F.col(label), r"\.")
    return df.withColumns(
        {"condition": F.get(parts, F.lit(0)), "time": F.get(parts, F.lit(1)).cast("int"), "replicate": F.get(parts, F.lit(2))}
    )


def design_dummies(df: DataFrame, conditions: Sequence[str], control: str, label: str = "sample") -> DataFrame:
    """One 0/1 column per condition, control first, beside time and replicate."""
    ordered = [control] + sorted(c for c in conditions if c != control)
    return split_sample_label(df.select(label).distinct(), label).select(
        label, "time", "replicate", *[(F.col("condition") == c).cast("int").alias(f"is_{c}") for c in ordered]
    )


def replicate_mean(df: DataFrame) -> DataFrame:
    """Mean over replicates per entity, condition and time."""
    return df.groupBy("entity", "condition", "time").agg(F.avg("value").alias("value"))


def wide_by_time(df: DataFrame, times: Sequence[int], keys: Sequence[str] = ("entity", "condition")) -> DataFrame:
    """One column ``t<time>`` per design time."""
    return df.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN time = {t!r} THEN value END)").alias(f"t{t}") for t in times])


def summary_se(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, standard error and 95 % half interval per group."""
    n = F.col("n")
    return (
        df.groupBy(*by)
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
        .withColumn("se", F.col("sd") / F.sqrt(F.when(n > 0, n)))
        .withColumn("ci", F.col("se") * t_quantile_975(n - 1))
    )


def to_series(df: DataFrame, times: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """One array per entity in time order; entities that miss a time are left out.

    The design fixes the number of times, so this is one aggregation with map-side
    combine and no list is collected.
    """
    cells = [F.expr(f"max(CASE WHEN time = {t!r} THEN value END)").alias(f"_{i}") for i, t in enumerate(times)]
    names = [f"_{i}" for i in range(len(times))]
    return df.groupBy(*keys).agg(*cells).dropna(subset=names).select(*keys, F.array(*names).alias("series"))


def low_signal_filter(df: DataFrame, floor: float = 1.0, fewer_than: int = 5) -> DataFrame:
    """Entities with fewer than ``fewer_than`` time means below ``floor``."""
    low = F.sum(F.when(F.col("value") < floor, 1).otherwise(0))
    return df.groupBy("entity", "condition").agg(low.alias("n_low")).filter(F.col("n_low") < fewer_than)


def keep_entities(df: DataFrame, kept: DataFrame, on: Sequence[str] = ("entity",)) -> DataFrame:
    return df.join(kept.select(*on), list(on), "left_semi")


def min_mean_filter(df: DataFrame, floor: float = 10.0) -> DataFrame:
    return df.groupBy("entity").agg(F.avg("value").alias("mean")).filter(F.col("mean") > floor)


def min_sum_filter(df: DataFrame, floor: float = 5.0, value: str = "count") -> DataFrame:
    """Entities whose total exceeds ``floor`` (totals up to it are dropped)."""
    return df.groupBy("entity").agg(F.sum(value).alias("total")).filter(F.col("total") > floor)


def peak_filter(df: DataFrame, above: float = 8.0, first: int = 1, last: int = 7) -> DataFrame:
    """Entities whose largest value at positions ``first``..``last`` exceeds ``above``."""
    return (
        df.filter(F.col("time").between(first, last))
        .groupBy("entity", "condition")
        .agg(F.max("value").alias("peak"))
        .filter(F.col("peak") > above)
    )


def _by_time() -> Window:
    # A series has one row per design time, so each partition is short.
    return Window.partitionBy("entity", "condition").orderBy("time")


def step_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", safe_div(F.col("value"), F.lag("value").over(_by_time())))


def first_difference(df: DataFrame) -> DataFrame:
    """v[t+1] - v[t], last time dropped."""
    return df.withColumn("diff", F.lead("value").over(_by_time()) - F.col("value")).filter(F.col("diff").isNotNull())


def net_change_filter(df: DataFrame, direction: str, first: int = 1, last: int = 6) -> DataFrame:
    """Entities whose mean step ratio over positions ``first``..``last`` goes up or down."""
    if direction not in ("up", "down"):
        raise ValueError("direction must be 'up' or 'down'")
    mean = F.col("mean_ratio")
    return (
        step_ratio(df)
        .filter(F.col("time").between(first, last))
        .groupBy("entity", "condition")
        .agg(F.avg("ratio").alias("mean_ratio"))
        .filter(mean >= 1 if direction == "up" else mean <= 1)
    )


def classify_direction(df: DataFrame, fold: str = "log2fc", padj: str = "padj", alpha: float = 0.05) -> DataFrame:
    """Up / Down / NoChange; a missing adjusted p counts as 1."""
    p = F.coalesce(F.col(padj), F.lit(1.0))
    return df.withColumn(
        "direction",
        F.when((p <= alpha) & (F.col(fold) > 0), "Up").when((p <= alpha) & (F.col(fold) < 0), "Down").otherwise("NoChange"),
    )


def zero_time_backfill(df: DataFrame, source: str, targets: Sequence[str]) -> DataFrame:
    """Give every target condition the time-0 rows of the source condition."""
    shared = df.filter((F.col("condition") == source) & (F.col("time") == 0))
    labels = F.explode(F.array(*[F.lit(t) for t in targets]))
    copies = shared.withColumn("condition", labels)
    rest = df.filter(~(F.col("condition").isin(*targets) & (F.col("time") == 0)))
    return rest.unionByName(copies.select(*df.columns))


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of count / geometric mean per sample, over entities seen in every sample.

    ``counts`` is read three times; pass a stored table.
    """
    samples = counts.agg(F.count_distinct("sample")).scalar()
    geo = (
        counts.filter("count > 0")
        .groupBy("entity")
        .agg(F.avg(F.ln("count")).alias("_log_mean"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == samples)
    )
    ratios = counts.join(geo, "entity").select("sample", (F.col("count") / F.exp("_log_mean")).alias("ratio"))
    return exact_quantiles(ratios, ["sample"], "ratio", {"factor": 0.5}).select("sample", "factor")


def normalise_counts(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts divided by their sample's size factor; one factor per design sample."""
    return counts.join(factors, "sample").withColumn("value", F.col("count") / F.col("factor"))


def variance_stabilise(values: DataFrame) -> DataFrame:
    """Closed-form variance-stabilising transform under dispersion a0 + a1 / mean.

    Dispersions come from the moments of each entity; the trend is the least-squares
    line of dispersion on 1 / mean.
    """
    moments = values.groupBy("entity").agg(F.avg("value").alias("mu"), F.var_samp("value").alias("var"))
    disp = moments.filter("mu > 0 AND var IS NOT NULL").select(
        "entity", "mu", ((F.col("var") - F.col("mu")) / (F.col("mu") * F.col("mu"))).alias("disp")
    )
    trend = disp.filter("disp > 0").agg(
        F.greatest(F.regr_intercept("disp", 1 / F.col("mu")), F.lit(1e-8)).alias("a0"),
        F.greatest(F.regr_slope("disp", 1 / F.col("mu")), F.lit(0.0)).alias("a1"),
    )
    a0, a1 = trend.select("a0").scalar(), trend.select("a1").scalar()
    q = F.col("value")
    inner = 1 + a1 + 2 * a0 * q + 2 * F.sqrt(a0 * q * (1 + a1 + a0 * q))
    return values.withColumn("vst", F.ln(inner / (4 * a0)) / F.ln(F.lit(2.0)))


def module_mean_profile(df: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean series per cluster and value of ``by``; ``clusters`` has entity and cluster, and may have columns of ``by``."""
    on = ["entity", *[c for c in by if c in clusters.columns]]
    return df.join(clusters, on).groupBy(*by, "cluster", "time").agg(F.avg("value").alias("value"))


def describe_groups(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Extremes and quartiles per group, exact at any group size."""
    probs = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}
    return exact_quantiles(df, by, value, probs)


def histogram_bins(df: DataFrame, value: str, parts: int = 5) -> DataFrame:
    """Counts per bin of width int(max / (n / parts)), at least 1."""
    stats = df.agg(F.max(value).alias("m"), F.count(value).alias("n"))
    width = F.greatest(F.floor(stats.select(F.col("m") / (F.col("n") / parts)).scalar()), F.lit(1)).cast("long")
    return df.groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def derive_density(count: Column, length: Column, per: float = 1000.0) -> Column:
    return safe_div(count, length) * per


def kind_of(col: Column) -> Column:
    """Entity kind by id prefix."""
    return F.when(col.rlike("^G"), "G").when(col.rlike("^L_"), "L")
