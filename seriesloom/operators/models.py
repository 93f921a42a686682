"""Small linear-algebra fits.  Spark aggregates the moments; tasks only solve tiny systems."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.vectors import mean, unit_series
from seriesloom.operators.expression import to_series


def f_tail(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """P(F > f) by the continued fraction of the incomplete beta function."""
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, dtype="float64") for v in (f, df1, df2)))
    out = np.full(f.shape, np.nan)
    ok = np.isfinite(f) & (df1 > 0) & (df2 > 0)
    out[np.isposinf(f)] = 0.0
    if not ok.any():
        return out
    a, b = df2[ok] / 2.0, df1[ok] / 2.0
    x = df2[ok] / (df2[ok] + df1[ok] * np.maximum(f[ok], 0.0))
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    c, d = np.ones_like(xx), 1.0 / np.where(np.abs(1.0 - (aa + bb) * xx / (aa + 1.0)) < tiny, tiny, 1.0 - (aa + bb) * xx / (aa + 1.0))
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    tail = front * h
    out[ok] = np.clip(np.where(swap, 1.0 - tail, tail), 0.0, 1.0)
    return out


def _symmetric(flat: np.ndarray, p: int) -> np.ndarray:
    """Stack of p x p matrices from their upper triangles."""
    out = np.zeros((len(flat), p, p))
    rows, cols = np.triu_indices(p)
    out[:, rows, cols] = flat
    out[:, cols, rows] = flat
    return out


def least_squares(df: DataFrame, by: Sequence[str], y: str, features: Sequence[Column]) -> DataFrame:
    """Ordinary least squares per group with an intercept: coefficients, R2, F and p.

    Only the cross products are aggregated (map-side), so one group may hold any number
    of rows; each group then is one small normal equation, solved in Arrow batches.
    """
    xs = [F.lit(1.0), *[f.cast("double") for f in features]]
    p = len(xs)
    target = F.col(y).cast("double")
    cross = [F.sum(xs[i] * xs[j]).alias(f"_x{i}_{j}") for i in range(p) for j in range(i, p)]
    moments = df.filter(F.col(y).isNotNull()).groupBy(*by).agg(
        *cross, *[F.sum(x * target).alias(f"_y{i}") for i, x in enumerate(xs)], F.sum(target * target).alias("yy")
    )
    packed = moments.select(
        *by,
        F.array(*[F.col(f"_x{i}_{j}") for i in range(p) for j in range(i, p)]).alias("xx"),
        F.array(*[F.col(f"_y{i}") for i in range(p)]).alias("xy"),
        "yy",
    )

    @F.pandas_udf("coef array<double>, r2 double, f double, pvalue double")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        if len(xx) == 0:
            return pd.DataFrame({"coef": [], "r2": [], "f": [], "pvalue": []})
        gram, rhs = _symmetric(np.stack(xx.to_numpy()), p), np.stack(xy.to_numpy())
        coef = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), rhs)
        n = gram[:, 0, 0]
        total = yy.to_numpy() - rhs[:, 0] ** 2 / n
        rss = np.maximum(yy.to_numpy() - np.einsum("ni,ni->n", coef, rhs), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = np.where(total > 0, 1.0 - rss / total, np.nan)
            f = (r2 / (p - 1)) / ((1.0 - r2) / (n - p))
        f = np.where(n > p, f, np.nan)
        return pd.DataFrame({"coef": list(coef), "r2": r2, "f": f, "pvalue": f_tail(f, p - 1, n - p)})

    return packed.select(*by, F.col("xx")[0].cast("long").alias("n"), solve("xx", "xy", "yy").alias("_m")).select(
        *by, "n", "_m.*"
    )


def polynomial_trend(df: DataFrame, degree: int, by: Sequence[str] = ("entity", "condition")) -> DataFrame:
    return least_squares(df, by, "value", [F.pow(F.col("time"), F.lit(float(d))) for d in range(1, degree + 1)])


def trend_by_condition(df: DataFrame, conditions: Sequence[str], control: str) -> DataFrame:
    """Trend over time with an own level and slope for each condition against the control."""
    others = sorted(c for c in conditions if c != control)
    dummy = [(F.col("condition") == c).cast("double") for c in others]
    return least_squares(df, ["entity"], "value", [F.col("time"), *dummy, *[d * F.col("time") for d in dummy]])


def hotelling(df: DataFrame, times: Sequence[int], conditions: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """Paired T2 of the time profile per entity and condition pair with its F and p.

    Replicates are paired; the covariance of the differences gets ``ridge`` on its
    diagonal because there are fewer replicates than times.
    """
    p = len(times)
    cells = [
        F.max(F.when((F.col("condition") == c) & (F.col("time") == t), F.col("value"))).alias(f"_{i}_{j}")
        for i, c in enumerate(conditions)
        for j, t in enumerate(times)
    ]
    wide = df.groupBy("entity", "replicate").agg(*cells)
    diffs = [
        F.struct(
            F.lit(conditions[x]).alias("first"),
            F.lit(conditions[y]).alias("second"),
            F.array(*[F.col(f"_{x}_{j}") - F.col(f"_{y}_{j}") for j in range(p)]).alias("d"),
        )
        for x in range(len(conditions))
        for y in range(x + 1, len(conditions))
    ]
    long = wide.select("entity", F.inline(F.array(*diffs))).filter(~F.exists("d", lambda v: v.isNull()))
    moments = long.groupBy("entity", "first", "second").agg(
        F.count(F.lit(1)).alias("n_reps"),
        *[F.expr(f"sum(d[{j}])").alias(f"_s{j}") for j in range(p)],
        *[F.expr(f"sum(d[{i}]*d[{j}])").alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)],
    )
    packed = moments.select(
        "entity", "first", "second", "n_reps",
        F.array(*[F.col(f"_s{j}") for j in range(p)]).alias("s"),
        F.array(*[F.col(f"_c{i}_{j}") for i in range(p) for j in range(i, p)]).alias("c"),
    )

    @F.pandas_udf("t2 double, f double, pvalue double")
    def solve(n_reps: pd.Series, s: pd.Series, c: pd.Series) -> pd.DataFrame:
        if len(s) == 0:
            return pd.DataFrame({"t2": [], "f": [], "pvalue": []})
        n = n_reps.to_numpy(dtype="float64")
        mean = np.stack(s.to_numpy()) / n[:, None]
        scatter = _symmetric(np.stack(c.to_numpy()), p) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        cov = scatter / np.maximum(n - 1.0, 1.0)[:, None, None] + ridge * np.eye(p)
        t2 = n * np.einsum("ni,ni->n", mean, np.linalg.solve(cov, mean[:, :, None])[:, :, 0])
        samples = 2.0 * n * p
        f = (samples - p - 1.0) / ((samples - 2.0) * p) * t2
        return pd.DataFrame({"t2": t2, "f": f, "pvalue": f_tail(f, p, samples - p - 1.0)})

    return packed.select("entity", "first", "second", "n_reps", solve("n_reps", "s", "c").alias("_m")).select(
        "entity", "first", "second", "n_reps", "_m.*"
    )


_COMPONENT = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("share", T.DoubleType()),
    ]
)


@F.pandas_udf(T.ArrayType(_COMPONENT))
def _eigen(gram: pd.Series, size: pd.Series) -> pd.Series:
    """Leading eigenvectors of packed symmetric matrices with their share of the trace."""
    out = []
    for flat, n in zip(gram, size):
        mat = _symmetric(np.asarray(flat, dtype="float64")[None, :], int(n))[0]
        vals, vecs = np.linalg.eigh(mat)
        order = np.argsort(vals)[::-1]
        total = vals.sum()
        out.append(
            [
                {"component": k + 1, "vector": vecs[:, i].tolist(), "share": float(vals[i] / total) if total > 0 else 0.0}
                for k, i in enumerate(order[:2])
            ]
        )
    return pd.Series(out)


def module_pc1(df: DataFrame, clusters: DataFrame, times: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """First principal component over time per cluster: ``by, cluster, time, score, var_explained``.

    Series are standardised per entity.  Only the times x times cross products of a
    cluster are aggregated, so a cluster of any size becomes one small matrix.  The sign
    follows the mean profile.
    """
    n = len(times)
    scaled = unit_series(to_series(df, times, ["entity", *by]), "series", n, "cross", "u")
    joined = scaled.join(clusters, ["entity", *[c for c in by if c in clusters.columns]])
    sums = joined.groupBy(*by, "cluster").agg(
        *[F.expr(f"sum(u[{i}]*u[{j}])").alias(f"_g{i}_{j}") for i in range(n) for j in range(i, n)],
        *[F.expr(f"avg(u[{i}])").alias(f"_m{i}") for i in range(n)],
    )
    gram = F.array(*[F.col(f"_g{i}_{j}") for i in range(n) for j in range(i, n)])
    first = sums.select(
        *by, "cluster", F.array(*[F.col(f"_m{i}") for i in range(n)]).alias("m"), _eigen(gram, F.lit(n))[0].alias("e")
    )
    dot = F.aggregate(F.zip_with("m", F.col("e.vector"), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    signed = first.select(*by, "cluster", F.when(dot < 0, -1.0).otherwise(1.0).alias("sg"), "e")
    at = F.array(*[F.lit(t) for t in times])
    return signed.select(
        *by, "cluster", F.col("e.share").alias("var_explained"), "sg", F.posexplode("e.vector").alias("_i", "_v")
    ).select(*by, "cluster", F.get(at, F.col("_i")).alias("time"), (F.col("sg") * F.col("_v")).alias("score"), "var_explained")


def sample_pca(values: DataFrame, samples: Sequence[str], top: int | None = None) -> DataFrame:
    """Two leading components of the samples over all entities, or the ``top`` most variable ones.

    ``values`` has entity, sample and value.  Each task reduces its entities to one
    samples x samples matrix, which is then summed.
    """
    s = len(samples)
    series = to_series(values.withColumnRenamed("sample", "time"), samples)
    centred = series.withColumn("_m", mean("series", s)).select("entity", F.transform("series", lambda v: v - F.col("_m")).alias("x"))
    chosen = centred.select("x")
    if top is not None:
        var = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
        chosen = centred.withColumn("_var", var).orderBy(F.desc("_var"), "entity").limit(top).select("x")
    rows, cols = np.triu_indices(s)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros(len(rows))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                gram += (x.T @ x)[rows, cols]
        yield pd.DataFrame({"cell": np.arange(len(rows)), "v": gram})

    cells = chosen.mapInPandas(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    # samples^2 / 2 numbers, fixed by the design
    packed = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda c: c["v"]).alias("gram"))
    named = F.array(*[F.lit(x) for x in samples])
    lead = packed.select(F.inline(_eigen("gram", F.lit(s))))
    out = lead.select("component", F.col("share").alias("var_explained"), F.posexplode("vector").alias("_i", "score"))
    # The sign of a component is free; make its largest entry positive.
    peak = lead.select("component", F.array_max(F.transform("vector", lambda v: F.struct(F.abs(v).alias("a"), v.alias("v")))).alias("p"))
    sign = peak.select("component", F.signum(F.col("p.v")).alias("_sg"))
    return out.join(F.broadcast(sign), "component").select(
        F.get(named, F.col("_i")).alias("sample"), "component", (F.col("score") * F.col("_sg")).alias("score"), "var_explained"
    )
