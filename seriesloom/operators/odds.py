"""The conditional odds ratio of 2x2 counts with its exact confidence limits.

Given all margins, the first cell of a table with odds ratio w has the chance of k in proportion to
C(row, k) C(rest, column - k) w^k.  The estimate is the w whose mean is the observed count; the limits are
the w for which a count as large, as small, as the observed one has the chance left outside the interval.
All three are roots of monotone functions of log w, found by Newton steps inside a bracket.  Chances are
summed around their mode, as far as they differ from zero in doubles, so the work of a table grows with
the root of its counts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chances further than so many deviations from the mode are zero in doubles.
DEVIATIONS = 20
#: No table of 64-bit counts has a root beyond, on the scale of log w.
FARTHEST = 200.0
#: Distinct tables whose result a worker keeps.
KEPT = 1 << 14


def _law(row: int, column: int, total: int, x: float) -> tuple[np.ndarray, np.ndarray]:
    """(counts, chances) of the first cell for log odds ratio ``x``, around the mode."""
    least, most, rest = max(0, row + column - total), min(row, column), total - row - column
    # The mode solves (row - k)(column - k) w = (k + 1)(rest + k + 1), or the same divided by w.
    w = math.exp(-abs(x))
    up, down = (1.0, w) if x > 0 else (w, 1.0)
    a, b, c = up - down, -(up * (row + column) + down * (rest + 2)), up * row * column - down * (rest + 1)
    root = math.sqrt(max(b * b - 4 * a * c, 0.0))
    mode = int(min(max(2 * c / (root - b) if root != b else 0.0, least), most))
    cells = (mode, row - mode, column - mode, rest + mode)
    reach = int(DEVIATIONS / math.sqrt(sum(1.0 / (n + 1.0) for n in cells))) + 4 * DEVIATIONS
    k = np.arange(max(least, mode - reach), min(most, mode + reach) + 1, dtype=float)
    j = k[:-1]
    steps = np.log(row - j) + np.log(column - j) - np.log(j + 1) - np.log(rest + j + 1) + x
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return k, p / p.sum()


def _root(value: Callable[[float], tuple[float, float]], start: float) -> float:
    """Root of an increasing function that returns itself and its slope."""
    low, high, x = -FARTHEST, FARTHEST, start
    for _ in range(200):
        f, slope = value(x)
        if f == 0:
            break
        low, high = (x, high) if f < 0 else (low, x)
        to = x - f / slope if slope > 0 and math.isfinite(f) else math.nan
        if not low < to < high:
            to = (low + high) / 2
        if abs(to - x) <= 1e-14 * max(1.0, abs(x)):
            return to
        x = to
    return x


@functools.lru_cache(maxsize=KEPT)
def conditional_odds(a: int, b: int, c: int, d: int, level: float, alternative: str) -> tuple[float | None, float, float]:
    """(estimate, lower, upper) of the table a b / c d; no estimate where the margins leave one count only."""
    row, column, total = a + b, a + c, a + b + c + d
    least, most = max(0, row + column - total), min(row, column)
    if least == most:
        return None, 0.0, math.inf
    start = math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))

    def mean(x: float) -> tuple[float, float]:
        k, p = _law(row, column, total, x)
        m = float(k @ p)
        return m - a, float(((k - m) ** 2) @ p)

    def tail(upper: bool, chance: float) -> Callable[[float], tuple[float, float]]:
        def value(x: float) -> tuple[float, float]:
            k, p = _law(row, column, total, x)
            side = k >= a if upper else k <= a
            share = float(p[side].sum())
            sign = 1.0 if upper else -1.0
            if share == 0.0:
                return -sign * math.inf if upper else math.inf, 0.0
            slope = float(k[side] @ p[side]) / share - float(k @ p)
            return sign * (math.log(share) - math.log(chance)), sign * slope

        return value

    outside = (1 - level) / 2 if alternative == "two-sided" else 1 - level
    estimate = 0.0 if a == least else math.inf if a == most else math.exp(_root(mean, start))
    low = 0.0 if a == least or alternative == "less" else math.exp(_root(tail(True, outside), start))
    high = math.inf if a == most or alternative == "greater" else math.exp(_root(tail(False, outside), start))
    return estimate, low, high


def odds_interval(df: DataFrame, level: float = 0.95, alternative: str = "two-sided") -> DataFrame:
    """``df`` with ``estimate``, ``low`` and ``high`` for its counts a, b, c, d (rows a b / c d).

    ``greater`` and ``less`` leave all the chance on one side, and the other limit is infinite or 0.
    Null or negative counts have no result.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative must be 'two-sided', 'greater' or 'less'")
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    names = ["estimate", "low", "high"]
    rows = df.drop(*names)
    kept = rows.columns
    counts = [F.col(c).cast("bigint").alias(f"_{c}") for c in "abcd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (None, None, None) if None in t or min(t) < 0 else conditional_odds(*t, level, alternative)
                for t in zip(*(batch.column(f"_{c}").to_pylist() for c in "abcd"))
            ]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.select("*", *counts).mapInArrow(run, schema)
