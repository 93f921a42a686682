"""Arithmetic on short series of known length, unrolled so it compiles to plain code.

A series is an array column with one value per design time.  The number of times
is part of the design, never of the data, so unrolling is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plus(terms: Iterable[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def mean(series: str, length: int) -> Column:
    return F.expr(f"{_plus(f'{series}[{i}]' for i in range(length))} / {length}D")


def unit_series(df: DataFrame, series: str, length: int, method: str, out: str) -> DataFrame:
    """Scale a series so that the score of two entities is the dot product of both.

    ``cross``: centred and divided by the root of its sum of squares; ``temporal``: first
    differences of unit length.  A constant series has no correlation (it is left out)
    but a temporal correlation of 0.
    """
    if method == "cross":
        mid = df.withColumn("_m", mean(series, length))
        dev = [f"({series}[{i}] - _m)" for i in range(length)]
        scaled = "array(" + ", ".join(f"{d} / _s" for d in dev) + ")"
    elif method == "temporal":
        mid = df
        dev = [f"({series}[{i + 1}] - {series}[{i}])" for i in range(length - 1)]
        scaled = "array(" + ", ".join(f"CASE WHEN _s > 0 THEN {d} / _s ELSE 0D END" for d in dev) + ")"
    else:
        raise ValueError(f"unknown method {method!r}")
    mid = mid.withColumn("_s", F.expr(f"sqrt({_plus(f'{d}*{d}' for d in dev)})"))
    if method == "cross":
        mid = mid.filter("_s > 0")
    return mid.withColumn(out, F.expr(scaled)).drop("_m", "_s")


def shifted_dot(left: str, right: str, length: int, lag: int = 0) -> Column:
    """Sum over i of left[i + lag] * right[i] where both exist."""
    parts = [f"{left}[{i + lag}]*{right}[{i}]" for i in range(length) if 0 <= i + lag < length]
    return F.expr(_plus(parts)) if parts else F.lit(0.0)
