"""Tail probabilities and rounding as Column expressions.

Every function takes and returns Columns built from native functions, so the
expressions run inside code generation and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantile by rational approximation (Abramowitz & Stegun 26.2.23), |error| < 4.5e-4;
# where the exact quantile is searched from.
PROBIT_C = (2.515517, 0.802853, 0.010328)
PROBIT_D = (1.432788, 0.189269, 0.001308)

# Two-sided 95 % Student t quantile by degrees of freedom 1..30.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959963984540054


def safe_div(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is 0 (ANSI mode raises otherwise)."""
    return num / F.when(den != 0, den)


def bound(value: Column, build) -> Column:
    """``build(x)`` with ``x`` evaluated once, however often the result uses it."""
    return F.get(F.transform(F.array(value.cast("double")), build), F.lit(0))


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def _upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0: the power series below 3, the continued fraction from there."""
    term = lambda acc, k: F.struct(
        (acc["s"] + acc["t"]).alias("s"), (acc["t"] * x * x / (2.0 * k + 1.0)).alias("t")
    )
    head = F.struct(F.lit(0.0).alias("s"), x.alias("t"))
    near = 0.5 - normal_density(x) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), head, term, lambda acc: acc["s"])
    far = normal_density(x) / (x + F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(0.0), lambda acc, k: k / (x + acc)))
    return F.when(x < 3.0, near).otherwise(far)


def normal_sf(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, to a relative 1e-12 in the upper tail."""
    return bound(z, lambda x: F.when(x >= 0, _upper_tail(F.abs(x))).otherwise(1.0 - _upper_tail(F.abs(x))))


def probit(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1): Halley's steps from a rational approximation."""
    c0, c1, c2 = (F.lit(c) for c in PROBIT_C)
    d1, d2, d3 = (F.lit(d) for d in PROBIT_D)

    def solve(q: Column) -> Column:
        t = F.sqrt(-2.0 * F.ln(q))
        first = F.greatest(t - (c0 + t * (c1 + t * c2)) / (1.0 + t * (d1 + t * (d2 + t * d3))), F.lit(0.0))

        def step(x: Column, _: Column) -> Column:
            return bound((q - _upper_tail(x)) / normal_density(x), lambda u: x - u / (1.0 + x * u / 2.0))

        return F.aggregate(F.sequence(F.lit(1), F.lit(3)), first, lambda x, i: F.greatest(step(x, i), F.lit(0.0)))

    return F.when(p < 0.5, -bound(p, solve)).otherwise(bound(1.0 - p, solve))


def t_quantile_975(df: Column) -> Column:
    """Two-sided 95 % t quantile; beyond 30 degrees of freedom the Cornish-Fisher expansion, which meets the list there."""
    z = Z_975
    terms = (
        (z**3 + z) / 4.0,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96.0,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0,
    )
    far = F.lit(z)
    for i, term in enumerate(terms):
        far = far + F.lit(term) / F.pow(df.cast("double"), F.lit(i + 1.0))
    table = F.array(*[F.lit(v) for v in T_975])
    return F.when(df < 1, F.lit(None)).when(df <= len(T_975), F.get(table, df.cast("int") - 1)).otherwise(far)


def log_factorial(n: str) -> str:
    """SQL text of ln n! for a whole double column: listed below 8, Stirling's series from there."""
    table = ", ".join(f"{math.lgamma(i + 1.0)!r}D" for i in range(8))
    half_log = repr(0.5 * math.log(2 * math.pi))
    tail = f"1D/(12*{n}) - 1D/(360*pow({n},3)) + 1D/(1260*pow({n},5)) - 1D/(1680*pow({n},7))"
    return f"CASE WHEN {n} < 8 THEN get(array({table}), int({n})) ELSE ({n}+0.5D)*ln({n}) - {n} + {half_log}D + {tail} END"


def log_choose(n: str, k: str) -> str:
    rest = f"({n}-{k})"
    return f"(({log_factorial(n)}) - ({log_factorial(k)}) - ({log_factorial(rest)}))"


def hypergeometric_pmf(k: str, good: str, drawn: str, total: str) -> Column:
    """P(X = k) when ``drawn`` of ``total`` are taken and ``good`` of them count; double columns."""
    bad, left = f"({total}-{good})", f"({drawn}-{k})"
    return F.expr(f"exp({log_choose(good, k)} + {log_choose(bad, left)} - {log_choose(total, drawn)})")


def bisect_mode(up: bool, good: str, drawn: str, total: str) -> Column:
    """The count nearest to ``_mode`` above (below) it whose probability is at most ``_cap``.

    Reads the double columns ``_mode``, ``_lo``, ``_hi`` and ``_cap``; one past the end where
    there is none.
    """
    middle = "floor((s.near + s.far) / 2)"
    p = f"exp({log_choose(good, 'm')} + {log_choose(f'({total}-{good})', f'({drawn}-m)')} - {log_choose(total, drawn)})"
    step = (
        f"CASE WHEN abs(s.far - s.near) <= 1 THEN s ELSE get(transform(array(double({middle})), m -> "
        f"CASE WHEN {p} <= _cap THEN named_struct('near', s.near, 'far', m) ELSE named_struct('near', m, 'far', s.far) END), 0) END"
    )
    end = "_hi + 1" if up else "_lo - 1"
    return F.expr(
        f"CASE WHEN _pm <= _cap THEN _mode ELSE aggregate(sequence(1, 50), named_struct('near', _mode, 'far', {end}), (s, i) -> {step}, s -> s.far) END"
    )


def walk_tail(
    start: str, first: str, count: str, good: str, drawn: str, total: str, up: bool, at_most: str | None = None
) -> Column:
    """Sum of ``count`` hypergeometric probabilities from ``start`` on, each from the one before.

    ``first`` is the probability at ``start``; with ``at_most`` only probabilities up to
    that bound are added.  All arguments are SQL text over double columns.
    """
    if up:
        k = f"({start}+i)"
        ratio = f"({good}-{k})*({drawn}-{k})/(({k}+1)*({total}-{good}-{drawn}+{k}+1))"
    else:
        k = f"({start}-i)"
        ratio = f"{k}*({total}-{good}-{drawn}+{k})/(({good}-{k}+1)*({drawn}-{k}+1))"
    add = "acc.p" if at_most is None else f"CASE WHEN acc.p <= {at_most} THEN acc.p ELSE 0D END"
    step = f"named_struct('s', acc.s + {add}, 'p', CASE WHEN acc.p > 0 THEN acc.p*{ratio} ELSE 0D END)"
    return F.expr(
        f"CASE WHEN {count} < 1 THEN 0D ELSE aggregate(sequence(0, int({count})-1), "
        f"named_struct('s', 0D, 'p', {first}), (acc, i) -> {step}, acc -> acc.s) END"
    )


def _log_gamma_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0: the asymptotic series 16 further on, and the steps back."""
    b = a + 16.0
    out = 0.5 * F.ln(b) - 1.0 / (8.0 * b) + 1.0 / (192.0 * b * b * b) - 1.0 / (640.0 * F.pow(b, F.lit(5.0)))
    out = out + 17.0 / (14336.0 * F.pow(b, F.lit(7.0)))
    for j in range(16):
        out = out - F.log1p(0.5 / (a + float(j)))
    return out


def _beta_fraction(x: Column, a: Column, b: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta integral by Lentz's method."""

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d1 = 1.0 / (1.0 + even * acc["d"])
        c1 = 1.0 + even / acc["c"]
        d2 = 1.0 / (1.0 + odd * d1)
        c2 = 1.0 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * d1 * c1 * d2 * c2).alias("h"))

    d = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    first = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), first, step, lambda acc: acc["h"])


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) as an incomplete beta integral, to a relative 1e-11; any positive degrees of freedom."""

    def of(n: Column, t2: Column) -> Column:
        a, b = n / 2.0, F.lit(0.5)
        x, y = n / (n + t2), t2 / (n + t2)
        steps = (100 + 2 * F.sqrt(n)).cast("int")
        front = F.exp(_log_gamma_step(a) - F.lit(0.5 * math.log(math.pi)) - a * F.log1p(t2 / n) + 0.5 * F.ln(y))
        tail = front * _beta_fraction(x, a, b, steps) / a
        body = 1.0 - front * _beta_fraction(y, b, a, steps) / b
        return F.when(t2 == 0, F.lit(1.0)).when(x < (a + 1.0) / (a + 2.5), tail).otherwise(body)

    return bound(df, lambda n: bound(t * t, lambda t2: of(n, t2)))


def round_significant(x: Column, digits: int) -> Column:
    """Round to a number of significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)
