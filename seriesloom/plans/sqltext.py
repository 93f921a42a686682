"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations


def sf_sql(z: str) -> str:
    """P(Z > z): the series of the distribution function below 2, Craig's integral by the midpoint rule from there."""
    x = f"abs({z})"
    near = (
        f"(0.5-exp(-{x}*{x}/2)/sqrt(2*pi())*list_sum(list_transform(range(0,50), lambda k: "
        f"pow({x},2*k+1)*exp(lgamma(k+1.0::DOUBLE)+k*ln(2.0::DOUBLE)-lgamma(2*k+2.0::DOUBLE)))))"
    )
    far = f"(list_sum(list_transform(range(0,200), lambda k: exp(-{x}*{x}/(2*pow(sin((k+0.5::DOUBLE)*pi()/400),2)))))/400)"
    tail = f"(CASE WHEN {x}<2 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z}>=0 THEN {tail} ELSE 1-{tail} END)"


def quantile_sql(p: str, steps: int = 60) -> str:
    """Standard normal quantile of ``p`` in (0, 1): bisection on the tail."""
    q = f"least({p},1-{p})"
    tail = sf_sql("(s[1]+s[2])/2")
    walk = (
        f"list_reduce(list_prepend([0.0::DOUBLE,40.0::DOUBLE], list_transform(range(0,{steps}), lambda i: [0.0::DOUBLE,0.0::DOUBLE])), "
        f"lambda s, i: CASE WHEN {tail}>{q} THEN [(s[1]+s[2])/2,s[2]] ELSE [s[1],(s[1]+s[2])/2] END)[1]"
    )
    return f"(CASE WHEN {p}<0.5 THEN -1 ELSE 1 END*{walk})"


def bh_sql(src: str, p: str = "pvalue", out: str = "padj", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT * EXCLUDE (raw_), least(1.0::DOUBLE, min(raw_) OVER ({part}ORDER BY {p} DESC)) AS {out} FROM "
        f"(SELECT *, {p}*count({p}) OVER ({part})/count({p}) OVER ({part}ORDER BY {p}) AS raw_ FROM {src})"
    )


def holm_sql(src: str, p: str = "pvalue", out: str = "padj", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT * EXCLUDE (raw_), least(1.0::DOUBLE, max(raw_) OVER ({part}ORDER BY {p})) AS {out} FROM "
        f"(SELECT *, {p}*(count(*) OVER ({part})-rank() OVER ({part}ORDER BY {p})+1) AS raw_ FROM {src})"
    )


def hyper_sql(k: str, good: str, drawn: str, total: str, two_sided: bool = False) -> str:
    """Hypergeometric tail with the engine's own lgamma, summed over the whole support."""

    def lch(n: str, r: str) -> str:
        return f"(lgamma(({n})+1.0::DOUBLE)-lgamma(({r})+1.0::DOUBLE)-lgamma(({n})-({r})+1.0::DOUBLE))"

    def lp(x: str) -> str:
        return f"({lch(good, x)}+{lch(f'({total})-({good})', f'({drawn})-({x})')}-{lch(total, drawn)})"

    low, high = f"greatest(0,({drawn})+({good})-({total}))", f"least({drawn},{good})"
    if two_sided:
        terms = f"list_transform(range({low},{high}+1), lambda x: CASE WHEN {lp('x')}<={lp(k)}+1e-7 THEN exp({lp('x')}) ELSE 0.0::DOUBLE END)"
    else:
        terms = f"list_transform(range(greatest({k},{low}),{high}+1), lambda x: exp({lp('x')}))"
    return f"least(1.0::DOUBLE, coalesce(list_sum({terms}),0.0))"


def t_sql(t: str, df: str) -> str:
    """P(|T| > |t|) for whole degrees of freedom by the closed series with gamma functions."""
    th = f"atan(abs({t})/sqrt({df}))"
    odd = (
        f"list_sum(list_transform(range(0,CAST(({df}-1)//2 AS BIGINT)), lambda j: pow(cos({th}),2*j+1)"
        f"*exp(lgamma(j+1.0::DOUBLE)+lgamma(1.5::DOUBLE)-lgamma(j+1.5::DOUBLE))))"
    )
    even = (
        f"list_sum(list_transform(range(0,CAST({df}//2 AS BIGINT)), lambda j: pow(cos({th}),2*j)"
        f"*exp(lgamma(j+0.5::DOUBLE)-lgamma(0.5::DOUBLE)-lgamma(j+1.0::DOUBLE))))"
    )
    return f"(CASE WHEN {df}%2=1 THEN 1-2/pi()*({th}+sin({th})*coalesce({odd},0)) ELSE 1-sin({th})*coalesce({even},0) END)"


def signif_sql(x: str, digits: int) -> str:
    scale = f"pow(10.0::DOUBLE,{digits}-ceil(log10(abs({x}))))"
    return f"(CASE WHEN {x}=0 THEN 0.0 ELSE round({x}*{scale})/{scale} END)"


def dtw_ctes(src: str, n: int, keys: str = "a, b", band: int | None = None) -> dict[str, str]:
    """Warping distance of the list columns ``x`` and ``y`` of ``src``: one CTE per row of the cost table.

    ``dw`` holds the result as ``d``; cells further than ``band`` from the diagonal have no cost.
    """
    if band is not None:
        return _banded_ctes(src, n, keys, band)
    out, before = {}, src
    for i in range(1, n + 1):
        cells = []
        for j in range(1, n + 1):
            c = f"abs(x[{i}]-y[{j}])"
            steps = [f"p{j}+{c}"] if i > 1 else []
            if j > 1:
                steps.append(f"q{j - 1}+{c}")
            if i > 1 and j > 1:
                steps.append(f"p{j - 1}+2*{c}")
            cells.append(f"{f'least({chr(44).join(steps)})' if steps else c} AS q{j}")
        out[f"w{i}"] = f"SELECT {keys}, x, y, {', '.join(cells)} FROM {before}"
        out[f"v{i}"] = f"SELECT {keys}, x, y, {', '.join(f'q{j} AS p{j}' for j in range(1, n + 1))} FROM w{i}"
        before = f"v{i}"
    out["dw"] = f"SELECT {keys}, p{n} AS d FROM {before}"
    return out


def _banded_ctes(src: str, n: int, keys: str, band: int) -> dict[str, str]:
    """By diagonals of the table, whose cells need only the two diagonals before: a step of the recursion each."""
    cell = lambda name, i: f"coalesce({name}[{i}], 'inf'::DOUBLE)"
    cost = "abs(x[i]-y[s-i])"
    steps = f"least({cell('p', 'i-1')}+{cost}, {cell('p', 'i')}+{cost}, {cell('q', 'i-1')}+2*{cost})"
    inside = f"s-i BETWEEN 1 AND {n} AND abs(s-2*i)<={band}"
    row = f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN {inside} THEN {steps} END)"
    first = f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN i=1 THEN abs(x[1]-y[1]) END)"
    nothing = f"list_transform(range(1, {n + 1}), lambda i: NULL::DOUBLE)"
    return dict(
        dg=f"""SELECT {keys}, x, y, 3 AS s, {first} AS p, {nothing} AS q FROM {src}
               UNION ALL SELECT {keys}, x, y, s+1, {row}, p FROM dg WHERE s<={2 * n}""",
        dw=f"SELECT {keys}, p[{n}] AS d FROM dg WHERE s={2 * n + 1}",
    )


def f_tail_sql(f: str, df1: str, df2: str, steps: int = 4000) -> str:
    """P(F > f) by Simpson's rule on the incomplete beta integral; smooth for df1 > 2 and df2 > 2."""
    a, b, x = f"({df2}/2.0::DOUBLE)", f"({df1}/2.0::DOUBLE)", f"({df2}/({df2}+{df1}*{f}))"
    g = f"pow({x}*i/{steps},{a}-1)*pow(1-{x}*i/{steps},{b}-1)*CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0,{steps + 1}), lambda i: {g}))*{x}/{steps}/3"
    return f"({area}*exp(lgamma({a}+{b})-lgamma({a})-lgamma({b})))"


def quadratic_ctes(src: str, n: int) -> dict[str, str]:
    """d' S^-1 d by elimination, one CTE per pivot.

    ``src`` has id columns ``k``, the upper triangle ``s<i>_<j>`` and ``d<i>``; the last
    CTE ``qf`` holds the result as ``q``.
    """
    out, before = {}, f"(SELECT *, 0.0::DOUBLE AS q FROM {src})"
    for k in range(1, n + 1):
        cols = [f"s{i}_{j}-s{k}_{i}*s{k}_{j}/s{k}_{k} AS s{i}_{j}" for i in range(k + 1, n + 1) for j in range(i, n + 1)]
        cols += [f"d{i}-d{k}*s{k}_{i}/s{k}_{k} AS d{i}" for i in range(k + 1, n + 1)]
        out[f"e{k}"] = f"SELECT {', '.join(['k', f'q+d{k}*d{k}/s{k}_{k} AS q', *cols])} FROM {before}"
        before = f"e{k}"
    out["qf"] = f"SELECT k, q FROM {before}"
    return out
