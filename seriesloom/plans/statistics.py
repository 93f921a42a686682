"""Rank, exact and enrichment tests with their adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.numeric import safe_div
from seriesloom.operators import annotate as N
from seriesloom.operators import sets as S
from seriesloom.operators import odds as O
from seriesloom.operators import statistics as T
from seriesloom.operators.pairs import filter_pairs, pair_corr
from seriesloom.operators.scan import exact_quantiles
from seriesloom.plans.bindings import BY, TIMES, Tables, g_clusters, rounded, with_
from seriesloom.plans.pairs import brand_profiles, supplier_profiles
from seriesloom.plans.registry import query
from seriesloom.plans.sets import TAGGED, tagged_in_one_pass
from seriesloom.plans.sqltext import bh_sql, holm_sql, hyper_sql, quantile_sql, sf_sql, t_sql
from seriesloom.plans.tables import STRONG, TREND0, strong_pairs


def rank_sum_ctes(src: str, pairs: str, by: str = "") -> dict[str, str]:
    """Rank sums by pooled mid-ranks; ``pairs`` lists (c1, c2).  ``by`` is a column of ``src`` that values are kept apart by."""
    k = f"{by}, " if by else ""
    some = " WHERE n1>0 AND n2>0" if by else ""
    return dict(
        src=src,
        pr=pairs,
        ranked=f"""SELECT {k}c1, c2, cat, value, rank() OVER (PARTITION BY {k}c1,c2 ORDER BY value) + (count(*) OVER (PARTITION BY {k}c1,c2,value)-1)/2.0 AS r,
                count(*) OVER (PARTITION BY {k}c1,c2,value) AS tie FROM src JOIN pr ON cat=c1 OR cat=c2""",
        ag=f"""SELECT {k}c1, c2, count(*) FILTER (cat=c1) AS n1, count(*) FILTER (cat=c2) AS n2, sum(r) FILTER (cat=c1) AS rs, sum(tie*tie-1.0::DOUBLE) AS ties
               FROM ranked GROUP BY {k}c1, c2""",
        st0=f"""SELECT {k}c1 AS cat1, c2 AS cat2, n1, n2, rs-n1*(n1+1)/2.0 AS w, sqrt(n1/12.0*n2*((n1+n2+1)-ties/((n1+n2)*(n1+n2-1.0)))) AS sg FROM ag{some}""",
    )


PRIORITY = ["correlated", "random"]
TAG_PAIRS = "SELECT * FROM (VALUES ('correlated','random'),('correlated','anticorrelated'),('correlated','proximal'),('random','anticorrelated'),('random','proximal'),('anticorrelated','proximal')) v(c1,c2)"
TAG_VALUES = f"SELECT cat, value FROM ({TAGGED})"
GREATER = dict(rank_sum_ctes(TAG_VALUES, TAG_PAIRS), st1="SELECT *, (w-n1*n2/2.0-0.5)/sg AS z FROM st0")


@query("rank_sum_test", with_("", f"SELECT cat1, cat2, n1, n2, w::DOUBLE AS w, round(z,6) AS z, round({sf_sql('z')},6) AS pvalue FROM st1", **GREATER))
def rank_sum_test(t):
    return rounded(T.rank_sum(tagged_in_one_pass(t), "cat", "value", "greater", PRIORITY), "z", "pvalue")


TWO = dict(
    rank_sum_ctes("SELECT l_returnflag AS cat, l_extendedprice AS value FROM lineitem", "SELECT * FROM (VALUES ('A','N'),('A','R'),('N','R')) v(c1,c2)"),
    st1="SELECT *, (w-n1*n2/2.0-sign(w-n1*n2/2.0)*0.5)/sg AS z FROM st0",
    st2="SELECT *, abs(z) AS az FROM st1",
)


@query("rank_sum_two_sided", with_("", f"SELECT cat1, cat2, n1, n2, w::DOUBLE AS w, round(z,6) AS z, round(least(1.0::DOUBLE,2*{sf_sql('az')}),6) AS pvalue FROM st2", **TWO))
def rank_sum_two_sided(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("category"), F.col("l_extendedprice").alias("value"))
    return rounded(T.rank_sum(rows, alternative="two-sided"), "z", "pvalue")


# Account balances of market segments within a nation: a dozen customers each at a small scale, so the exact law decides.
SMALL = dict(
    rank_sum_ctes(
        "SELECT c_nationkey, c_mktsegment AS cat, c_acctbal AS value FROM customer",
        "SELECT a.s AS c1, b.s AS c2 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) a JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) b ON a.s<b.s",
        "c_nationkey",
    ),
    small="SELECT c_nationkey, c1 AS cat1, c2 AS cat2, n1, n2 FROM ag WHERE n1 BETWEEN 1 AND 49 AND n2 BETWEEN 1 AND 49 AND ties=0",
    law="""SELECT * FROM (WITH RECURSIVE d(i, m, w, c) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL
           SELECT i+1, m+z, w+z*(i-m), sum(c) FROM d, (VALUES (0),(1)) v(z)
           WHERE i<(SELECT max(n1+n2) FROM small) AND m+z<=(SELECT max(n1) FROM small) AND i+1-(m+z)<=(SELECT max(n2) FROM small) GROUP BY 1,2,3) SELECT * FROM d) x""",
    st1="SELECT *, (w-n1*n2/2.0-sign(w-n1*n2/2.0)*0.5)/sg AS z FROM st0",
    st2="SELECT *, abs(z) AS az FROM st1",
    ex="""SELECT s.c_nationkey, s.cat1, s.cat2, least(1.0::DOUBLE, 2*least(sum(c) FILTER (l.w>=s.w), sum(c) FILTER (l.w<=s.w))/sum(c)) AS p
          FROM (SELECT st0.* FROM st0 JOIN small USING (c_nationkey, cat1, cat2)) s JOIN law l ON l.m=s.n1 AND l.i=s.n1+s.n2 GROUP BY 1,2,3""",
)


@query(
    "rank_sum_exact",
    with_(
        "",
        f"""SELECT st2.c_nationkey, cat1, cat2, n1, n2, w::DOUBLE AS w, round(coalesce(p, least(1.0::DOUBLE,2*{sf_sql('az')})),6) AS pvalue
            FROM st2 LEFT JOIN ex USING (c_nationkey, cat1, cat2)""",
        **SMALL,
    ),
)
def rank_sum_exact(t):
    tested = T.rank_sum(t.table("customer"), "c_mktsegment", "c_acctbal", "two-sided", by=["c_nationkey"], exact_below=50)
    return rounded(tested.drop("z"), "pvalue")


@query(
    "midrank",
    "SELECT DISTINCT l_quantity AS value, count(*) OVER (PARTITION BY l_quantity) AS n_ties, rank() OVER (ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_quantity)-1)/2.0::DOUBLE AS midrank FROM lineitem",
)
def midrank(t):
    return T.midrank(t.lineitem.select(F.col("l_quantity").alias("value")), "value")


@query("ecdf_rank", "SELECT DISTINCT l_returnflag AS cat, l_extendedprice AS value, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice),9) AS ecdf FROM lineitem")
def ecdf_rank(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("cat"), F.col("l_extendedprice").alias("value"))
    return rounded(T.ecdf_rank(rows, "value", ["cat"]), "ecdf", digits=9)


@query(
    "plotting_positions",
    f"""WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank, count(*) OVER () AS n FROM part),
       p AS (SELECT id, rank, (rank-0.5::DOUBLE)/n AS position FROM r)
       SELECT id, rank, round(position,6) AS position, round({quantile_sql('position')},6) AS quantile FROM p""",
)
def plotting_positions(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return rounded(T.plotting_positions(rows, "v", "id").select("id", "rank", "position", "quantile"), "position", "quantile")


def flag_tables(t: Tables):
    """Per supplier a 2x2 table: large or small lines by line status."""
    big, open_ = F.col("l_quantity") > 25, F.col("l_linestatus") == "O"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count_if(big & open_).alias("a"), F.count_if(~big & open_).alias("b"), F.count_if(big & ~open_).alias("c"), F.count_if(~big & ~open_).alias("d")
    )


FLAGS = """SELECT l_suppkey AS id, count(*) FILTER (l_quantity>25 AND l_linestatus='O') AS a, count(*) FILTER (l_quantity<=25 AND l_linestatus='O') AS b,
   count(*) FILTER (l_quantity>25 AND l_linestatus<>'O') AS c, count(*) FILTER (l_quantity<=25 AND l_linestatus<>'O') AS d FROM lineitem GROUP BY 1"""


@query(
    "fisher_2x2",
    f"""SELECT id, a, b, c, d, round(a*d/nullif(b*c::DOUBLE,0),6) AS odds, round({hyper_sql('a', 'a+b', 'a+c', 'a+b+c+d', True)},6) AS pvalue FROM ({FLAGS})""",
)
def fisher_2x2(t):
    return rounded(T.fisher(flag_tables(t)), "odds", "pvalue")


@query(
    "fisher_greater",
    f"""SELECT id, a, b, c, d, round(a*d/nullif(b*c::DOUBLE,0),6) AS odds, round({hyper_sql('a', 'a+b', 'a+c', 'a+b+c+d')},6) AS pvalue FROM ({FLAGS})""",
)
def fisher_greater(t):
    return rounded(T.fisher(flag_tables(t), "greater"), "odds", "pvalue")


def odds_root_ctes(src: str) -> dict[str, str]:
    """Estimate and 95 % limits of ``src(id, a, b, c, d)`` by halving over the listed chances of all counts; ``ro`` holds them."""
    law = "list_transform(ks, lambda k: lws[k-k0+1]+k*x)"
    p = "list_transform(l, lambda v: exp(v-list_max(l)))"
    tail = lambda side: f"list_sum(list_transform(range(1, len(p)+1), lambda i: CASE WHEN k0+i-1{side}a THEN p[i] ELSE 0 END))/list_sum(p)"
    mean = "list_sum(list_transform(range(1, len(p)+1), lambda i: (k0+i-1)*p[i]))/list_sum(p)"
    low = f"CASE which WHEN 'estimate' THEN {mean}<a WHEN 'low' THEN {tail('>=')}<0.025 ELSE {tail('<=')}>0.025 END"
    return dict(
        mg=f"SELECT id, a, a+b AS r, a+c AS cl, a+b+c+d AS n, greatest(0, a+b+a+c-(a+b+c+d)) AS k0, least(a+b, a+c) AS k1 FROM {src}",
        lw="""SELECT id, a, k0, k1, range(k0, k1+1) AS ks,
              list_transform(range(k0, k1+1), lambda k: -(lgamma(k+1)+lgamma(r-k+1)+lgamma(cl-k+1)+lgamma(n-r-cl+k+1))) AS lws FROM mg WHERE k1>k0""",
        bi=f"""SELECT id, a, k0, k1, ks, lws, which, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi, 0 AS step FROM lw, (VALUES ('estimate'), ('low'), ('high')) w(which)
               UNION ALL SELECT id, a, k0, k1, ks, lws, which, CASE WHEN up THEN x ELSE lo END, CASE WHEN up THEN hi ELSE x END, step+1 FROM
               (SELECT *, {low} AS up FROM (SELECT *, {p} AS p FROM (SELECT *, {law} AS l FROM (SELECT *, (lo+hi)/2 AS x FROM bi WHERE step<60))))""",
        ro="""SELECT id, max(CASE WHEN which='estimate' THEN CASE WHEN a=k0 THEN 0.0::DOUBLE WHEN a=k1 THEN 'inf'::DOUBLE ELSE exp(lo) END END) AS estimate,
              max(CASE WHEN which='low' THEN CASE WHEN a=k0 THEN 0.0::DOUBLE ELSE exp(lo) END END) AS low,
              max(CASE WHEN which='high' THEN CASE WHEN a=k1 THEN 'inf'::DOUBLE ELSE exp(lo) END END) AS high FROM bi WHERE step=60 GROUP BY 1""",
    )


@query(
    "odds_interval",
    "WITH RECURSIVE "
    + with_(
        "",
        """SELECT fl.id, a, b, c, d, round(a*d/nullif(b*c::DOUBLE,0),6) AS odds, round(estimate,6) AS estimate, round(coalesce(low,0.0::DOUBLE),6) AS low,
           round(coalesce(high,'inf'::DOUBLE),6) AS high FROM fl LEFT JOIN ro ON ro.id=fl.id""",
        fl=FLAGS,
        **odds_root_ctes("fl"),
    ).removeprefix("WITH "),
)
def odds_interval(t):
    """The conditional odds ratio with its 95 % limits beside the sample ratio."""
    tables = flag_tables(t).withColumn("odds", safe_div(F.col("a").cast("double") * F.col("d"), (F.col("b") * F.col("c")).cast("double")))
    return rounded(O.odds_interval(tables), "odds", "estimate", "low", "high")


PVALS = f"SELECT id, {hyper_sql('a', 'a+b', 'a+c', 'a+b+c+d', True)} AS pvalue FROM ({FLAGS})"


@query("p_adjust_bh", with_("", "SELECT id, round(padj,6) AS padj FROM x", p=PVALS, x=bh_sql("p")))
def p_adjust_bh(t):
    return rounded(T.p_adjust(T.fisher(flag_tables(t))).select("id", "padj"), "padj")


@query("p_adjust_holm", with_("", "SELECT id, round(padj,6) AS padj FROM x", p=PVALS, x=holm_sql("p")))
def p_adjust_holm(t):
    return rounded(T.p_adjust(T.fisher(flag_tables(t)), method="holm").select("id", "padj"), "padj")


@query("p_adjust_bonferroni", with_("", "SELECT id, round(least(1.0::DOUBLE, pvalue*count(*) OVER ()),6) AS padj FROM p", p=PVALS))
def p_adjust_bonferroni(t):
    return rounded(T.p_adjust(T.fisher(flag_tables(t)), method="bonferroni").select("id", "padj"), "padj")


@query(
    "token_enrichment",
    with_(
        "pairs cat_g cat_l",
        "SELECT condition, token, n_a, n_b, t_a, t_b, round(odds,6) AS odds, round(pvalue,6) AS pvalue, round(qvalue,6) AS qvalue FROM x",
        st=STRONG,
        ta="SELECT condition, count(DISTINCT a) AS t_a, count(DISTINCT b) AS t_b FROM st GROUP BY 1",
        ct="""SELECT ta.condition, p.p_partkey AS token, coalesce(x.n,0) AS n_a, coalesce(y.n,0) AS n_b, t_a, t_b FROM part p CROSS JOIN ta
              LEFT JOIN (SELECT condition, token, count(*) AS n FROM cat_l JOIN (SELECT DISTINCT condition, a FROM st) ON entity=a GROUP BY 1,2) x
                ON x.token=p.p_partkey AND x.condition=ta.condition
              LEFT JOIN (SELECT condition, token, count(*) AS n FROM cat_g JOIN (SELECT DISTINCT condition, b FROM st) ON entity=b GROUP BY 1,2) y
                ON y.token=p.p_partkey AND y.condition=ta.condition""",
        pv=f"""SELECT *, CASE WHEN n_a+n_b=0 OR (n_a=t_a AND n_b=t_b) THEN 1.0 ELSE n_a*(t_b-n_b)/nullif((n_b*(t_a-n_a))::DOUBLE,0) END AS odds,
               {hyper_sql('n_a', 'n_a+n_b', 't_a', 't_a+t_b')} AS pvalue FROM ct""",
        x=holm_sql("pv", out="qvalue", by="condition"),
    ),
)
def token_enrichment(t):
    listed = t.part.select(F.col("p_partkey").alias("token"))
    out = T.token_enrichment(strong_pairs(t), S.token_catalog(t.site_rows_l), S.token_catalog(t.site_rows_g), listed, BY)
    return rounded(out, "odds", "pvalue", "qvalue")


def memberships(t: Tables):
    """Every part in its type and its brand."""
    cats = F.explode(F.array(F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand")))
    return t.part.select(F.col("p_partkey").alias("id"), cats.alias("category"))


def top_parts(t: Tables):
    """Parts whose revenue exceeds the 90 % quantile of all parts with sales."""
    revenue = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity") * 100).cast("long").alias("revenue"))
    cut = exact_quantiles(revenue, [], "revenue", {"cut": 0.9}).select("cut").scalar()
    return revenue.filter(F.col("revenue") > cut).select("id")


ORA = dict(
    rv="SELECT l_partkey AS id, CAST(sum(l_quantity*100) AS BIGINT) AS revenue FROM lineitem GROUP BY 1",
    hits="SELECT id FROM rv WHERE revenue > (SELECT quantile_cont(revenue,0.9) FROM rv)",
    mem="SELECT p_partkey AS id, 'type:'||p_type AS category FROM part UNION ALL SELECT p_partkey, 'brand:'||p_brand FROM part",
    ct="""SELECT m.category, count(h.id) AS n_hit, count(*) AS n_cat, (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM part) AS n_total
          FROM mem m LEFT JOIN hits h USING (id) GROUP BY 1 HAVING count(h.id)>0""",
    pv=f"SELECT *, round((n_hit/n_hits)/(n_cat/n_total),3) AS fold, {hyper_sql('n_hit', 'n_cat', 'n_hits', 'n_total')} AS pvalue FROM ct",
    ora=bh_sql("pv"),
)


def enrichment(t: Tables):
    return T.over_representation(top_parts(t), memberships(t))


@query("over_representation", with_("", "SELECT category, n_hit, n_cat, n_hits, n_total, fold, round(pvalue,6) AS pvalue, round(padj,6) AS padj FROM ora", **ORA))
def over_representation(t):
    return rounded(enrichment(t), "pvalue", "padj")


@query(
    "over_representation_stratified",
    with_(
        "",
        """SELECT category, n_hit, round(expected,6) AS expected FROM ora JOIN (SELECT m.category, sum(r.rate) AS expected FROM mem m JOIN sz ON sz.id=m.id JOIN r USING (stratum) GROUP BY 1) USING (category)""",
        **ORA,
        sz="SELECT p_partkey AS id, p_size//5 AS stratum FROM part",
        r="SELECT stratum, count(h.id)/count(*) AS rate FROM sz LEFT JOIN hits h USING (id) GROUP BY 1",
    ),
)
def over_representation_stratified(t):
    """Hits expected from the part sizes alone, beside the observed ones."""
    strata = t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_size") / 5).alias("stratum"))
    out = T.over_representation(top_parts(t), memberships(t), strata=strata)
    return rounded(out.select("category", "n_hit", "expected"), "expected")


@query("fold_enrichment", with_("", "SELECT category, fold FROM ora", **ORA))
def fold_enrichment(t):
    return enrichment(t).select("category", "fold")


def nation_terms(t: Tables):
    """Suppliers of a nation over-represent the parts they sell: hits per nation, terms are types and brands."""
    clusters = g_clusters(t).select(F.regexp_replace("entity", "^G0*(?=.)", "").cast("long").alias("l_suppkey"), "cluster")
    sold = t.lineitem.join(clusters, "l_suppkey")
    return T.over_representation(sold.select("cluster", F.col("l_partkey").alias("id")), memberships(t), by=["cluster"])


TERMS = dict(
    mem=ORA["mem"],
    sold="SELECT DISTINCT 'N'||CAST(s_nationkey AS VARCHAR) AS cluster, l_partkey AS id FROM lineitem JOIN supplier ON l_suppkey=s_suppkey",
    ct="""SELECT s.cluster, m.category, count(*) AS n_hit, any_value(c.n) AS n_cat, any_value(z.n) AS n_hits, (SELECT count(*) FROM part) AS n_total FROM sold s
          JOIN mem m USING (id) JOIN (SELECT category, count(*) AS n FROM mem GROUP BY 1) c ON c.category=m.category
          JOIN (SELECT cluster, count(*) AS n FROM sold GROUP BY 1) z ON z.cluster=s.cluster GROUP BY 1,2""",
    pv=f"SELECT *, round((n_hit/n_hits)/(n_cat/n_total),3) AS fold, {hyper_sql('n_hit', 'n_cat', 'n_hits', 'n_total')} AS pvalue FROM ct",
    ora=bh_sql("pv", by="cluster"),
)


@query(
    "top_terms_per_cluster",
    with_(
        "",
        """SELECT cluster, category, round(padj,6) AS padj, fold, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(padj,9), round(pvalue,9), category) AS rank
           FROM ora WHERE category LIKE 'brand:%') WHERE rank<=10""",
        **TERMS,
    ),
)
def top_terms_per_cluster(t):
    """The ten most significant brands per nation."""
    brands = nation_terms(t).filter("category LIKE 'brand:%'")
    top = N.top_terms_per_cluster(brands, "cluster", 10, [F.round("padj", 9), F.round("pvalue", 9), "category"])
    return rounded(top.select("cluster", "category", "padj", "fold", F.col("rank").cast("long").alias("rank")), "padj")


@query(
    "top_k_terms",
    with_("", "SELECT cluster, category, fold FROM ora WHERE padj<=0.999 ORDER BY fold DESC, cluster, category LIMIT 25", **TERMS),
)
def top_k_terms(t):
    kept = nation_terms(t).filter("padj <= 0.999").select("cluster", "category", "fold")
    return N.top_k(kept, 25, [F.desc("fold"), "cluster", "category"])


def sold_terms(t: Tables):
    """Terms of a module: the part types and sizes its brands or nations trade in."""
    nation = t.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("g"))
    rows = t.lines_with_brand.join(nation, "l_suppkey")
    term = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    both = F.explode(F.array(F.col("g"), F.concat(F.lit("M"), F.right("p_brand", F.lit(1)))))
    return rows.select(both.alias("cluster"), term.alias("term")).distinct()


@query(
    "category_overlap_test",
    with_(
        "cpairs",
        """SELECT condition, set1, set2, a, b, c, d, round(a*d/nullif((b*c)::DOUBLE,0),6) AS odds, round(pvalue,6) AS pvalue, round(qvalue,6) AS qvalue FROM x WHERE qvalue<0.5""",
        rw="""SELECT p_type||'/'||CAST(p_size AS VARCHAR) AS term, 'N'||CAST(s_nationkey AS VARCHAR) AS g, 'M'||right(p_brand,1) AS l FROM lineitem
              JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey""",
        tm="SELECT DISTINCT g AS cluster, term FROM rw UNION SELECT DISTINCT l, term FROM rw",
        sz="SELECT cluster, count(*) AS n FROM tm GROUP BY 1",
        ct="""SELECT c.condition, c.set1, c.set2, coalesce(s.n,0) AS a, z2.n-coalesce(s.n,0) AS b, z1.n-coalesce(s.n,0) AS c, (SELECT count(DISTINCT term) FROM tm)-z1.n-z2.n+coalesce(s.n,0) AS d
              FROM cpairs c JOIN sz z1 ON z1.cluster=c.set1 JOIN sz z2 ON z2.cluster=c.set2 LEFT JOIN (SELECT x.cluster AS k1, y.cluster AS k2, count(*) AS n FROM tm x JOIN tm y USING (term) GROUP BY 1,2) s
              ON s.k1=c.set1 AND s.k2=c.set2 WHERE c.value>=0.3""",
        pv=f"SELECT *, {hyper_sql('a', 'a+b', 'a+c', 'a+b+c+d', True)} AS pvalue FROM ct",
        x=bh_sql("pv", out="qvalue", by="condition"),
    ),
)
def category_overlap_test(t):
    scored = pair_corr(brand_profiles(t), supplier_profiles(t), TIMES, by=BY)
    pairs = filter_pairs(scored.select(*BY, F.col("a").alias("set1"), F.col("b").alias("set2"), "value"), 0.3)
    return rounded(T.category_overlap_test(pairs, sold_terms(t), max_q=0.5, by=BY), "odds", "pvalue", "qvalue")


@query(
    "trend_test",
    with_(
        "expr_g",
        "SELECT entity, condition, n, round(slope,6) AS slope, round(r2,6) AS r2, round(f,5) AS f, round(pvalue,6) AS pvalue, round(padj,6) AS padj FROM x",
        t0=TREND0,
        t1="SELECT *, r2*(n-2)/(1-r2) AS f, sqrt(r2*(n-2)/(1-r2)) AS t, n-2 AS df FROM t0",
        t2=f"SELECT *, {t_sql('t', 'df')} AS pvalue FROM t1",
        x=bh_sql("t2", by="condition"),
    ),
)
def trend_test(t):
    out = T.linear_trend(t.expr_g).drop("intercept")
    return rounded(rounded(out, "slope", "r2", "pvalue", "padj"), "f", digits=5)


