"""Clusterings, their agreement, and small linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import clustering as C
from seriesloom.operators import models as M
from seriesloom.operators.pairs import distance_from_corr, pair_corr
from seriesloom.operators.scan import exact_quantiles
from seriesloom.operators.statistics import p_adjust
from seriesloom.plans.bindings import BY, CONDITIONS, TIMES, Tables, g_clusters, l_classes, l_id, rounded, with_
from seriesloom.plans.expression import normalised
from seriesloom.plans.pairs import supplier_profiles
from seriesloom.plans.registry import query
from seriesloom.plans.sqltext import f_tail_sql, quadratic_ctes
from seriesloom.session import materialize


def quartile_clusters(rows, entity):
    """Quartile of the yearly quantity of each entity: one clustering per year."""
    yearly = rows.groupBy((F.year("l_shipdate") - 1995).alias("iteration"), entity.alias("entity")).agg(
        F.sum("l_quantity").alias("v")
    )
    cuts = exact_quantiles(yearly, ["iteration"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    # one row of cuts per year
    labelled = yearly.join(F.broadcast(cuts), "iteration")
    k = sum((F.when(F.col("v") > F.col(q), 1).otherwise(0) for q in ("q1", "q2", "q3")), F.lit(0))
    return labelled.select("iteration", "entity", k.alias("cluster"))


def quartile_sql(entity: str, src: str) -> dict[str, str]:
    return dict(
        yr=f"SELECT CAST(year(l_shipdate)-1995 AS INTEGER) AS iteration, {entity} AS entity, sum(l_quantity) AS v FROM {src} GROUP BY 1,2",
        cu="SELECT iteration, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.5) AS q2, quantile_cont(v,0.75) AS q3 FROM yr GROUP BY 1",
        it="SELECT iteration, entity, (v>q1)::INT+(v>q2)::INT+(v>q3)::INT AS cluster FROM yr JOIN cu USING (iteration)",
    )


@query(
    "co_occurrence",
    with_(
        "",
        "SELECT x.entity AS a, y.entity AS b, round(count(*) FILTER (x.cluster=y.cluster)/7.0::DOUBLE,6) AS fraction FROM it x JOIN it y ON x.iteration=y.iteration AND x.entity<=y.entity GROUP BY 1,2",
        **quartile_sql("'L_'||p_brand", "lineitem JOIN part ON l_partkey=p_partkey"),
    ),
)
def co_occurrence(t):
    return rounded(C.co_occurrence(quartile_clusters(t.lines_with_brand, l_id("p_brand")), TIMES), "fraction")


CUT, MIN_SIZE = 0.25, 3
AGREED = 5 / 7
AGREEMENT = dict(
    quartile_sql("l_suppkey", "lineitem"),
    ag="""SELECT x.entity AS a, y.entity AS b, count(*) FILTER (x.cluster=y.cluster)/7.0::DOUBLE AS fraction FROM it x JOIN it y
          ON x.iteration=y.iteration AND x.entity<=y.entity GROUP BY 1,2 HAVING count(*) FILTER (x.cluster=y.cluster)>=5""",
)


def agreeing_suppliers(t: Tables):
    return C.co_occurrence(quartile_clusters(t.lineitem, F.col("l_suppkey")), TIMES, AGREED)


@query("agreement_pairs", with_("", "SELECT a, b, round(fraction,6) AS fraction FROM ag", **AGREEMENT))
def agreement_pairs(t):
    """Suppliers that fall into one cluster in at least five of seven years."""
    return rounded(agreeing_suppliers(t), "fraction")


@query(
    "agreement_clusters",
    with_(
        "",
        """SELECT entity, CASE WHEN count(*) OVER (PARTITION BY label)>=3 THEN label ELSE '0' END AS cluster FROM lab""",
        **AGREEMENT,
        ed="SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM ag UNION SELECT CAST(b AS VARCHAR), CAST(a AS VARCHAR) FROM ag",
        re="SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b=ed.a",
        lab="SELECT e.entity, coalesce(min(b), e.entity) AS label FROM (SELECT DISTINCT CAST(entity AS VARCHAR) AS entity FROM it) e LEFT JOIN re ON re.a=e.entity GROUP BY 1",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def agreement_clusters(t):
    """Clusters of suppliers by the share of years in which they do not fall into one cluster."""
    rows = materialize(quartile_clusters(t.lineitem, F.col("l_suppkey").cast("string")))
    same = C.agreement_classes(rows, TIMES, AGREED)
    near = C.co_occurrence(rows, TIMES, AGREED, representatives=True).withColumn("distance", 1 - F.col("fraction"))
    return C.threshold_clusters(near, rows.select("entity").distinct(), 1 - AGREED + 1e-9, MIN_SIZE, members=same)


CONCORDANCE = dict(
    ce="""SELECT c1, c2, k1, k2, count(*) AS n FROM (SELECT x.clustering AS c1, y.clustering AS c2, x.cluster AS k1, y.cluster AS k2 FROM cl x JOIN cl y
          ON x.entity=y.entity AND x.clustering<y.clustering) GROUP BY 1,2,3,4""",
    bo="SELECT c1, c2, sum(n*(n+1)/2.0::DOUBLE) AS a, sum(n)::DOUBLE AS n FROM ce GROUP BY 1,2",
    s1="SELECT c1, c2, sum(n*(n+1)/2.0::DOUBLE) AS s FROM (SELECT c1,c2,k1,sum(n)::DOUBLE AS n FROM ce GROUP BY 1,2,3) GROUP BY 1,2",
    s2="SELECT c1, c2, sum(n*(n+1)/2.0::DOUBLE) AS s FROM (SELECT c1,c2,k2,sum(n)::DOUBLE AS n FROM ce GROUP BY 1,2,3) GROUP BY 1,2",
    cn="""SELECT c1, c2, a, n*(n+1)/2-a-(s1.s-a)-(s2.s-a) AS b, s1.s-a AS c, s2.s-a AS d FROM bo JOIN s1 USING (c1,c2) JOIN s2 USING (c1,c2)""",
)
METRICS = """SELECT c1, c2, a, b, c, d, round((a+b)/(a+b+c+d),6) AS rand, round(2*(a*b-c*d)/nullif((a+d)*(d+b)+(a+c)*(c+b),0),6) AS adj_rand,
   round(a/(a+c),6) AS precision, round(a/(a+d),6) AS recall, round(2*(a/(a+c))*(a/(a+d))/(a/(a+c)+a/(a+d)),6) AS f1, round(a/(a+c+d),6) AS jaccard FROM cn"""
PART_CLUSTERS = """SELECT 'brand' AS clustering, p_partkey AS entity, p_brand AS cluster FROM part UNION ALL SELECT 'type', p_partkey, p_type FROM part
   UNION ALL SELECT 'size', p_partkey, CAST(p_size AS VARCHAR) FROM part"""


def part_clusterings(t: Tables):
    kinds = F.inline(
        F.array(
            F.struct(F.lit("brand").alias("clustering"), F.col("p_brand").alias("cluster")),
            F.struct(F.lit("type").alias("clustering"), F.col("p_type").alias("cluster")),
            F.struct(F.lit("size").alias("clustering"), F.col("p_size").cast("string").alias("cluster")),
        )
    )
    return t.part.select(F.col("p_partkey").alias("entity"), kinds)


@query("concordance_counts", with_("", "SELECT c1, c2, a, b, c, d FROM cn", cl=PART_CLUSTERS, **CONCORDANCE))
def concordance_counts(t):
    return C.concordance(part_clusterings(t)).select("c1", "c2", "a", "b", "c", "d")


@query(
    "concordance_metrics",
    with_("", METRICS, **quartile_sql("l_suppkey", "lineitem"), cl="SELECT iteration AS clustering, entity, cluster FROM it", **CONCORDANCE),
)
def concordance_metrics(t):
    """Agreement of the yearly quartile clusterings of the suppliers."""
    labelled = quartile_clusters(t.lineitem, F.col("l_suppkey")).withColumnRenamed("iteration", "clustering")
    return rounded(C.concordance(labelled), "rand", "adj_rand", "precision", "recall", "f1", "jaccard")


THRESHOLD_SQL = with_(
    "z_l",
    """SELECT condition, entity, CASE WHEN count(*) OVER (PARTITION BY condition, label)>=3 THEN label ELSE '0' END AS cluster FROM lab""",
    ed="""SELECT x.condition, x.entity AS a, y.entity AS b FROM z_l x JOIN z_l y ON x.time=y.time AND x.condition=y.condition WHERE x.n=7 AND y.n=7
          GROUP BY 1,2,3 HAVING abs(sum(x.z*y.z)/7-1)<=0.25""",
    re="SELECT condition, a, b FROM ed UNION SELECT re.condition, re.a, ed.b FROM re JOIN ed ON re.b=ed.a AND re.condition=ed.condition",
    lab="SELECT condition, a AS entity, min(b) AS label FROM re GROUP BY 1,2",
).replace("WITH ", "WITH RECURSIVE ", 1)


def brand_distances(t: Tables):
    """Distances up to the cut; farther pairs never leave the join."""
    return distance_from_corr(pair_corr(t.mean_l(), None, TIMES, min_value=1.0 - CUT, by=BY))


@query("threshold_clusters", THRESHOLD_SQL)
def threshold_clusters(t):
    nodes = t.mean_l().select(*BY, "entity").distinct()
    return C.threshold_clusters(brand_distances(t), nodes, CUT, MIN_SIZE, BY)


@query(
    "cluster_size_median",
    """SELECT condition, reference, median(n) AS median_size, count(*) AS n_clusters FROM (SELECT l_returnflag AS condition, l_linestatus AS reference, l_suppkey,
       count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1,2,3) GROUP BY 1,2""",
)
def cluster_size_median(t):
    sizes = t.lineitem.groupBy(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("reference"), "l_suppkey").agg(
        F.count_distinct("l_partkey").alias("size")
    )
    out = exact_quantiles(sizes, ["condition", "reference"], "size", {"median_size": 0.5})
    return out.select("condition", "reference", "median_size", F.col("n").alias("n_clusters"))


@query(
    "best_expr_class_profile",
    with_(
        "z_l prof_g class_l",
        """SELECT condition, class, module, sign, count(DISTINCT entity) AS n FROM (SELECT l.condition, l.entity, c.class, z.cluster AS module,
           CASE WHEN sum(l.z*z.z)/7>0 THEN 'positive' ELSE 'negative' END AS sign FROM z_l l JOIN z ON l.time=z.time AND l.condition=z.condition
           JOIN class_l c ON c.entity=l.entity WHERE l.n=7 GROUP BY 1,2,3,4 HAVING abs(sum(l.z*z.z)/7)>=0.5) GROUP BY 1,2,3,4""",
        z="SELECT condition, cluster, time, (value-avg(value) OVER w)/nullif(stddev_pop(value) OVER w,0) AS z FROM prof_g WINDOW w AS (PARTITION BY condition, cluster)",
    ),
)
def best_expr_class_profile(t):
    """Distinct brands per condition and class with a strong positive or negative module correlation."""
    scored = pair_corr(t.mean_l(), supplier_profiles(t), TIMES, min_abs=0.5, by=BY)
    signed = scored.withColumn("sign", F.when(F.col("value") > 0, "positive").otherwise("negative"))
    named = signed.join(l_classes(t).select(F.col("entity").alias("a"), "class"), "a")
    return named.groupBy(*BY, "class", F.col("b").alias("module"), "sign").agg(F.count_distinct("a").alias("n"))


DEGREE2 = with_(
    "expr_g",
    """SELECT entity, condition, n, round(1-rss/syy,5) AS r2 FROM (SELECT *, syy-b1*s1-b2*s2 AS rss FROM (SELECT *, (s1*v22-s2*v12)/(v11*v22-v12*v12) AS b1,
       (s2*v11-s1*v12)/(v11*v22-v12*v12) AS b2 FROM m))""",
    m="""SELECT entity, condition, count(*) AS n, var_pop(time) AS v11, var_pop(time*time) AS v22, covar_pop(time,time*time) AS v12, covar_pop(time,value) AS s1,
         covar_pop(time*time,value) AS s2, var_pop(value) AS syy FROM expr_g GROUP BY 1,2""",
)


@query("polynomial_trend", DEGREE2)
def polynomial_trend(t):
    """Fit of a second-degree trend per series."""
    return rounded(M.polynomial_trend(t.expr_g, 2).select("entity", "condition", "n", "r2"), "r2", digits=5)


@query(
    "trend_by_condition",
    with_(
        "expr_g",
        f"SELECT entity, n, round(r2,5) AS r2, round(f,5) AS f, round({f_tail_sql('f', '5', '(n-6)')},5) AS pvalue FROM st",
        # With an own level and slope per condition the residuals are those of separate lines.
        pc="SELECT entity, condition, regr_syy(value,time)-pow(regr_sxy(value,time),2)/regr_sxx(value,time) AS rss FROM expr_g GROUP BY 1,2",
        al="SELECT entity, count(*) AS n, var_pop(value)*count(*) AS tss FROM expr_g GROUP BY 1",
        st="""SELECT entity, n, 1-rss/tss AS r2, ((tss-rss)/5)/(rss/(n-6)) AS f FROM al JOIN (SELECT entity, sum(rss) AS rss FROM pc GROUP BY 1) USING (entity)""",
    ),
)
def trend_by_condition(t):
    out = M.trend_by_condition(t.expr_g, CONDITIONS, "A").select("entity", "n", "r2", "f", "pvalue")
    return rounded(out, "r2", "f", "pvalue", digits=5)


SEVEN = range(1, 8)


@query(
    "hotelling_f",
    with_(
        "expr_g",
        """SELECT k.entity AS entity, k.c1 AS first, k.c2 AS second, k.n AS n_reps, round(t2,5) AS t2, round(f,5) AS f,
            round(p,5) AS pvalue, round(least(1.0::DOUBLE, p*count(*) OVER (PARTITION BY k.c1, k.c2)),4) AS padj FROM ft""",
        dd0="""SELECT x.entity, x.condition AS c1, y.condition AS c2, x.replicate, x.time+1 AS t, x.value-y.value AS d, count(*) OVER (PARTITION BY x.entity, x.condition, y.condition, x.replicate) AS m
               FROM expr_g x JOIN expr_g y ON x.entity=y.entity AND x.time=y.time AND x.replicate=y.replicate AND x.condition<y.condition""",
        dd="SELECT * FROM dd0 WHERE m=7",
        mn="SELECT entity, c1, c2, t, avg(d) AS d, count(*) AS n FROM dd GROUP BY ALL",
        cv="SELECT x.entity, x.c1, x.c2, x.t AS i, y.t AS j, coalesce(covar_samp(x.d,y.d),0)+max((x.t=y.t)::INT) AS s FROM dd x JOIN dd y ON x.entity=y.entity AND x.c1=y.c1 AND x.c2=y.c2 AND x.replicate=y.replicate AND x.t<=y.t GROUP BY ALL",
        ms="SELECT entity, c1, c2, " + ", ".join(f"max(CASE WHEN i={i} AND j={j} THEN s END) AS s{i}_{j}" for i in SEVEN for j in SEVEN if i <= j) + " FROM cv GROUP BY ALL",
        md="SELECT entity, c1, c2, max(n) AS n, " + ", ".join(f"max(CASE WHEN t={i} THEN d END) AS d{i}" for i in SEVEN) + " FROM mn GROUP BY ALL",
        mt="SELECT {'entity': entity, 'c1': c1, 'c2': c2, 'n': n} AS k, * FROM ms JOIN md USING (entity, c1, c2)",
        **quadratic_ctes("mt", 7),
        fs="SELECT k, k.n*q AS t2, (2.0::DOUBLE*k.n*7-8)/((2.0::DOUBLE*k.n*7-2)*7)*k.n*q AS f, 2.0::DOUBLE*k.n*7-8 AS df2 FROM qf",
        ft=f"SELECT *, {f_tail_sql('f', '7', 'df2')} AS p FROM fs",
    ),
)
def hotelling_f(t):
    """Paired time courses, Bonferroni over the entities of a pair of conditions."""
    tested = p_adjust(M.hotelling(t.expr_g, TIMES, CONDITIONS), "pvalue", "bonferroni", "padj", ["first", "second"])
    return rounded(rounded(tested, "t2", "f", "pvalue", digits=5), "padj", digits=4)


@query("module_pc1")
def module_pc1(t):
    return rounded(M.module_pc1(t.mean_g(), g_clusters(t), TIMES, BY), "score", "var_explained", digits=5)


@query("sample_pca")
def sample_pca(t):
    logged = normalised(t).withColumn("value", F.ln(F.col("value") + 1) / F.ln(F.lit(2.0)))
    samples = [f"{c}.{x}" for c in CONDITIONS for x in TIMES]
    return rounded(M.sample_pca(logged, samples), "score", "var_explained", digits=5)


