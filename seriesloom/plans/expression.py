"""Replicated time series: labels, summaries, filters and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import expression as X
from seriesloom.operators.statistics import de_contrast
from seriesloom.plans.bindings import BY, CONDITIONS, TIMES, YEAR, G, Tables, g_clusters, rounded, with_
from seriesloom.plans.registry import query
from seriesloom.plans.sqltext import bh_sql, sf_sql
from seriesloom.session import materialize

LABEL = "concat_ws('.', l_returnflag, CAST(year(l_shipdate)-1995 AS VARCHAR), 'R'||CAST(l_linenumber AS VARCHAR))"


def sample_labels(t: Tables):
    return t.lineitem.select(
        F.concat_ws(
            ".",
            "l_returnflag",
            (F.year("l_shipdate") - 1995).cast("string"),
            F.concat(F.lit("R"), F.col("l_linenumber").cast("string")),
        ).alias("sample"),
        "l_quantity",
    )


@query(
    "split_sample_label",
    f"""SELECT s AS sample, split_part(s,'.',1) AS condition, CAST(split_part(s,'.',2) AS INTEGER) AS time,
        split_part(s,'.',3) AS replicate, n FROM (SELECT {LABEL} AS s, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def split_sample_label(t):
    return X.split_sample_label(sample_labels(t).groupBy("sample").agg(F.count(F.lit(1)).alias("n")))


@query(
    "design_dummies",
    f"""SELECT DISTINCT {LABEL} AS sample, CAST(year(l_shipdate)-1995 AS INTEGER) AS time, 'R'||CAST(l_linenumber AS VARCHAR) AS replicate,
        CAST(l_returnflag='N' AS INTEGER) AS "is_N", CAST(l_returnflag='A' AS INTEGER) AS "is_A", CAST(l_returnflag='R' AS INTEGER) AS "is_R" FROM lineitem""",
)
def design_dummies(t):
    return X.design_dummies(sample_labels(t), CONDITIONS, "N")


PIVOT = ", ".join(f"round(max(CASE WHEN time={i} THEN value END),6) AS t{i}" for i in TIMES)


@query("replicate_mean", with_("mean_g", f"SELECT entity, condition, {PIVOT} FROM mean_g GROUP BY 1,2"))
def replicate_mean(t):
    return rounded(X.wide_by_time(t.mean_g(), TIMES), *[f"t{i}" for i in TIMES])


@query(
    "summary_se",
    with_(
        "expr_g",
        """SELECT entity, condition, time, n, round(mean,6) AS mean, round(sd,6) AS sd, round(sd/sqrt(n),6) AS se,
             round(sd/sqrt(n)*[12.706205,4.302653,3.182446,2.776445,2.570582,2.446912][n-1],6) AS ci FROM s""",
        s="SELECT entity, condition, time, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM expr_g GROUP BY 1,2,3",
    ),
)
def summary_se(t):
    return rounded(X.summary_se(t.expr_g, ["entity", "condition", "time"]), "mean", "sd", "se", "ci")


@query(
    "low_signal_filter",
    with_(
        "mean_g",
        "SELECT entity, condition, sum(CASE WHEN value<25.5 THEN 1 ELSE 0 END)::BIGINT AS n_low FROM mean_g GROUP BY 1,2 HAVING n_low<4",
    ),
)
def low_signal_filter(t):
    return X.low_signal_filter(t.mean_g(), 25.5, 4)


@query("min_mean_filter", with_("expr_g", "SELECT entity, round(avg(value),6) AS mean FROM expr_g GROUP BY 1 HAVING avg(value)>25.5"))
def min_mean_filter(t):
    return rounded(X.min_mean_filter(t.expr_g, 25.5), "mean")


@query("min_sum_filter", with_("counts", "SELECT entity, sum(count) AS total FROM counts GROUP BY 1 HAVING sum(count)>15000"))
def min_sum_filter(t):
    return X.min_sum_filter(t.counts, 15000.0)


@query(
    "peak_filter",
    with_("mean_g", "SELECT entity, condition, round(max(value),6) AS peak FROM mean_g WHERE time BETWEEN 1 AND 7 GROUP BY 1,2 HAVING max(value)>30"),
)
def peak_filter(t):
    return rounded(X.peak_filter(t.mean_g(), 30.0), "peak")


RATIO = "SELECT *, value/nullif(lag(value) OVER (PARTITION BY entity,condition ORDER BY time),0) AS ratio FROM mean_g"


@query("step_ratio", with_("mean_g", "SELECT entity, condition, time, round(ratio,6) AS ratio FROM r", r=RATIO))
def step_ratio(t):
    return rounded(X.step_ratio(t.mean_g()).drop("value"), "ratio")


@query(
    "net_change_filter",
    with_(
        "mean_g",
        """SELECT r.entity, r.condition, r.time, round(r.value,6) AS value FROM r JOIN
           (SELECT entity, condition FROM r WHERE time BETWEEN 1 AND 6 GROUP BY 1,2 HAVING avg(ratio)>=1) k USING (entity, condition)""",
        r=RATIO,
    ),
)
def net_change_filter(t):
    """Series of the suppliers that rise on average."""
    means = t.mean_g()
    kept = X.net_change_filter(means, "up")
    return rounded(X.keep_entities(means, kept, ["entity", "condition"]).select("entity", "condition", "time", "value"), "value")


@query(
    "first_difference",
    with_(
        "mean_g",
        """SELECT entity, condition, time, round(d,6) AS diff FROM (SELECT *, lead(value) OVER (PARTITION BY entity,condition ORDER BY time)-value AS d
           FROM mean_g) WHERE d IS NOT NULL""",
    ),
)
def first_difference(t):
    return rounded(X.first_difference(t.mean_g()).drop("value"), "diff")


DE_CTES = dict(
    expr_x=f"""SELECT {G} AS entity, CASE WHEN l_suppkey%4=3 THEN l_returnflag ELSE ['A','N','R'][CAST((CASE WHEN l_quantity<=17 THEN 0
        WHEN l_quantity<=34 THEN 1 ELSE 2 END+l_suppkey)%3 AS INTEGER)+1] END AS condition, {YEAR} AS time, l_linenumber AS replicate,
        avg(l_quantity) AS value FROM lineitem GROUP BY 1,2,3,4""",
    de0="""SELECT entity, avg(value) FILTER (condition='A') AS m1, avg(value) FILTER (condition='N') AS m2,
        var_samp(value) FILTER (condition='A') AS v1, var_samp(value) FILTER (condition='N') AS v2,
        count(*) FILTER (condition='A') AS n1, count(*) FILTER (condition='N') AS n2 FROM expr_x GROUP BY 1""",
    de1="SELECT entity, log2(m1/m2) AS log2fc, abs((m1-m2)/nullif(sqrt(v1/n1+v2/n2),0)) AS z FROM de0",
    de2=f"SELECT entity, log2fc, least(1.0::DOUBLE, 2*{sf_sql('z')}) AS pvalue FROM de1",
    de=bh_sql("de2"),
)


def de_table(t: Tables):
    return de_contrast(t.effects, "A", "N")


@query(
    "de_contrast",
    with_("expr_g", "SELECT entity, round(log2fc,6) AS log2fc, round(pvalue,6) AS pvalue, round(padj,6) AS padj FROM de", **DE_CTES),
)
def de_contrast_query(t):
    return rounded(de_table(t), "log2fc", "pvalue", "padj")


@query(
    "classify_direction",
    with_(
        "expr_g",
        """SELECT entity, round(log2fc,6) AS log2fc, CASE WHEN coalesce(padj,1)<=0.05 AND log2fc>0 THEN 'Up'
           WHEN coalesce(padj,1)<=0.05 AND log2fc<0 THEN 'Down' ELSE 'NoChange' END AS direction FROM de""",
        **DE_CTES,
    ),
)
def classify_direction(t):
    return rounded(X.classify_direction(de_table(t)).select("entity", "log2fc", "direction"), "log2fc")


@query("significant_count", with_("expr_g", "SELECT count(*) FILTER (padj<0.05) AS n_05, count(*) FILTER (padj<0.01) AS n_01 FROM de", **DE_CTES))
def significant_count(t):
    return de_table(t).agg(F.count_if(F.col("padj") < 0.05).alias("n_05"), F.count_if(F.col("padj") < 0.01).alias("n_01"))


@query(
    "zero_time_backfill",
    with_(
        "mean_g",
        """SELECT entity, condition, time, round(value,6) AS value FROM mean_g WHERE NOT (condition IN ('N','R') AND time=0)
           UNION ALL SELECT entity, c, time, round(value,6) FROM mean_g, (VALUES ('N'),('R')) v(c) WHERE condition='A' AND time=0""",
    ),
)
def zero_time_backfill(t):
    return rounded(X.zero_time_backfill(t.mean_g(), "A", ["N", "R"]), "value")


FACTORS = dict(
    ns="SELECT count(DISTINCT sample) AS k FROM counts",
    geo="SELECT entity, avg(ln(count)) AS lm FROM counts WHERE count>0 GROUP BY 1 HAVING count(*)=(SELECT k FROM ns)",
    fac="SELECT sample, median(count/exp(lm)) AS factor FROM counts JOIN geo USING (entity) GROUP BY 1",
    norm="SELECT entity, sample, count/factor AS value FROM counts JOIN fac USING (sample)",
)


@query("size_factors", with_("counts", "SELECT sample, round(factor,6) AS factor FROM fac", **FACTORS))
def size_factors(t):
    return rounded(X.size_factors(materialize(t.counts)), "factor")


def normalised(t: Tables):
    counts = materialize(t.counts)
    return X.normalise_counts(counts, X.size_factors(counts)).select("entity", "sample", "value")


@query("size_factor_normalise", with_("counts", "SELECT entity, sample, round(value,6) AS value FROM norm", **FACTORS))
def size_factor_normalise(t):
    return rounded(normalised(t), "value")


@query(
    "variance_stabilise",
    with_(
        "counts",
        """SELECT entity, sample, round(log2((1+a1+2*a0*value+2*sqrt(a0*value*(1+a1+a0*value)))/(4*a0)),5) AS vst FROM norm, co""",
        **FACTORS,
        mo="SELECT avg(value) AS mu, var_samp(value) AS v FROM norm GROUP BY entity",
        di="SELECT mu, (v-mu)/(mu*mu) AS disp FROM mo WHERE mu>0 AND v IS NOT NULL",
        co="SELECT greatest(regr_intercept(disp,1/mu),1e-8) AS a0, greatest(regr_slope(disp,1/mu),0.0) AS a1 FROM di WHERE disp>0",
    ),
)
def variance_stabilise(t):
    return rounded(X.variance_stabilise(normalised(t)).drop("value"), "vst", digits=5)


@query(
    "module_mean_profile",
    with_("prof_g", "SELECT condition, cluster, time, round(value,6) AS value FROM prof_g"),
)
def module_mean_profile(t):
    return rounded(X.module_mean_profile(t.mean_g(), g_clusters(t), BY), "value")


@query(
    "describe_replicates",
    with_(
        "expr_g",
        """SELECT condition, replicate, count(*) AS n, round(min(value),6) AS "min", round(quantile_cont(value,0.25),6) AS q25,
           round(median(value),6) AS median, round(quantile_cont(value,0.75),6) AS q75, round(max(value),6) AS "max" FROM expr_g GROUP BY 1,2""",
    ),
)
def describe_replicates(t):
    return rounded(X.describe_groups(t.expr_g, ["condition", "replicate"]), "min", "q25", "median", "q75", "max")


@query(
    "histogram_bins",
    """WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1,2),
       w AS (SELECT greatest(CAST(floor(max(n)/(count(*)/5.0)) AS BIGINT),1) AS w FROM s)
       SELECT n//w*w AS bin, count(*) AS n FROM s, w GROUP BY 1""",
)
def histogram_bins(t):
    counts = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n_sites"))
    return X.histogram_bins(counts, "n_sites")


@query("kind_filter", with_("expr_g expr_l", "SELECT DISTINCT entity FROM (SELECT entity FROM expr_g UNION ALL SELECT entity FROM expr_l) WHERE entity LIKE 'L\\_%' ESCAPE '\\'"))
def kind_filter(t):
    both = t.expr_g.select("entity").union(t.expr_l.select("entity"))
    return both.filter(X.kind_of(F.col("entity")) == "L").distinct()


@query(
    "derive_density",
    "SELECT l_suppkey, count(*) AS n_sites, round(count(*)/nullif(sum(l_quantity),0)*1000,6) AS density FROM lineitem GROUP BY 1",
)
def derive_density(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("l_quantity").alias("length"))
    return rounded(per.withColumn("density", X.derive_density(F.col("n_sites"), F.col("length"))).drop("length"), "density")


@query(
    "rank_density",
    """SELECT l_suppkey AS id, round(count(*)/sum(l_quantity)*1000,6) AS density FROM lineitem
       GROUP BY 1 HAVING count(*)>0 ORDER BY density DESC, id""",
)
def rank_density(t):
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("length")
    )
    ranked = per.filter("n > 0").withColumn("density", X.derive_density(F.col("n"), F.col("length")))
    return rounded(ranked.select("id", "density"), "density").orderBy(F.desc("density"), "id")


