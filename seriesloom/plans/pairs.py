"""Pair similarity, partner selection and pair filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.vectors import shifted_dot
from seriesloom.operators import pairs as P
from seriesloom.operators import warping as W
from seriesloom.operators.expression import module_mean_profile
from seriesloom.operators.intervals import nearest_join
from seriesloom.operators.statistics import unordered_pairs
from seriesloom.plans.bindings import (
    BY,
    CONDITIONS,
    TIMES,
    Tables,
    g_clusters,
    g_id,
    g_places,
    l_classes,
    l_clusters,
    l_id,
    l_places,
    rounded,
    with_,
)
from seriesloom.plans.registry import query
from seriesloom.plans.sqltext import dtw_ctes, quantile_sql
from seriesloom.session import materialize


def brand_supplier_pairs(t: Tables, **kw):
    """Brand x supplier scores under every condition, a = brand."""
    return P.pair_corr(t.mean_l(), t.mean_g(), TIMES, by=BY, **kw)


def brand_profiles(t: Tables):
    return module_mean_profile(t.mean_l(), l_clusters(t), BY).withColumnRenamed("cluster", "entity")


def supplier_profiles(t: Tables):
    return module_mean_profile(t.mean_g(), g_clusters(t), BY).withColumnRenamed("cluster", "entity")


@query("xcorr_lag0", with_("pairs", "SELECT condition, l_id AS a, g_id AS b, round(value,6) AS value FROM pairs"))
def xcorr_lag0(t):
    return rounded(brand_supplier_pairs(t).drop("lag"), "value")


@query(
    "xcorr_lag_k",
    with_(
        "z_g z_l",
        """SELECT l.condition, l.entity AS a, g.entity AS b, l.time-g.time AS lag, round(sum(l.z*g.z)/7,6) AS value
           FROM z_l l JOIN z_g g ON l.condition=g.condition AND l.time-g.time BETWEEN -2 AND 2 WHERE l.n=7 AND g.n=7 AND l.z IS NOT NULL AND g.z IS NOT NULL
           GROUP BY 1,2,3,4""",
    ),
)
def xcorr_lag_k(t):
    return rounded(brand_supplier_pairs(t, lags=[-2, -1, 0, 1, 2]), "value")


TEMPORAL_SQL = """SELECT l.condition, l.entity AS a, g.entity AS b,
  round(coalesce(sum(l.d*g.d)/nullif(sqrt(sum(l.d*l.d))*sqrt(sum(g.d*g.d)),0),0),6) AS value
  FROM d_l l JOIN d_g g ON l.time=g.time AND l.condition=g.condition GROUP BY 1,2,3"""


@query("temporal_corr", with_("d_g d_l", TEMPORAL_SQL))
def temporal_corr(t):
    return rounded(brand_supplier_pairs(t, method="temporal").drop("lag"), "value")


@query(
    "pearson_pairs",
    with_(
        "mean_g mean_l",
        """SELECT l.condition, l.entity AS a, g.entity AS b, round(corr(l.value,g.value),6) AS value
           FROM mean_l l JOIN mean_g g ON l.time=g.time AND l.condition=g.condition
           GROUP BY 1,2,3 HAVING count(*)=7""",
    ),
)
def pearson_pairs(t):
    return rounded(brand_supplier_pairs(t).drop("lag"), "value")


@query(
    "xcorr_all_pairs",
    with_("z_l", """SELECT x.condition, x.entity AS a, y.entity AS b, round(sum(x.z*y.z)/7,6) AS value
                    FROM z_l x JOIN z_l y ON x.time=y.time AND x.condition=y.condition WHERE x.n=7 AND y.n=7 GROUP BY 1,2,3"""),
)
def xcorr_all_pairs(t):
    return rounded(P.mirror(P.pair_corr(t.mean_l(), None, TIMES, by=BY)).drop("lag"), "value")


@query(
    "xcorr_entity_sets",
    with_(
        "pairs",
        """SELECT c.condition, l.a, g.b, coalesce(round(p.value,6),0.0) AS value FROM (SELECT DISTINCT condition FROM mean_l) c, ll l, gl g
           LEFT JOIN pairs p ON p.l_id=l.a AND p.g_id=g.b AND p.condition=c.condition""",
        gl="SELECT 'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0') AS b FROM supplier WHERE s_acctbal>5000",
        ll="SELECT DISTINCT 'L_'||p_brand AS a FROM part UNION SELECT DISTINCT 'L_'||p_type FROM part",
    ),
)
def xcorr_entity_sets(t):
    """Chosen suppliers against listed brands; listed names without a series score 0."""
    chosen = t.table("supplier").filter("s_acctbal > 5000").select(g_id("s_suppkey").alias("entity"))
    listed = t.part.select(l_id("p_brand").alias("entity")).union(t.part.select(l_id("p_type").alias("entity"))).distinct()
    left, right = t.mean_l().join(listed, "entity", "left_semi"), t.mean_g().join(chosen, "entity", "left_semi")
    # Listed names join with their series, or none, before they meet, so the product is laid out once.
    known = F.explode(F.array(*map(F.lit, CONDITIONS))).alias("condition")
    sides = [
        names.select("entity", known).join(P.scored_series(df, TIMES, by=BY)[0], [*BY, "entity"], "left")
        for names, df in ((listed, left), (chosen, right))
    ]
    met = P.block_pairs(*sides, "entity", by=BY)
    value = F.coalesce(shifted_dot("a_u", "b_u", len(TIMES)), F.lit(0.0))
    return rounded(met.select(*BY, F.col("a_entity").alias("a"), F.col("b_entity").alias("b"), value.alias("value")), "value")


@query(
    "xcorr_module_profiles",
    with_("cpairs", "SELECT condition, set1 AS a, set2 AS b, round(value,6) AS value FROM cpairs"),
)
def xcorr_module_profiles(t):
    return rounded(P.pair_corr(brand_profiles(t), supplier_profiles(t), TIMES, by=BY).drop("lag"), "value")


@query(
    "xcorr_entity_modules",
    with_(
        "prof_l mean_g",
        """SELECT l.condition, l.cluster AS a, g.entity AS b,
             round(coalesce(sum(l.d*g.d)/nullif(sqrt(sum(l.d*l.d))*sqrt(sum(g.d*g.d)),0),0),6) AS value
           FROM pl l JOIN pg g ON l.time=g.time AND l.condition=g.condition GROUP BY 1,2,3 HAVING count(*)=6""",
        pl="SELECT * FROM (SELECT condition, cluster, time, lead(value) OVER (PARTITION BY condition, cluster ORDER BY time)-value AS d FROM prof_l) WHERE d IS NOT NULL",
        pg="SELECT * FROM (SELECT condition, entity, time, lead(value) OVER (PARTITION BY condition, entity ORDER BY time)-value AS d FROM mean_g) WHERE d IS NOT NULL",
    ),
)
def xcorr_entity_modules(t):
    """Temporal correlation of module profiles with single suppliers."""
    return rounded(P.pair_corr(brand_profiles(t), t.mean_g(), TIMES, "temporal", by=BY).drop("lag"), "value")


def gated(t):
    cluster_pairs = P.filter_pairs(
        P.pair_corr(brand_profiles(t), supplier_profiles(t), TIMES, by=BY).select(
            *BY, F.col("a").alias("set1"), F.col("b").alias("set2"), "value"
        ),
        0.5,
    )
    return P.cluster_gated_pairs(cluster_pairs, l_clusters(t), g_clusters(t))


GATED_SQL = """SELECT c.condition, ml.entity AS a, mg.entity AS b, c.set1 AS a_cluster, c.set2 AS b_cluster FROM cpairs c
  JOIN clu_l ml ON ml.cluster=c.set1 JOIN clu_g mg ON mg.cluster=c.set2 WHERE c.value>=0.5"""


@query("cluster_gated_product", with_("cpairs clu_l clu_g", GATED_SQL))
def cluster_gated_product(t):
    return gated(t)


@query(
    "xcorr_within_gated_clusters",
    with_(
        "cpairs clu_l clu_g pairs",
        """SELECT g.condition, g.a, g.b, g.a_cluster, g.b_cluster, round(p.value,6) AS value
           FROM gp g JOIN pairs p ON p.l_id=g.a AND p.g_id=g.b AND p.condition=g.condition""",
        gp=GATED_SQL,
    ),
)
def xcorr_within_gated_clusters(t):
    return rounded(brand_supplier_pairs(t, pairs=gated(t)).drop("lag"), "value")


NEAREST_SQL = """SELECT id, closest_id, distance FROM (SELECT l.id, g.id AS closest_id,
   greatest(l.start-g."end", g.start-l."end", 0) AS distance, row_number() OVER (PARTITION BY l.id ORDER BY
     greatest(l.start-g."end", g.start-l."end", 0), CASE WHEN g.start<l."end" THEN 0 ELSE 1 END,
     CASE WHEN g.start<l."end" THEN -g."end" ELSE g.start END, g.id DESC) AS rn
   FROM place_l l JOIN place_g g ON l.seq=g.seq) WHERE rn=1"""


@query(
    "xcorr_nearest_pairs",
    with_(
        "place_l place_g pairs",
        "SELECT p.condition, n.id AS a, n.closest_id AS b, round(p.value,6) AS value FROM near n JOIN pairs p ON p.l_id=n.id AND p.g_id=n.closest_id",
        near=NEAREST_SQL,
    ),
)
def xcorr_nearest_pairs(t):
    near = nearest_join(l_places(t), g_places(t)).select(F.col("id").alias("a"), F.col("closest_id").alias("b"))
    return rounded(brand_supplier_pairs(t, pairs=near).drop("lag"), "value")


SEED = 42


def random_pairs(t):
    means = t.mean_l().groupBy(*BY, "entity").agg(F.avg("value").alias("mean"))
    pool = means.join(l_classes(t), "entity")
    targets = pool.filter("class = 'antisense'").select(*BY, "entity", "mean", "length")
    eligible = pool.filter("class = 'intergenic' AND exon_status = 'm'").select(*BY, "entity", "mean", "length")
    others = t.mean_g().select(*BY, "entity").distinct()
    return P.random_matched_pairs(targets, eligible, others, SEED, by=BY)


RANDOM_SQL = dict(
    m="SELECT condition, entity, avg(value) AS mean FROM mean_l GROUP BY 1,2",
    pool="SELECT m.condition, m.entity, m.mean, c.length, c.class, c.exon_status FROM m JOIN class_l c USING(entity)",
    matched="""SELECT DISTINCT e.condition, e.entity FROM pool e JOIN pool t ON t.condition=e.condition AND t.class='antisense' AND t.entity<>e.entity
        AND abs(t.mean-e.mean)<=1.0 AND abs(t.length-e.length)<=1000 WHERE e.class='intergenic' AND e.exon_status='m'""",
    ra=f"SELECT condition, entity AS a, row_number() OVER (PARTITION BY condition ORDER BY substr(md5(entity||'|pool|{SEED}'),1,12), entity) AS rn FROM matched",
    rb=f"""SELECT condition, entity AS b, row_number() OVER (PARTITION BY condition ORDER BY substr(md5(entity||'|other|{SEED}'),1,12), entity) AS rn,
        count(*) OVER (PARTITION BY condition) AS n FROM (SELECT DISTINCT condition, entity FROM mean_g)""",
    rp="SELECT ra.condition, ra.a, rb.b FROM ra JOIN rb ON rb.condition=ra.condition AND rb.rn=(ra.rn-1)%rb.n+1",
)


@query(
    "xcorr_random_pairs",
    with_(
        "mean_l mean_g class_l pairs",
        "SELECT rp.condition, rp.a, rp.b, round(p.value,6) AS value FROM rp JOIN pairs p ON p.l_id=rp.a AND p.g_id=rp.b AND p.condition=rp.condition",
        **RANDOM_SQL,
    ),
)
def xcorr_random_pairs(t):
    return rounded(brand_supplier_pairs(t, pairs=random_pairs(t)).drop("lag"), "value")


MAX_SQL = """SELECT condition, l_id, g_id, value FROM (SELECT condition, l_id, g_id, value, row_number() OVER (PARTITION BY condition, l_id
   ORDER BY round(value,9) DESC, g_id) AS rn FROM pairs) WHERE rn=1"""


def best_pairs(t):
    return P.best_partner(brand_supplier_pairs(t).drop("lag"), [*BY, "a"], "b")


@query("max_partner", with_("pairs", "SELECT condition, l_id AS a, g_id AS b, round(value,6) AS value FROM best", best=MAX_SQL))
def max_partner(t):
    """Best correlated supplier per condition and brand."""
    return rounded(best_pairs(t), "value")


@query(
    "min_partner",
    with_(
        "pairs class_l",
        """SELECT condition, l_id AS a, g_id AS b, round(value,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY condition, l_id
           ORDER BY round(value,9), g_id) AS rn FROM pairs WHERE l_id IN (SELECT entity FROM class_l WHERE class='intergenic')) WHERE rn=1""",
    ),
)
def min_partner(t):
    """Most negatively correlated supplier per condition and listed brand."""
    listed = l_classes(t).filter("class = 'intergenic'").select(F.col("entity").alias("a"))
    return rounded(P.best_partner(brand_supplier_pairs(t).drop("lag"), [*BY, "a"], "b", "min", restrict=listed), "value")


@query(
    "xcorr_submatrix_labelled",
    with_(
        "pairs z_g",
        """SELECT x.condition, sx.s_name AS a, sy.s_name AS b, round(sum(x.z*y.z)/7,6) AS value FROM z_g x JOIN z_g y ON x.time=y.time AND x.condition=y.condition
           JOIN supplier sx ON x.entity='G'||lpad(CAST(sx.s_suppkey AS VARCHAR),7,'0')
           JOIN supplier sy ON y.entity='G'||lpad(CAST(sy.s_suppkey AS VARCHAR),7,'0')
           WHERE x.n=7 AND y.n=7 AND (x.condition, x.entity) IN (SELECT condition, g_id FROM best) AND (y.condition, y.entity) IN (SELECT condition, g_id FROM best) GROUP BY 1,2,3""",
        best=MAX_SQL,
    ),
)
def xcorr_submatrix_labelled(t):
    """Correlations among the chosen suppliers, shown by name."""
    chosen = best_pairs(t).select(*BY, F.col("b").alias("entity")).distinct()
    scored = P.mirror(P.pair_corr(t.mean_g().join(chosen, [*BY, "entity"], "left_semi"), None, TIMES, by=BY)).drop("lag")
    names = t.table("supplier").select(g_id("s_suppkey").alias("id"), "s_name")
    named = scored.join(names.select(F.col("id").alias("a"), F.col("s_name").alias("an")), "a").join(
        names.select(F.col("id").alias("b"), F.col("s_name").alias("bn")), "b"
    )
    return rounded(named.select(*BY, F.col("an").alias("a"), F.col("bn").alias("b"), "value"), "value")


@query(
    "distance_from_corr",
    with_("pairs", "SELECT condition, l_id AS a, g_id AS b, round(abs(value-1),6) AS distance FROM pairs"),
)
def distance_from_corr(t):
    return rounded(P.distance_from_corr(brand_supplier_pairs(t)).select(*BY, "a", "b", "distance"), "distance")


WARPED = dict(
    sl="SELECT condition, entity, list(value ORDER BY time) AS s FROM mean_l GROUP BY 1,2 HAVING count(*)=7",
    sg="SELECT condition, entity, list(value ORDER BY time) AS s FROM mean_g GROUP BY 1,2 HAVING count(*)=7",
    xy="SELECT l.condition, l.entity AS a, g.entity AS b, l.s AS x, g.s AS y FROM sl l JOIN sg g ON l.condition=g.condition",
    **dtw_ctes("xy", 7, "condition, a, b"),
)


@query("dtw_distance", with_("mean_g mean_l", "SELECT condition, a, b, round(d,6) AS distance FROM dw", **WARPED))
def dtw_distance(t):
    return rounded(P.pair_dtw(t.mean_l(), t.mean_g(), TIMES, by=BY), "distance")


@query(
    "adaptive_dtw",
    with_(
        "mean_g mean_l d_g d_l",
        "SELECT dw.condition, dw.a, dw.b, round(d*2/(1+exp(2*abs(c.value))),6) AS distance FROM dw JOIN ct c ON c.a=dw.a AND c.b=dw.b AND c.condition=dw.condition",
        **WARPED,
        ct=TEMPORAL_SQL.replace("round(", "(").replace(",6) AS value", ") AS value"),
    ),
)
def adaptive_dtw(t):
    return rounded(P.pair_dtw(t.mean_l(), t.mean_g(), TIMES, k=2.0, by=BY), "distance")


#: Vectors read as series of this length, and how far their paths may leave the diagonal.
LONG, BAND = 64, 4
LONG_SQL = dict(
    xy="""SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
          FROM embeddings a JOIN embeddings b ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id<b.vec_id""",
    **dtw_ctes("xy", LONG, "label, a, b", BAND),
)


def long_series(t):
    return t.table("embeddings").select("label", F.col("vec_id").alias("entity"), F.col("embedding").alias("series"))


@query("warped_within", "WITH RECURSIVE " + with_("", "SELECT label, a, b, round(d,6) AS distance FROM dw WHERE d<=6.5", **LONG_SQL).removeprefix("WITH "))
def warped_within(t):
    """Pairs of vectors of one label at warping distance 6.5 or less."""
    return rounded(W.warped_within(long_series(t), None, LONG, 6.5, BAND, ["label"]), "distance")


@query(
    "warped_nearest",
    "WITH RECURSIVE "
    + with_(
        "",
        """SELECT label, a, row_number() OVER (PARTITION BY label, a ORDER BY distance, b) AS rank, b, round(distance,6) AS distance
           FROM both_ways QUALIFY rank<=3""",
        **LONG_SQL,
        both_ways="SELECT label, a, b, round(d,9) AS distance FROM dw UNION ALL SELECT label, b, a, round(d,9) FROM dw",
    ).removeprefix("WITH "),
)
def warped_nearest(t):
    """The three nearest vectors of the same label by warping distance."""
    return rounded(W.warped_nearest(long_series(t), None, LONG, 3, BAND, ["label"]), "distance")


@query(
    "covariance_sum_filter",
    with_(
        "mean_l",
        """SELECT s.condition, entity, round(cov_sum,6) AS cov_sum FROM s JOIN (SELECT condition, quantile_cont(cov_sum,0.5) AS q FROM s GROUP BY 1) c
           ON c.condition=s.condition JOIN (SELECT condition, quantile_cont(v,0.5) AS q FROM e GROUP BY 1) k ON k.condition=s.condition
           WHERE cov_sum>c.q AND cov_sum>k.q""",
        cv="""SELECT x.condition, x.entity, y.entity AS other, abs(covar_samp(x.value,y.value)) AS c FROM mean_l x JOIN mean_l y
              ON x.time=y.time AND x.condition=y.condition GROUP BY 1,2,3""",
        s="SELECT condition, entity, sum(c) AS cov_sum FROM cv GROUP BY 1,2",
        n="SELECT condition, count(*) AS n, avg(cov_sum) AS m, stddev_samp(cov_sum) AS sd FROM s GROUP BY 1",
        pp="""SELECT condition, (i-a)/(n+1-2*a) AS p, m, sd FROM (SELECT s.condition, row_number() OVER (PARTITION BY s.condition ORDER BY cov_sum) AS i, n, m, sd,
              CASE WHEN n<=10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END AS a FROM s JOIN n ON n.condition=s.condition)""",
        e=f"SELECT condition, abs(m+sd*{quantile_sql('p')}) AS v FROM pp",
    ),
)
def covariance_sum_filter(t):
    return rounded(P.covariance_sum_filter(t.mean_l(), TIMES, 3, BY), "cov_sum")


@query(
    "classify_correlated_entities",
    with_(
        "pairs class_l",
        """SELECT condition, l_id AS a, g_id AS b, round(value,6) AS value FROM pairs WHERE value>=0
           AND l_id IN (SELECT entity FROM class_l WHERE class='intergenic' AND exon_status='m')""",
    ),
)
def classify_correlated_entities(t):
    classes = l_classes(t).filter("exon_status = 'm'")
    out = P.classify_correlated(brand_supplier_pairs(t).drop("lag"), classes, "intergenic", "positive", by=BY)
    return rounded(out, "value").select(*BY, "a", "b", "value")


CLASS_CORR = dict(
    cc="""SELECT p.condition, p.l_id AS a, c.cluster, p.value FROM pairs p JOIN clu_g c ON c.entity=p.g_id
          WHERE p.l_id IN (SELECT entity FROM class_l WHERE class='intergenic')"""
)


@query(
    "any_exceeds",
    with_("pairs clu_g class_l", "SELECT condition, cluster, a FROM cc GROUP BY 1,2,3 HAVING bool_or(value>0.8)", **CLASS_CORR),
)
def any_exceeds(t):
    return class_corr(t).select(*BY, "cluster", "a")


def class_corr(t):
    """Per condition and supplier cluster the brands of a class with some correlation above 0.8."""
    listed = l_classes(t).filter("class = 'intergenic'").select("entity")
    left = t.mean_l().join(listed, "entity", "left_semi")
    scored = P.pair_corr(left, t.mean_g(), TIMES, min_value=0.8, by=BY).drop("lag")
    by_cluster = scored.join(g_clusters(t).withColumnRenamed("entity", "b"), "b")
    return P.any_exceeds(by_cluster, [*BY, "cluster", "a"], 0.8, "positive")


@query(
    "class_corr_per_cluster",
    with_(
        "pairs clu_g class_l",
        """SELECT p.condition, c.cluster, p.l_id AS a, p.g_id AS b, round(p.value,6) AS value FROM pairs p JOIN clu_g c ON c.entity=p.g_id
           JOIN (SELECT condition, cluster, a FROM cc GROUP BY 1,2,3 HAVING bool_or(value>0.8)) k ON k.cluster=c.cluster AND k.a=p.l_id AND k.condition=p.condition""",
        **CLASS_CORR,
    ),
)
def class_corr_per_cluster(t):
    """Correlation rows of the kept brands with all members of the cluster."""
    kept = class_corr(t)
    listed = kept.join(g_clusters(t).select("cluster", F.col("entity").alias("b")), "cluster")
    return rounded(brand_supplier_pairs(t, pairs=listed).drop("lag"), "value")


@query(
    "unordered_pairs",
    "SELECT a.c AS first, b.c AS second FROM (SELECT DISTINCT l_returnflag c FROM lineitem) a JOIN (SELECT DISTINCT l_returnflag c FROM lineitem) b ON a.c<=b.c",
)
def unordered_pairs_of_conditions(t):
    return unordered_pairs(t.lineitem.select(F.col("l_returnflag").alias("c")), "c", with_self=True)


@query(
    "flatten_matrix",
    with_("mean_g", "SELECT entity AS \"left\", 't'||CAST(time AS VARCHAR) AS \"right\", round(value,6) AS value, condition FROM mean_g WHERE value>=25"),
)
def flatten_matrix(t):
    from seriesloom.operators.expression import wide_by_time

    wide = wide_by_time(t.mean_g(), TIMES)
    return rounded(P.flatten_matrix(wide, "entity", [f"t{x}" for x in TIMES], 25.0, BY), "value")


PAIR_SELECT = "SELECT condition, l_id AS a, g_id AS b, round(value,6) AS value FROM pairs WHERE "


@query("filter_pairs", with_("pairs", PAIR_SELECT + "value<=-0.6"))
def filter_pairs(t):
    return rounded(brand_supplier_pairs(t, min_value=-0.6).drop("lag"), "value")


@query(
    "filter_abs_threshold",
    with_(
        "prof_l z_g",
        "PIVOT (SELECT condition, entity, cluster, v FROM c WHERE abs(v)>=0.7) ON cluster USING coalesce(max(v),0.0) GROUP BY condition, entity",
        z="SELECT condition, cluster, time, (value-avg(value) OVER w)/nullif(stddev_pop(value) OVER w,0) AS z FROM prof_l WINDOW w AS (PARTITION BY condition, cluster)",
        c="""SELECT g.condition, g.entity, z.cluster, round(sum(g.z*z.z)/7,6) AS v FROM z_g g JOIN z ON g.time=z.time AND g.condition=z.condition
             WHERE g.n=7 GROUP BY 1,2,3""",
    ),
)
def filter_abs_threshold(t):
    """Supplier x module correlations of at least 0.7 either way, widened with 0 elsewhere; a column for every module that has one."""
    scored = P.pair_corr(brand_profiles(t), t.mean_g(), TIMES, min_abs=0.699, by=BY).drop("lag")
    kept = materialize(P.filter_pairs(rounded(scored, "value"), 0.7, "abs"))
    return kept.groupBy(*BY, F.col("b").alias("entity")).pivot("a").agg(F.max("value")).na.fill(0.0)


@query("filter_abs_then_pos", with_("pairs", PAIR_SELECT + "value>=0.7"))
def filter_abs_then_pos(t):
    return rounded(P.filter_pairs(brand_supplier_pairs(t, min_value=0.7).drop("lag"), 0.7, "pos"), "value")


@query(
    "drop_nonfinite",
    """SELECT event_id AS id, round(v,6) AS value FROM (SELECT event_id, CASE WHEN event_type='error' THEN NULL
       WHEN value<1 THEN 'NaN'::DOUBLE WHEN value>400 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events)
       WHERE v IS NOT NULL AND isfinite(v)""",
)
def drop_nonfinite(t):
    """Events where errors have no value, tiny ones are NaN and large ones infinite."""
    v = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("value") < 1, F.lit(float("nan")))
        .when(F.col("value") > 400, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    return rounded(P.drop_nonfinite(t.table("events").select(F.col("event_id").alias("id"), v.alias("value"))), "value")


@query("sign_filter_pairs", with_("pairs", PAIR_SELECT + "value<=0"))
def sign_filter_pairs(t):
    return rounded(P.sign_filter_pairs(brand_supplier_pairs(t).drop("lag"), "negative"), "value")


@query("orient_pairs", with_("pairs", "SELECT condition, g_id AS gene_id, l_id AS lnc_id, round(value,6) AS value FROM pairs WHERE value>=0.5"))
def orient_pairs(t):
    return rounded(P.orient_pairs(brand_supplier_pairs(t, min_value=0.5).drop("lag"), "a", "b"), "value")


@query("partners_per_entity", with_("pairs", "SELECT condition, g_id AS b, count(DISTINCT l_id) AS n_partners FROM pairs WHERE value>=0.5 GROUP BY 1,2"))
def partners_per_entity(t):
    return P.partners_per_entity(brand_supplier_pairs(t, min_value=0.5), [*BY, "b"], "a")


@query(
    "partners_per_entity_class",
    with_(
        "pairs class_l",
        """SELECT condition, l_id AS a, count(DISTINCT g_id) AS n_partners, min(class) AS class FROM pairs JOIN class_l ON entity=l_id
           WHERE value>=0.5 GROUP BY 1,2""",
    ),
)
def partners_per_entity_class(t):
    counted = P.partners_per_entity(brand_supplier_pairs(t, min_value=0.5), [*BY, "a"], "b")
    return counted.join(l_classes(t).select(F.col("entity").alias("a"), "class"), "a")


