"""Joins with dimensions, dedupe, sorting and report projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.numeric import round_significant
from seriesloom.operators import annotate as N
from seriesloom.operators import pairs as P
from seriesloom.operators import sets as S
from seriesloom.operators.expression import classify_direction
from seriesloom.operators.intervals import extents, first_per_group, overlap_join
from seriesloom.operators.statistics import de_contrast, linear_trend
from seriesloom.plans.bindings import BY, Tables, g_id, l_places, rounded, with_
from seriesloom.plans.expression import DE_CTES, de_table
from seriesloom.plans.pairs import brand_supplier_pairs
from seriesloom.plans.registry import query
from seriesloom.plans.sqltext import bh_sql, sf_sql, signif_sql
from seriesloom.session import materialize

GID = "'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0')"


def strong_pairs(t: Tables, floor: float = 0.7):
    return brand_supplier_pairs(t, min_value=floor).drop("lag")


def strong_shared(t: Tables):
    """(strong pairs per condition, stored; the tokens that each distinct one of them shares)."""
    listed = materialize(strong_pairs(t))
    return listed, S.shared_tokens(listed, S.token_catalog(t.site_rows_l), S.token_catalog(t.site_rows_g))


STRONG = "SELECT condition, l_id AS a, g_id AS b, value FROM pairs WHERE value>=0.7"


@query(
    "inner_enrich_expr",
    with_(
        "pairs mean_g",
        """SELECT condition, a, b, round(value,6) AS value, shown, time, round(expr,6) AS expr FROM (SELECT s.condition, s.a, s.b, s.value, m.condition AS shown, m.time,
           m.value AS expr, row_number() OVER (PARTITION BY s.condition, s.a, s.b ORDER BY m.condition DESC, m.time DESC) AS rn
           FROM st s JOIN mean_g m ON m.entity=s.b) WHERE rn=1""",
        st=STRONG,
    ),
)
def inner_enrich_expr(t):
    rows = t.mean_g().select(F.col("entity").alias("b"), F.col("condition").alias("shown"), "time", F.col("value").alias("expr"))
    out = N.inner_enrich(strong_pairs(t), rows, "b", [*BY, "a", "b"], [F.desc("shown"), F.desc("time")])
    return rounded(out, "value", "expr")


SHARED_N = """SELECT s.a, s.b, count(y.token) AS n_shared FROM (SELECT DISTINCT a, b FROM st) s JOIN cat_g x ON x.entity=s.b
   LEFT JOIN cat_l y ON y.entity=s.a AND y.token=x.token GROUP BY 1,2"""


@query(
    "multi_key_join_shared",
    with_(
        "pairs cat_g cat_l",
        "SELECT DISTINCT s.condition, s.a, s.b, round(s.value,6) AS value, h.n_shared FROM st s JOIN sh h ON h.a=s.a AND h.b=s.b WHERE h.n_shared>0",
        st=STRONG,
        sh=SHARED_N,
    ),
)
def multi_key_join_shared(t):
    listed, shared = strong_shared(t)
    joined = listed.join(shared.select("a", "b", "n_shared"), ["a", "b"]).filter("n_shared > 0")
    return rounded(joined, "value").dropDuplicates([*BY, "a", "b", "value"])


def rich_symbols(t: Tables):
    """Names of the suppliers with a positive balance; the others have no symbol."""
    return t.table("supplier").filter("s_acctbal > 0").select(g_id("s_suppkey").alias("id"), F.col("s_name").alias("symbol"))


@query(
    "left_annotate",
    with_(
        "pairs place_l",
        f"""SELECT s.condition, s.a, s.b, round(s.value,6) AS value, n.s_name AS symbol, p.seq, p.start, p."end" FROM st s
            LEFT JOIN (SELECT {GID} AS id, s_name FROM supplier WHERE s_acctbal>0) n ON n.id=s.b LEFT JOIN place_l p ON p.id=s.a""",
        st=STRONG,
    ),
)
def left_annotate(t):
    places = extents(l_places(t), "id", ["seq"]).select(F.col("id").alias("a"), "seq", "start", "end")
    named = strong_pairs(t).join(rich_symbols(t).withColumnRenamed("id", "b"), "b", "left")
    return rounded(named.join(places, "a", "left").select(*BY, "a", "b", "value", "symbol", "seq", "start", "end"), "value")


@query(
    "order_columns_annotated",
    with_(
        "pairs place_l",
        f"""SELECT s.condition, s.b AS gene_id, coalesce(n.s_name, s.b) AS gene_symbol, p.seq AS contig, p.start, p."end", s.a AS lnc_id, round(s.value,6) AS correlation
            FROM st s LEFT JOIN (SELECT {GID} AS id, s_name FROM supplier WHERE s_acctbal>0) n ON n.id=s.b LEFT JOIN place_l p ON p.id=s.a ORDER BY condition, gene_id, contig, lnc_id""",
        st=STRONG,
    ),
)
def order_columns_annotated(t):
    """Oriented, annotated and ordered report of a pair list."""
    oriented = P.orient_pairs(strong_pairs(t), "a", "b")
    named = N.symbol_lookup(oriented, rich_symbols(t), "gene_id", "gene_symbol")
    places = l_places(t).select(F.col("id").alias("lnc_id"), F.col("seq").alias("contig"), "start", "end")
    out = named.join(places, "lnc_id", "left").select(
        *BY, "gene_id", "gene_symbol", "contig", "start", "end", "lnc_id", F.col("value").alias("correlation")
    )
    return rounded(out, "correlation").orderBy(*BY, "gene_id", "contig", "lnc_id")


TREND0 = """SELECT entity, condition, count(*) AS n, covar_pop(time,value)/var_pop(time) AS slope,
   pow(covar_pop(time,value),2)/(var_pop(time)*var_pop(value)) AS r2 FROM expr_g GROUP BY 1,2 HAVING count(*)>2"""


@query(
    "right_merge_stats",
    with_(
        "expr_g",
        """SELECT d.entity, f.condition, round(f.slope,6) AS slope, round(f.r2,6) AS r2, round(d.pvalue,6) AS pvalue
           FROM (SELECT entity, condition, slope, r2 FROM tr WHERE r2>=0.01) f RIGHT JOIN de d ON d.entity=f.entity""",
        tr=TREND0,
        **DE_CTES,
    ),
)
def right_merge_stats(t):
    """Coefficients of the better fits of all conditions joined to all p-values."""
    fits = linear_trend(t.expr_g, min_r2=0.01).select("entity", "condition", "slope", "r2")
    return rounded(fits.join(de_table(t).select("entity", "pvalue"), "entity", "right"), "slope", "r2", "pvalue")


@query(
    "semi_list_filter",
    """SELECT event_id AS id, event_type AS feature FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type='purchase' AND value>200)""",
)
def semi_list_filter(t):
    """Events of users with at least one large purchase."""
    listed = t.iv.filter("feature = 'purchase' AND value > 200").select("seq").distinct()
    return t.iv.join(listed, "seq", "left_semi").select("id", "feature")


@query("symbol_lookup", f"SELECT {GID} AS id, CASE WHEN s_acctbal>0 THEN s_name ELSE {GID} END AS symbol FROM supplier")
def symbol_lookup(t):
    return N.symbol_lookup(t.table("supplier").select(g_id("s_suppkey").alias("id")), rich_symbols(t), "id")


@query(
    "positional_zip",
    with_(
        "iv",
        """SELECT CAST(x.id AS VARCHAR) AS a_id, CAST(y.id AS VARCHAR) AS b_id, CAST(x.start AS VARCHAR) AS a_start, CAST(y.start AS VARCHAR) AS b_start FROM
           (SELECT *, row_number() OVER (ORDER BY start,id) AS i FROM iv WHERE feature='click') x FULL JOIN
           (SELECT *, row_number() OVER (ORDER BY start,id) AS i FROM iv WHERE feature='view') y USING (i)""",
    ),
)
def positional_zip(t):
    a, b = (t.features(k).select("start", "id") for k in ("click", "view"))
    zipped = N.positional_zip(a, b, ["start", "id"])
    return zipped.select(*[F.col(c).cast("string") for c in zipped.columns])


CONC = dict(
    DE_CTES,
    e0=DE_CTES["de0"].replace("'N'", "'R'"),
    e1=DE_CTES["de1"].replace("de0", "e0"),
    e2=f"SELECT entity, log2fc, least(1.0::DOUBLE, 2*{sf_sql('z')}) AS pvalue FROM e1",
    e=bh_sql("e2"),
)


@query(
    "concordant_de_join",
    with_(
        "expr_g",
        """SELECT x.entity, round(x.log2fc,6) AS fc_a, round(y.log2fc,6) AS fc_b, round(abs(x.log2fc-y.log2fc),6) AS diff,
           sign(x.log2fc)=sign(y.log2fc) AS concordant FROM de x JOIN e y ON x.entity=y.entity WHERE x.padj<=0.01 AND y.padj<=0.01""",
        **CONC,
    ),
)
def concordant_de_join(t):
    out = N.concordant_de_join(de_table(t), de_contrast(t.effects, "A", "R"), 0.01, "padj")
    return rounded(out, "fc_a", "fc_b", "diff")


@query(
    "transcript_to_gene_map",
    "SELECT o_custkey AS gene_id, count(*) AS n_sites FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1",
)
def transcript_to_gene_map(t):
    """Sites target orders; orders map to customers."""
    mapping = t.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("gene_id"))
    return t.lineitem.join(mapping, "l_orderkey").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_sites"))


@query(
    "tpm_by_interval",
    with_(
        "iv",
        """SELECT x.id AS a_id, y.id AS b_id, e.event_type AS kind, round(e.value,6) AS tpm FROM iv x JOIN iv y ON x.seq=y.seq AND x.feature='view'
           AND y.feature='purchase' AND greatest(x.start,y.start)<least(x."end",y."end") JOIN events e ON e.event_id=y.id""",
    ),
)
def tpm_by_interval(t):
    hits = overlap_join(t.features("view"), t.features("purchase"), 100_000).select("a_id", "b_id")
    peaks = t.table("events").select(F.col("event_id").alias("b_id"), F.col("event_type").alias("kind"), F.col("value").alias("tpm"))
    return rounded(hits.join(peaks, "b_id").select("a_id", "b_id", "kind", "tpm"), "tpm")


@query(
    "dedupe_last",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
       FROM events) WHERE rn=1""",
)
def dedupe_last(t):
    rows = t.table("events").select("user_id", "event_type", "event_id", "ts")
    return P.dedupe_last(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "forward_fill_header",
    """SELECT event_id AS id, last_value(CASE WHEN event_type='signup' THEN props END IGNORE NULLS) OVER
       (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""",
)
def forward_fill_header(t):
    """Every event carries the props of the user's last signup."""
    marked = t.table("events").select(
        "user_id", F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", F.col("props")).alias("h")
    )
    return N.forward_fill(marked, ["user_id"], "id", "h", "header").select("id", "header")


@query(
    "first_per_group",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
       FROM lineitem) WHERE rn=1""",
)
def first_per_group_query(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return first_per_group(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("sort_dedupe_gene", "SELECT o_custkey AS gene_id, min(o_orderkey) AS id FROM orders GROUP BY 1 ORDER BY 1")
def sort_dedupe_gene(t):
    rows = t.table("orders").select(F.col("o_custkey").alias("gene_id"), F.col("o_orderkey").alias("id"))
    return first_per_group(rows, ["gene_id"], ["id"]).orderBy("gene_id")


@query("sort_position", with_("iv", 'SELECT seq, start, "end", id FROM iv ORDER BY seq, start, id'))
def sort_position(t):
    return t.iv.select("seq", "start", "end", "id").orderBy("seq", "start", "id")


@query("sort_annotated", with_("place_l", 'SELECT id AS gene_id, seq, start, "end" FROM place_l ORDER BY 1, 2'))
def sort_annotated(t):
    return extents(l_places(t), "id", ["seq"]).select(F.col("id").alias("gene_id"), "seq", "start", "end").orderBy("gene_id", "seq")


@query("project_cut", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def project_cut(t):
    return t.table("supplier").select("s_suppkey", "s_name", "s_nationkey")


@query(
    "share_ratios",
    with_(
        "pairs cat_g cat_l",
        """SELECT s.condition, h.a, h.b, round(n_shared/nullif(size_a-n_shared,0),6) AS ratio_shared, round(n_shared/nullif(size_a,0),6) AS prop_shared
           FROM st s JOIN sh h ON h.a=s.a AND h.b=s.b JOIN (SELECT entity, count(*) AS size_a FROM cat_l GROUP BY 1) z ON z.entity=h.a""",
        st=STRONG,
        sh=SHARED_N,
    ),
)
def share_ratios(t):
    listed, shared = strong_shared(t)
    ratios = S.share_ratios(shared).select("a", "b", "ratio_shared", "prop_shared")
    return rounded(listed.select(*BY, "a", "b").join(ratios, ["a", "b"]), "ratio_shared", "prop_shared")


@query(
    "round_report",
    f"""SELECT s_suppkey, round(v/7,3) AS r3, round({signif_sql('(v/7)', 3)},6) AS s3 FROM (SELECT s_suppkey, s_acctbal AS v FROM supplier)""",
)
def round_report(t):
    v = F.col("s_acctbal") / 7
    return t.table("supplier").select(
        "s_suppkey", F.round(v, 3).alias("r3"), F.round(round_significant(v, 3), 6).alias("s3")
    )


@query(
    "split_by_null",
    """SELECT n_nationkey AS category, round(p,6) AS padj FROM (SELECT n_nationkey, count(*) FILTER (s_acctbal<1000)/count(s_suppkey) AS p,
       min(CASE WHEN s_acctbal>9000 THEN s_name END) AS ontology FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1 HAVING count(s_suppkey)>0)
       WHERE ontology IS NULL AND p<=0.05""",
)
def split_by_null(t):
    """Nations without a top supplier whose share of poor suppliers is at most 5 %."""
    per = t.table("supplier").groupBy(F.col("s_nationkey").alias("category")).agg(
        (F.count_if(F.col("s_acctbal") < 1000) / F.count(F.lit(1))).alias("padj"),
        F.min(F.when(F.col("s_acctbal") > 9000, F.col("s_name"))).alias("ontology"),
    )
    return rounded(N.split_by_null(per, "ontology", 0.05, null_side=True).select("category", "padj"), "padj")


@query(
    "token_id_prefix",
    "SELECT l_partkey AS token_id, count(*) AS n FROM lineitem GROUP BY 1",
)
def token_id_prefix(t):
    """The token before the first underscore of synthetic site ids."""
    site = F.concat_ws("_", F.col("l_partkey").cast("string"), F.concat(F.lit("locus:"), F.col("l_orderkey").cast("string")))
    prefix = F.substring_index(site, "_", 1).cast("long")
    return t.lineitem.select(prefix.alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_frequency",
    with_(
        "expr_g",
        "SELECT CASE WHEN padj<=0.05 AND log2fc>0 THEN 'Up' WHEN padj<=0.05 AND log2fc<0 THEN 'Down' ELSE 'NoChange' END AS direction, count(*) AS n FROM de GROUP BY 1",
        **DE_CTES,
    ),
)
def class_frequency(t):
    return classify_direction(de_table(t)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
