"""End-to-end flows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import round_significant
from seriesloom.operators import annotate as N
from seriesloom.operators import expression as X
from seriesloom.operators import intervals as V
from seriesloom.operators import pairs as P
from seriesloom.operators import sets as S
from seriesloom.operators import statistics as T
from seriesloom.operators.clustering import threshold_clusters
from seriesloom.operators.models import module_pc1
from seriesloom.operators.statistics import de_contrast
from seriesloom.plans.bindings import BY, CONDITIONS, TIMES, Tables, g_id, g_places, l_id, l_places, rounded, with_
from seriesloom.plans.expression import DE_CTES, RATIO, de_table
from seriesloom.plans.intervals import BIN, BRIDGE, NULLS, axis_lengths, hourly_sites, merged_sql, scored_sites, symbols
from seriesloom.plans.modelling import CUT, MIN_SIZE, brand_distances
from seriesloom.plans.pairs import (
    MAX_SQL,
    NEAREST_SQL,
    RANDOM_SQL,
    brand_supplier_pairs,
    random_pairs,
)
from seriesloom.plans.registry import query
from seriesloom.plans.sets import BY_DIRECTION, tokens_by_direction
from seriesloom.plans.sources import PLACED, site_report, target_orders
from seriesloom.plans.sqltext import sf_sql, signif_sql
from seriesloom.plans.statistics import TERMS, nation_terms, rank_sum_ctes
from seriesloom.plans.tables import CONC, SHARED_N, STRONG, rich_symbols, strong_pairs
from seriesloom.session import materialize

# Candidate pairs: dense brands, pairs that share tokens and correlate, peak expression of the partner.

GID = "'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0')"
CANDIDATES = dict(
    st=STRONG,
    sh=SHARED_N,
    dense="SELECT 'L_'||p_brand AS a FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1 HAVING count(*)/sum(l_quantity)*1000>39",
    pk="SELECT condition, entity, max(value) AS peak FROM mean_g WHERE time BETWEEN 1 AND 7 GROUP BY 1,2 HAVING max(value)>28",
    cand=f"""SELECT s.condition, s.a, s.b, coalesce(n.s_name, s.b) AS symbol, s.value, h.n_shared, k.peak FROM st s JOIN sh h ON h.a=s.a AND h.b=s.b
        JOIN dense d ON d.a=s.a JOIN pk k ON k.entity=s.b AND k.condition=s.condition LEFT JOIN (SELECT {GID} AS id, s_name FROM supplier WHERE s_acctbal>0) n ON n.id=s.b WHERE h.n_shared>=5""",
)


def shared_of(t: Tables, pairs: DataFrame) -> DataFrame:
    return S.shared_tokens(pairs, S.token_catalog(t.site_rows_l), S.token_catalog(t.site_rows_g))


def candidates(t: Tables) -> DataFrame:
    density = X.derive_density(F.count(F.lit(1)), F.sum("l_quantity"))
    dense = t.lines_with_brand.groupBy(l_id("p_brand").alias("a")).agg(density.alias("density")).filter("density > 39")
    pairs = materialize(strong_pairs(t).join(dense, "a", "left_semi"))
    sharing = shared_of(t, pairs).filter("n_shared >= 5").select("a", "b", "n_shared")
    kept = pairs.join(sharing, ["a", "b"])
    # One peak per condition and partner, so the join alone leaves one row per pair.
    peaks = X.peak_filter(t.mean_g(), 28.0).select(*BY, F.col("entity").alias("b"), "peak")
    enriched = kept.join(peaks, [*BY, "b"])
    return N.symbol_lookup(enriched, rich_symbols(t), "b").select(*BY, "a", "b", "symbol", "value", "n_shared", "peak")


@query(
    "candidate_pairs",
    with_("pairs mean_g cat_g cat_l", "SELECT condition, a, b, symbol, round(value,6) AS value, n_shared, round(peak,6) AS peak FROM cand", **CANDIDATES),
)
def candidate_pairs(t):
    return rounded(candidates(t), "value", "peak")


@query(
    "annotate_candidates",
    with_(
        "pairs mean_g cat_g cat_l place_l",
        "SELECT c.condition, c.b AS gene_id, c.symbol, p.seq, p.start, p.\"end\", c.a AS lnc_id, round(c.value,6) AS value, c.n_shared FROM cand c JOIN place_l p ON p.id=c.a ORDER BY condition, gene_id, seq, lnc_id",
        **CANDIDATES,
    ),
)
def annotate_candidates(t):
    places = V.extents(l_places(t), "id", ["seq"]).withColumnRenamed("id", "a")
    out = candidates(t).join(places, "a").select(
        *BY, F.col("b").alias("gene_id"), "symbol", "seq", "start", "end", F.col("a").alias("lnc_id"), "value", "n_shared"
    )
    return rounded(out, "value").orderBy(*BY, "gene_id", "seq", "lnc_id")


@query(
    "upregulated_candidates",
    with_(
        "pairs mean_g cat_g cat_l",
        """SELECT c.condition, c.a, c.b, m.time, round(m.value,6) AS expr FROM cand c
           JOIN (SELECT condition, entity FROM r WHERE time BETWEEN 1 AND 6 GROUP BY 1,2 HAVING avg(ratio)>=1) u ON u.entity=c.b AND u.condition=c.condition
           JOIN mean_g m ON m.entity=c.b AND m.condition=c.condition""",
        r=RATIO,
        **CANDIDATES,
    ),
)
def upregulated_candidates(t):
    means = t.mean_g()
    rising = X.net_change_filter(means, "up").select(*BY, F.col("entity").alias("b"))
    expr = means.select(*BY, F.col("entity").alias("b"), "time", F.col("value").alias("expr"))
    out = candidates(t).join(rising, [*BY, "b"], "left_semi").join(expr, [*BY, "b"])
    return rounded(out.select(*BY, "a", "b", "time", "expr"), "expr")


@query(
    "annotate_pair_list",
    with_(
        "pairs place_l",
        f"""SELECT s.condition, s.g_id AS gene_id, coalesce(n.s_name, s.g_id) AS gene_symbol, p.seq AS contig, p.start, p."end", s.l_id AS lnc_id, round(s.value,6) AS correlation
            FROM pairs s LEFT JOIN (SELECT {GID} AS id, s_name FROM supplier WHERE s_acctbal>0) n ON n.id=s.g_id LEFT JOIN place_l p ON p.id=s.l_id WHERE s.value<=-0.6""",
    ),
)
def annotate_pair_list(t):
    oriented = P.orient_pairs(brand_supplier_pairs(t, min_value=-0.6).drop("lag"), "a", "b")
    named = N.symbol_lookup(oriented, rich_symbols(t), "gene_id", "gene_symbol")
    places = l_places(t).select(F.col("id").alias("lnc_id"), F.col("seq").alias("contig"), "start", "end")
    out = named.join(places, "lnc_id", "left").withColumnRenamed("value", "correlation")
    return rounded(out.select(*BY, "gene_id", "gene_symbol", "contig", "start", "end", "lnc_id", "correlation"), "correlation")


# Pair sets: correlated, proximal, random and anticorrelated partners of the brands.

FOUR = ["correlated", "random", "proximal", "anticorrelated"]
FOUR_PAIRS = """SELECT * FROM (VALUES ('correlated','random'),('correlated','anticorrelated'),('correlated','proximal'),('random','anticorrelated'),
   ('random','proximal'),('anticorrelated','proximal')) v(c1,c2)"""
PAIR_SETS = dict(
    RANDOM_SQL,
    best=MAX_SQL,
    worst=MAX_SQL.replace("DESC", "ASC"),
    near=NEAREST_SQL,
    ps="""SELECT 'correlated' AS cat, condition, l_id AS a, g_id AS b FROM best UNION ALL SELECT 'anticorrelated', condition, l_id, g_id FROM worst
        UNION ALL SELECT 'proximal', condition, id, closest_id FROM near, (SELECT DISTINCT condition FROM mean_l)
        UNION ALL SELECT 'random', condition, a, b FROM rp""",
)
SET_DEPS = "pairs place_l place_g mean_l mean_g class_l"


def pair_sets(t: Tables) -> DataFrame:
    """Four sets of pairs per condition; nearest pairs count for all conditions."""
    # Both extremes come from one aggregation of the scores, which are never written.
    v = F.round("value", 9)
    extreme = lambda rank: F.min(F.struct(rank.alias("rank"), "b"))["b"]
    ends = brand_supplier_pairs(t).groupBy(*BY, "a").agg(extreme(-v).alias("correlated"), extreme(v).alias("anticorrelated"))
    named = F.explode(F.create_map(F.lit("correlated"), F.col("correlated"), F.lit("anticorrelated"), F.col("anticorrelated"))).alias("cat", "b")
    near = V.nearest_join(l_places(t), g_places(t)).select(
        F.explode(F.array(*map(F.lit, CONDITIONS))).alias("condition"), F.col("id").alias("a"), F.col("closest_id").alias("b")
    )
    tagged = S.union_tagged({"proximal": near, "random": random_pairs(t)})
    return materialize(ends.select(*BY, "a", named).unionByName(tagged))


def compared(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """Rank sums over the four sets; the correlated pairs lead, then random, then the rest by name."""
    return rounded(T.rank_sum(df, "cat", "value", "greater", ["correlated", "random"], by), "z", "pvalue")


COMPARED = f"SELECT cat1, cat2, n1, n2, w::DOUBLE AS w, round(z,6) AS z, round({sf_sql('z')},6) AS pvalue FROM st1"
COMPARED_EACH = COMPARED.replace("SELECT cat1", "SELECT condition, cat1", 1)
GREATER_Z = dict(st1="SELECT *, (w-n1*n2/2.0-0.5)/nullif(sg,0) AS z FROM st0")


@query(
    "density_comparison",
    with_(
        SET_DEPS,
        COMPARED_EACH,
        **PAIR_SETS,
        de="SELECT 'G'||lpad(CAST(l_suppkey AS VARCHAR),7,'0') AS b, round(count(*)/sum(l_quantity)*1000,9) AS value FROM lineitem GROUP BY 1",
        **rank_sum_ctes("SELECT DISTINCT condition, cat, b, value FROM ps JOIN de USING (b)", FOUR_PAIRS, "condition"),
        **GREATER_Z,
    ),
)
def density_comparison(t):
    """Is the site density of correlated partners higher than that of the other sets?"""
    density = t.lineitem.groupBy(g_id("l_suppkey").alias("b")).agg(
        F.round(X.derive_density(F.count(F.lit(1)), F.sum("l_quantity")), 9).alias("value")
    )
    return compared(pair_sets(t).select(*BY, "cat", "b").distinct().join(density, "b"))


@query(
    "shared_comparison",
    with_(
        SET_DEPS + " cat_g cat_l",
        COMPARED_EACH,
        **PAIR_SETS,
        sn="""SELECT p.condition, p.cat, p.a, p.b, count(y.token) AS value FROM ps p LEFT JOIN cat_g x ON x.entity=p.b LEFT JOIN cat_l y ON y.entity=p.a AND y.token=x.token GROUP BY 1,2,3,4""",
        **rank_sum_ctes("SELECT condition, cat, value FROM sn", FOUR_PAIRS, "condition"),
        **GREATER_Z,
    ),
)
def shared_comparison(t):
    """Do correlated pairs share more tokens than the other sets?"""
    sets = pair_sets(t)
    shared = shared_of(t, sets.select("a", "b").distinct()).select("a", "b", F.col("n_shared").alias("value"))
    return compared(sets.join(shared, ["a", "b"]))


@query(
    "conservation_comparison",
    with_(
        "",
        COMPARED,
        **NULLS,
        tg="""SELECT s.seq, 100.0::DOUBLE*count(*) FILTER (pvalue<0.1)/count(*) AS value FROM pv JOIN site s USING (id) GROUP BY 1""",
        ct="SELECT user_id AS seq, CASE WHEN max(value)>400 THEN 'correlated' ELSE 'random' END AS cat FROM events GROUP BY 1",
        **rank_sum_ctes("SELECT cat, value FROM tg JOIN ct USING (seq)", "SELECT 'correlated' AS c1, 'random' AS c2"),
        **GREATER_Z,
    ),
)
def conservation_comparison(t):
    """Share of conserved sites per user, users with extreme events against the others."""
    scored = scored_sites(t).join(hourly_sites(t).select("id", "seq"), "id")
    per = T.conservation_summary(scored, ["seq"], alpha=0.1).select("seq", F.col("pct_sig").alias("value"))
    cats = t.table("events").groupBy(F.col("user_id").alias("seq")).agg(
        F.when(F.max("value") > 400, "correlated").otherwise("random").alias("cat")
    )
    return compared(per.join(cats, "seq"), [])


@query(
    "core_entities",
    with_(
        "expr_g mean_g",
        """SELECT time, entity FROM up WHERE entity IN (SELECT x.entity FROM de x JOIN e y ON x.entity=y.entity WHERE x.padj<=0.01 AND y.padj<=0.01 AND sign(x.log2fc)=sign(y.log2fc))
           GROUP BY 1,2 HAVING count(DISTINCT condition)=3""",
        **CONC,
        up="SELECT time, entity, condition FROM (SELECT *, avg(value) OVER (PARTITION BY entity, condition) AS m FROM mean_g) WHERE value>m",
    ),
)
def core_entities(t):
    """Concordant suppliers above their own mean under all conditions, per time."""
    concordant = N.concordant_de_join(de_table(t), de_contrast(t.effects, "A", "R"), 0.01, "padj").filter("concordant")
    means = t.mean_g()
    own = means.groupBy("entity", "condition").agg(F.avg("value").alias("m"))
    up = means.join(own, ["entity", "condition"]).filter("value > m")
    core = S.intersect_n(up, len(CONDITIONS), "condition", "entity", extra=["time"])
    return core.join(concordant.select("entity"), "entity", "left_semi").select("time", "entity")


@query("module_partner_report")
def module_partner_report(t):
    """Per condition brands into modules, one profile per module, and its best correlated supplier."""
    means = materialize(t.mean_l())
    nodes = means.select(*BY, "entity").distinct()
    clusters = materialize(threshold_clusters(brand_distances(t), nodes, CUT, MIN_SIZE, BY))
    profiles = module_pc1(means, clusters, TIMES, BY).select(*BY, F.col("cluster").alias("entity"), "time", F.col("score").alias("value"))
    scored = P.pair_corr(profiles, t.mean_g(), TIMES, by=BY).drop("lag")
    return rounded(P.best_partner(scored, [*BY, "a"], "b", digits=6), "value", digits=5)


PEAKS = dict(
    pk="SELECT * FROM iv WHERE feature='purchase'",
    un="SELECT * FROM iv WHERE feature='click' AND value>200",
    mg=merged_sql("un", "seq, strand"),
    kept="""SELECT a.* FROM pk a LEFT JOIN mg b ON a.seq=b.seq AND a.strand=b.strand AND greatest(a.start,b.start)<least(a."end",b."end") GROUP BY ALL
        HAVING coalesce(coalesce(sum(CASE WHEN b.start IS NOT NULL THEN least(a."end",b."end")-greatest(a.start,b.start) END),0)/nullif(a."end"-a.start,0),0) < 0.75""",
    z="""SELECT x.id AS old_id, y.id AS new_id FROM (SELECT id, row_number() OVER (ORDER BY start,id) AS i FROM kept) x JOIN
        (SELECT id, row_number() OVER (ORDER BY start,id) AS i FROM iv WHERE feature='signup') y USING (i)""",
    ft="SELECT * FROM iv WHERE feature='error'",
    lm=merged_sql("ft", "seq, feature"),
    ln='SELECT m.seq, greatest(m.start-100,0) AS start, least(m."end"+100,k.length) AS "end" FROM lm m JOIN (SELECT seq, max(start)+3600 AS length FROM iv GROUP BY 1) k USING (seq)',
)


@query(
    "peak_expression_by_interval",
    with_(
        "iv",
        """SELECT l.seq, l.start, l."end", k.id AS peak, least(l."end",k."end")-greatest(l.start,k.start) AS width, round(e.value,6) AS tpm
           FROM ln l JOIN kept k ON k.seq=l.seq AND greatest(k.start,l.start)<least(k."end",l."end") JOIN z ON z.old_id=k.id JOIN events e ON e.event_id=z.new_id""",
        **PEAKS,
    ),
)
def peak_expression_by_interval(t):
    """Lifted peaks, re-keyed by position, on merged and extended intervals, with their expression."""
    kept = materialize(V.subtract_fraction(t.features("purchase"), t.features("click").filter("value > 200"), 0.75))
    zipped = N.positional_zip(kept.select("start", "id"), t.features("signup").select("start", "id"), ["start", "id"])
    merged = V.merge_intervals(t.features("error"), ["seq", "feature"]).select("seq", "start", "end")
    wide = V.extend_intervals(merged, axis_lengths(t))
    hits = V.overlap_join(wide, kept.select("id", "seq", "start", "end"), BIN)
    peaks = t.table("events").select(F.col("event_id").alias("new"), F.col("value").alias("tpm"))
    keyed = zipped.select(F.col("a_id").alias("peak"), F.col("b_id").alias("new")).join(peaks, "new")
    out = hits.select(F.col("a_seq").alias("seq"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_id").alias("peak"), "width")
    return rounded(out.join(keyed, "peak").select("seq", "start", "end", "peak", "width", "tpm"), "tpm")


def bridge_sample_sql(flag: str) -> str:
    base = BRIDGE
    two = base["two"].replace("FROM reads", f"FROM (SELECT * FROM rd WHERE flag='{flag}')")
    return f"""SELECT s.symbol, '{flag}' AS sample, count(DISTINCT r.qname) AS n FROM (SELECT * FROM seg WHERE p_type='STANDARD') s LEFT JOIN
       (WITH two AS ({two}), fl AS ({base['fl']}), ok AS ({base['ok']}) SELECT two.* FROM two JOIN ok USING (qname)) r ON greatest(r.start,s.start)<least(r."end",s."end") GROUP BY 1"""


@query(
    "bridge_counts",
    with_(
        "seg",
        "SELECT symbol, " + ", ".join(f"max(CASE WHEN sample='{c}' THEN n END) AS \"{c}\"" for c in CONDITIONS) + " FROM al GROUP BY 1",
        rd="""SELECT l_returnflag AS flag, l_orderkey AS qname, 'locus' AS seq, s AS start, s + CAST(l_quantity AS BIGINT) AS "end"
              FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s FROM lineitem)""",
        al=" UNION ALL ".join(bridge_sample_sql(c) for c in CONDITIONS),
    ),
)
def bridge_counts(t):
    """Bridging pairs per segment symbol, one column per sample (return flag)."""
    from seriesloom.sources.tables import combine_tables

    rows = t.lineitem.withColumn("start", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long"))
    reads = rows.select(
        F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("qname"), F.lit("locus").alias("seq"), "start",
        (F.col("start") + F.col("l_quantity").cast("long")).alias("end"),
    )
    j, c = t.segments("ECONOMY"), t.segments("STANDARD")
    pair = ["sample", "qname"]
    per = V.bridge_counts(V.bridging_pairs(reads, j, c, by=pair), c, 50, by=pair)
    wide = combine_tables(per, "symbol", "sample", "n_pairs", CONDITIONS)
    return symbols(c).join(wide, "symbol", "left").na.fill(0, CONDITIONS)


@query(
    "site_count_report",
    f"""WITH si AS ({PLACED}), tg AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, substr(o_orderpriority,3,20) AS seq, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s FROM orders),
        ex AS (SELECT id, seq, s AS start, s+100 AS "end" FROM tg UNION ALL SELECT id, seq, s+500, s+600 FROM tg)
        SELECT ex.id AS target, count(*) AS n_sites, count(DISTINCT si.token) AS n_tokens, CAST(sum(least(si."end",ex."end")-greatest(si.start,ex.start)) AS BIGINT) AS bases
        FROM si JOIN ex ON si.target=ex.id AND si.seq=ex.seq AND greatest(si.start,ex.start)<least(si."end",ex."end")
        WHERE si.token IN (SELECT 'mmu-'||p_partkey FROM part WHERE p_type='SMALL') GROUP BY 1""",
)
def site_count_report(t):
    """Placed sites of the listed tokens on the exons of their own target, counted per target."""
    listed = t.part.filter("p_type = 'SMALL'").select(F.concat(F.lit("mmu-"), F.col("p_partkey").cast("string")).alias("token"))
    sites = site_report(t).join(listed, "token", "left_semi")
    # A target's name and place together are the axis, so only its own sites meet its exons.
    axis = F.concat_ws("|", "target", "seq")
    own = sites.select(axis.alias("seq"), "start", "end", "token", "target")
    exons = target_orders(t).withColumnRenamed("transcript_id", "target").select(axis.alias("seq"), "start", "end", "target")
    met = V.overlap_join(own, exons, 1000)
    return met.groupBy(F.col("b_target").alias("target")).agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_distinct("a_token").alias("n_tokens"), F.sum("width").alias("bases")
    )


@query(
    "enrichment_report",
    with_(
        "",
        f"""SELECT cluster, category, round({signif_sql('padj', 3)},9) AS padj, fold FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(padj,9), round(pvalue,9), category) AS rank
            FROM ora WHERE category LIKE 'brand:%') WHERE rank=1""",
        **TERMS,
    ),
)
def enrichment_report(t):
    """The best brand of every nation with its fold enrichment."""
    brands = nation_terms(t).filter("category LIKE 'brand:%'")
    best = N.top_terms_per_cluster(brands, "cluster", 1, [F.round("padj", 9), F.round("pvalue", 9), "category"])
    shown = best.withColumn("padj", F.round(round_significant(F.col("padj"), 3), 9))
    return shown.select("cluster", "category", "padj", "fold").orderBy("padj", "cluster")


DE_SITES = dict(
    BY_DIRECTION,
    dn="""SELECT di.direction AS cat, round(count(*)/sum(l_quantity)*1000,9) AS value FROM di JOIN lineitem ON 'G'||lpad(CAST(l_suppkey AS VARCHAR),7,'0')=di.entity GROUP BY di.entity, di.direction""",
)


@query(
    "de_site_report",
    with_(
        "pairs cat_g cat_l expr_g",
        f"""SELECT k.condition, cat1, cat2, n1, n2, round(z,6) AS z, round(least(1.0::DOUBLE,2*{sf_sql('az')}),6) AS pvalue, t1.n AS tokens1, t2.n AS tokens2
            FROM st2 CROSS JOIN (SELECT DISTINCT condition FROM tn) k LEFT JOIN tn t1 ON t1.direction=cat1 AND t1.condition=k.condition
            LEFT JOIN tn t2 ON t2.direction=cat2 AND t2.condition=k.condition""",
        **DE_CTES,
        **DE_SITES,
        tn="SELECT condition, direction, count(*) AS n FROM tk WHERE token<>'' GROUP BY 1,2",
        **rank_sum_ctes("SELECT cat, value FROM dn", "SELECT * FROM (VALUES ('Down','NoChange'),('Down','Up'),('NoChange','Up')) v(c1,c2)"),
        st1="SELECT *, (w-n1*n2/2.0-sign(w-n1*n2/2.0)*0.5)/nullif(sg,0) AS z FROM st0",
        st2="SELECT *, abs(z) AS az FROM st1",
    ),
)
def de_site_report(t):
    """Site density of rising, falling and unchanged suppliers compared, with their shared tokens under each condition."""
    directions = materialize(X.classify_direction(de_table(t)).select("entity", "direction"))
    density = t.lineitem.groupBy(g_id("l_suppkey").alias("entity")).agg(
        F.round(X.derive_density(F.count(F.lit(1)), F.sum("l_quantity")), 9).alias("value")
    )
    tested = T.rank_sum(directions.join(density, "entity"), "direction", "value", "two-sided")
    tokens = materialize(tokens_by_direction(t, directions).groupBy(*BY, "direction").agg(F.count(F.lit(1)).alias("n")))
    # Conditions are design levels; every test is shown beside the tokens of each.
    known = tokens.agg(F.array_sort(F.collect_set("condition"))).scalar()
    out = tested.withColumn("_known", known).select(F.explode("_known").alias("condition"), "cat1", "cat2", "n1", "n2", "z", "pvalue")
    for k in ("1", "2"):
        side = tokens.select(*BY, F.col("direction").alias(f"cat{k}"), F.col("n").alias(f"tokens{k}"))
        out = out.join(side, [*BY, f"cat{k}"], "left")
    return rounded(out.select(*BY, "cat1", "cat2", "n1", "n2", "z", "pvalue", "tokens1", "tokens2"), "z", "pvalue")
