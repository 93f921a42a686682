"""Interval joins, merging, depth and read pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import intervals as V
from seriesloom.operators.scan import running
from seriesloom.operators.statistics import conservation_summary, empirical_pvalue
from seriesloom.plans.bindings import Tables, day_number, epoch_seconds, rounded, with_
from seriesloom.plans.registry import query

BIN = 100_000


@query(
    "interval_overlap_join",
    with_(
        "iv",
        """SELECT v.id AS site_id, p.id AS feature_id, p.strand AS source FROM iv v JOIN iv p ON v.seq=p.seq AND v.feature='view'
           AND p.feature='purchase' AND greatest(v.start,p.start)<least(v."end",p."end")""",
    ),
)
def interval_overlap_join(t):
    """Every overlapping (site, feature); the site takes over the feature's strand as source."""
    met = V.overlap_join(t.features("view"), t.features("purchase"), BIN)
    return met.select(F.col("a_id").alias("site_id"), F.col("b_id").alias("feature_id"), F.col("b_strand").alias("source"))


@query(
    "interval_overlap_width",
    with_(
        "iv",
        """SELECT v.id AS a_id, v.start AS a_start, v."end" AS a_end, p.id AS b_id, p.start AS b_start, p."end" AS b_end,
           least(v."end",p."end")-greatest(v.start,p.start) AS width FROM iv v JOIN iv p ON v.seq=p.seq AND v.feature='click'
           AND p.feature='signup' AND greatest(v.start,p.start)<least(v."end",p."end")""",
    ),
)
def interval_overlap_width(t):
    met = V.overlap_join(t.features("click"), t.features("signup"), BIN, stranded=True)
    return met.select("a_id", "a_start", "a_end", "b_id", "b_start", "b_end", "width")


@query(
    "interval_contained_filter",
    with_(
        "iv",
        """SELECT id FROM iv v WHERE feature='view' AND EXISTS (SELECT 1 FROM iv p WHERE p.feature='purchase' AND p.seq=v.seq
           AND v.start>=p.start AND v."end"<=p."end")""",
    ),
)
def interval_contained_filter(t):
    return V.contained_semi(t.features("view"), t.features("purchase")).select("id")


@query(
    "interval_overlaps_any",
    with_(
        "iv",
        """SELECT id FROM iv v WHERE feature='view' AND EXISTS (SELECT 1 FROM iv p WHERE p.feature='purchase' AND p.seq=v.seq
           AND greatest(v.start,p.start)<least(v."end",p."end"))""",
    ),
)
def interval_overlaps_any(t):
    return V.overlaps_any(t.features("view"), t.features("purchase")).select("id")


def merged_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY start, "end", id) AS g
      FROM (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {by} ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 1 ELSE 0 END AS fresh FROM {src})) GROUP BY {by}, g"""


@query(
    "interval_subtract_fraction",
    with_(
        "iv",
        """SELECT a.id FROM iv a LEFT JOIN mg b ON a.seq=b.seq AND a.strand=b.strand AND greatest(a.start,b.start)<least(a."end",b."end")
           WHERE a.feature='click' GROUP BY a.id, a.start, a."end"
           HAVING coalesce(coalesce(sum(CASE WHEN b.start IS NOT NULL THEN least(a."end",b."end")-greatest(a.start,b.start) END),0)/nullif(a."end"-a.start,0),0) < 0.75""",
        src="SELECT * FROM iv WHERE feature='purchase'",
        mg=merged_sql("src", "seq, strand"),
    ),
)
def interval_subtract_fraction(t):
    return V.subtract_fraction(t.features("click"), t.features("purchase"), 0.75).select("id")


@query(
    "nearest_feature",
    with_(
        "iv",
        """SELECT id, closest_id, distance FROM (SELECT l.id, g.id AS closest_id, greatest(l.start-g."end", g.start-l."end", 0) AS distance,
           row_number() OVER (PARTITION BY l.id ORDER BY greatest(l.start-g."end", g.start-l."end", 0), CASE WHEN g.start<l."end" THEN 0 ELSE 1 END,
           CASE WHEN g.start<l."end" THEN -g."end" ELSE g.start END, g.id DESC) AS rn FROM iv l JOIN iv g ON l.seq=g.seq
           AND l.feature='view' AND g.feature='purchase') WHERE rn=1""",
    ),
)
def nearest_feature(t):
    return V.nearest_join(t.features("view"), t.features("purchase"))


@query("interval_merge_by_name", with_("iv", merged_sql("iv", "seq, feature")))
def interval_merge_by_name(t):
    return V.merge_intervals(t.iv, ["seq", "feature"])


DEPTH = dict(
    dl="""SELECT seq, start AS pos, CASE WHEN strand='+' THEN 1 ELSE 0 END AS p, CASE WHEN strand='-' THEN 1 ELSE 0 END AS m FROM iv
          UNION ALL SELECT seq, "end", CASE WHEN strand='+' THEN -1 ELSE 0 END, CASE WHEN strand='-' THEN -1 ELSE 0 END FROM iv""",
    st="SELECT seq, pos, sum(p) AS p, sum(m) AS m FROM dl GROUP BY 1,2 HAVING sum(p)<>0 OR sum(m)<>0",
)


@query(
    "stranded_coverage",
    with_(
        "iv",
        """SELECT * FROM (SELECT seq, pos AS start, lead(pos) OVER w AS "end", CAST(sum(p) OVER w AS BIGINT) AS plus, CAST(-sum(m) OVER w AS BIGINT) AS minus
           FROM st WINDOW w AS (PARTITION BY seq ORDER BY pos)) WHERE "end" IS NOT NULL""",
        **DEPTH,
    ),
)
def stranded_coverage(t):
    return V.coverage(t.iv)


@query(
    "running_depth",
    with_(
        "iv",
        "SELECT seq, pos, CAST(sum(d) OVER (PARTITION BY seq ORDER BY pos) AS BIGINT) AS depth FROM (SELECT seq, pos, sum(p+m) AS d FROM dl GROUP BY 1,2)",
        dl=DEPTH["dl"],
    ),
)
def running_depth(t):
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    steps = t.iv.select("seq", F.inline(ends)).groupBy("seq", "pos").agg(F.sum("d").alias("d"))
    return running(steps, ["seq"], "pos", {"depth": ("sum", F.col("d"))}).select("seq", "pos", "depth")


def axis_lengths(t: Tables):
    """Length of each sequence: its last start plus one hour."""
    return t.iv.groupBy("seq").agg((F.max("start") + 3600).alias("length"))


@query(
    "interval_extend",
    with_(
        "iv",
        """SELECT id, greatest(start-100,0) AS start, least("end"+100,length) AS "end" FROM iv JOIN (SELECT seq, max(start)+3600 AS length FROM iv GROUP BY 1) USING (seq)""",
    ),
)
def interval_extend(t):
    return V.extend_intervals(t.iv, axis_lengths(t)).select("id", "start", "end")


@query(
    "interval_extend_five_prime",
    with_(
        "iv",
        """SELECT id, CASE WHEN strand='+' THEN greatest(start-100,0) ELSE start END AS start, CASE WHEN strand='-' THEN least("end"+100,length) ELSE "end" END AS "end"
           FROM iv JOIN (SELECT seq, max(start)+3600 AS length FROM iv GROUP BY 1) USING (seq)""",
    ),
)
def interval_extend_five_prime(t):
    return V.extend_intervals(t.iv, axis_lengths(t), five_prime_only=True).select("id", "start", "end")


@query("spliced_length", with_("iv", 'SELECT seq, CAST(sum("end"-start) AS BIGINT) AS length FROM iv GROUP BY 1'))
def spliced_length(t):
    return V.spliced_length(t.iv, "seq")


@query(
    "merged_length",
    with_("iv", 'SELECT seq, CAST(sum("end"-start) AS BIGINT) AS length FROM mg GROUP BY 1', mg=merged_sql("iv", "seq")),
)
def merged_length(t):
    return V.merged_length(t.iv, "seq")


@query(
    "gene_extent",
    with_("iv", 'SELECT seq, min(start) AS start, max("end") AS "end", min(feature) AS feature, min(strand) AS strand FROM iv GROUP BY 1'),
)
def gene_extent(t):
    return V.extents(t.iv, "seq", ["feature", "strand"])


@query(
    "site_counts_zero_filled",
    with_("iv", "SELECT s.seq, count(v.id) AS n_sites FROM (SELECT DISTINCT seq FROM iv) s LEFT JOIN iv v ON v.seq=s.seq AND v.feature='view' AND v.value>300 GROUP BY 1"),
)
def site_counts_zero_filled(t):
    return V.count_sites_zero_filled(t.iv, t.features("view").filter("value > 300"), "seq")


@query(
    "concat_intervals",
    with_("iv", "SELECT feature, count(*) AS n, CAST(sum(\"end\"-start) AS BIGINT) AS total FROM (SELECT * FROM iv WHERE feature='view' UNION ALL SELECT * FROM iv WHERE feature='click') GROUP BY 1"),
)
def concat_intervals(t):
    both = t.features("view").unionByName(t.features("click"))
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))


BRIDGE = dict(
    two="SELECT * FROM reads WHERE qname IN (SELECT qname FROM reads GROUP BY 1 HAVING count(*)=2)",
    fl="""SELECT qname, start, "end", EXISTS (SELECT 1 FROM seg s WHERE s.p_type='ECONOMY' AND two.start<s."end" AND s.start-1<two."end") AS j,
          EXISTS (SELECT 1 FROM seg s WHERE s.p_type='STANDARD' AND two.start<s."end" AND s.start-1<two."end") AS c FROM two""",
    ok="""SELECT qname FROM fl GROUP BY 1 HAVING sum(j::INT)>=1 AND sum(c::INT)>=1 AND sum((j OR c)::INT)=2""",
)


def bridging(t: Tables):
    return V.bridging_pairs(t.reads, t.segments("ECONOMY"), t.segments("STANDARD"))


@query("read_pair_bridge", with_("reads seg", "SELECT qname FROM ok", **BRIDGE))
def read_pair_bridge(t):
    return bridging(t).select("qname").distinct()


@query(
    "bridge_isotype_counts",
    with_(
        "reads seg",
        """SELECT s.symbol, count(DISTINCT r.qname) AS n_pairs FROM (SELECT * FROM seg WHERE p_type='STANDARD') s
           LEFT JOIN (SELECT two.* FROM two JOIN ok USING (qname)) r ON greatest(r.start,s.start)<least(r."end",s."end") GROUP BY 1""",
        **BRIDGE,
    ),
)
def bridge_isotype_counts(t):
    c = t.segments("STANDARD")
    counted = V.bridge_counts(bridging(t), c, 50)
    return symbols(c).join(counted, "symbol", "left").na.fill({"n_pairs": 0})


# Alignments with a bit field: lines as mates in turn, proper unless open, some unmapped; the locus is a window of days.
LOCUS = (900, 2100)
FLAGGED = dict(
    aligned="""SELECT l_orderkey AS qname, 'locus' AS seq, s AS start, s + CAST(l_quantity AS BIGINT) AS "end",
               (CASE WHEN l_returnflag<>'N' OR l_tax>0.02 THEN 2 ELSE 0 END) + (CASE WHEN l_discount=0 THEN 4 ELSE 0 END)
               + (CASE WHEN l_linestatus='O' THEN 16 ELSE 0 END) + (CASE WHEN l_linenumber%2=1 THEN 64 ELSE 128 END) AS flag
               FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s FROM lineitem)""",
    reads=f"""SELECT qname, seq, start, "end", CASE WHEN (flag & 64 <> 0) = (flag & 16 <> 0) THEN '+' ELSE '-' END AS strand
              FROM aligned WHERE flag & 2 <> 0 AND flag & 4 = 0 AND start < "end" AND start < {LOCUS[1]} AND "end" > {LOCUS[0]}""",
)


def located_reads(t: Tables):
    bit = lambda when, value: F.when(when, value).otherwise(0)
    flag = (
        bit((F.col("l_returnflag") != "N") | (F.col("l_tax") > 0.02), V.PROPER_PAIR)
        + bit(F.col("l_discount") == 0, V.UNMAPPED)
        + bit(F.col("l_linestatus") == "O", V.REVERSE)
        + F.when(F.col("l_linenumber") % 2 == 1, V.FIRST_MATE).otherwise(128)
    )
    start = day_number("l_shipdate")
    reads = t.lineitem.select(
        F.col("l_orderkey").alias("qname"), F.lit("locus").alias("seq"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), flag.alias("flag")
    )
    locus = reads.agg(F.lit("locus").alias("seq"), F.lit(LOCUS[0]).cast("long").alias("start"), F.lit(LOCUS[1]).cast("long").alias("end"))
    return V.flagged_reads(reads, locus)


@query("read_pair_bridge_flagged", with_("seg", "SELECT qname FROM ok", **FLAGGED, **BRIDGE))
def read_pair_bridge_flagged(t):
    return V.bridging_pairs(located_reads(t), t.segments("ECONOMY"), t.segments("STANDARD")).select("qname").distinct()


@query(
    "stranded_coverage_flagged",
    with_(
        "",
        """SELECT * FROM (SELECT seq, pos AS start, lead(pos) OVER w AS "end", CAST(sum(p) OVER w AS BIGINT) AS plus, CAST(-sum(m) OVER w AS BIGINT) AS minus
           FROM st WINDOW w AS (PARTITION BY seq ORDER BY pos)) WHERE "end" IS NOT NULL""",
        **FLAGGED,
        **{k: v.replace("FROM iv", "FROM reads") for k, v in DEPTH.items()},
    ),
)
def stranded_coverage_flagged(t):
    return V.coverage(located_reads(t))


def symbols(segments):
    return segments.select(F.substring_index("transcript_name", "-", 1).alias("symbol")).distinct()


# Tracks, hosts and sites on an hourly axis per user.


def hour(col: str):
    return F.floor(epoch_seconds(col) / 3600).cast("long")


def hourly_track(t: Tables):
    return t.table("events").groupBy(F.col("user_id").alias("seq"), hour("ts").alias("pos")).agg(F.round(F.avg("value"), 9).alias("score"))


def hourly_sites(t: Tables):
    at = t.table("events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("seq"), hour("ts").alias("start"))
    return at.withColumn("end", F.col("start") + 6)


def hourly_hosts(t: Tables):
    """One host per user: the hours from first to last event, and 20 hours more."""
    return t.table("events").groupBy(F.col("user_id").alias("seq")).agg(F.min(hour("ts")).alias("start"), (F.max(hour("ts")) + 20).alias("end"))


def hourly_gaps(t: Tables):
    """Hours with an error event count as alignment gaps."""
    return t.table("events").filter("event_type = 'error'").select(F.col("user_id").alias("seq"), hour("ts").alias("pos")).distinct()


PERMS, DRAW_SEED = 100, 7
HOUR = "CAST(floor(epoch(ts)/3600) AS BIGINT)"
TRACK = dict(
    track=f"SELECT user_id AS seq, {HOUR} AS pos, round(avg(value),9) AS score FROM events GROUP BY 1,2",
    site=f"SELECT event_id AS id, user_id AS seq, {HOUR} AS start, {HOUR}+6 AS \"end\" FROM events WHERE event_type='view'",
    host=f"SELECT user_id AS seq, min({HOUR}) AS start, max({HOUR})+20 AS \"end\" FROM events GROUP BY 1",
    gap=f"SELECT DISTINCT user_id AS seq, {HOUR} AS pos FROM events WHERE event_type='error'",
    val="SELECT * FROM track WHERE (seq,pos) NOT IN (SELECT seq, pos FROM gap)",
    obs="""SELECT s.id, sum(coalesce(v.score,0))/6 AS score FROM (SELECT id, seq, unnest(range(start,"end")) AS pos FROM site) s
           LEFT JOIN val v ON v.seq=s.seq AND v.pos=s.pos GROUP BY 1""",
)
NULLS = dict(
    TRACK,
    loc="""SELECT s.id, s.seq, h.start AS h0, h."end"-h.start AS size, greatest(s.start-h.start,5) AS m0,
           greatest(least(s."end"-h.start, h."end"-h.start-4)-greatest(s.start-h.start,5),0) AS masked FROM site s JOIN host h ON h.seq=s.seq""",
    dr=f"""SELECT *, size-9-masked AS room, CAST('0x'||substr(md5(id||'|'||perm||'|'||draw||'|{DRAW_SEED}'),1,8) AS BIGINT) AS u
           FROM loc, range(1,{PERMS + 1}) p(perm), range(1,7) d(draw) WHERE size>10 AND size-9-masked>0""",
    po="SELECT id, perm, seq, h0 + CASE WHEN masked>0 AND 5+u%room>=m0 THEN 5+u%room+masked ELSE 5+u%room END AS pos FROM dr",
    nu="SELECT p.id, p.perm, sum(coalesce(v.score,0))/count(*) AS ns FROM po p LEFT JOIN val v ON v.seq=p.seq AND v.pos=p.pos GROUP BY 1,2",
    pv=f"""SELECT o.id, o.score, coalesce(n.above/{PERMS}.0, 0.0) AS pvalue FROM obs o LEFT JOIN (SELECT n.id, sum(CASE WHEN round(n.ns,9)>round(o.score,9) THEN 1 ELSE 0 END) AS above
           FROM nu n JOIN obs o USING (id) GROUP BY 1) n ON n.id=o.id""",
)


@query("interval_score", with_("", "SELECT id, round(score,6) AS score FROM obs", **TRACK))
def interval_score(t):
    return rounded(V.interval_scores(hourly_sites(t), hourly_track(t), hourly_gaps(t)), "score")


def scored_sites(t: Tables):
    return empirical_pvalue(hourly_sites(t), hourly_hosts(t), hourly_track(t), PERMS, DRAW_SEED, gaps=hourly_gaps(t))


@query("empirical_pvalue", with_("", "SELECT id, round(score,6) AS score, round(pvalue,6) AS pvalue FROM pv", **NULLS))
def empirical_pvalue_query(t):
    return rounded(scored_sites(t), "score", "pvalue")


@query(
    "conservation_summary",
    with_(
        "",
        """SELECT s.seq, round(avg(score),8) AS mean_score, count(*) AS n_sites, count(*) FILTER (pvalue<0.01) AS n_sig,
           round(100.0*count(*) FILTER (pvalue<0.01)/count(*),6) AS pct_sig FROM pv JOIN site s USING (id) GROUP BY 1""",
        **NULLS,
    ),
)
def conservation_summary_query(t):
    scored = scored_sites(t).join(hourly_sites(t).select("id", "seq"), "id")
    out = rounded(conservation_summary(scored, ["seq"], alpha=0.01), "pct_sig")
    return rounded(out, "mean_score", digits=8)  # means of two-digit decimals end in an exact 5 before that
