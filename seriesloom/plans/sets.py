"""Set algebra over ids and token sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import sets as S
from seriesloom.operators.expression import classify_direction
from seriesloom.plans.bindings import BY, CONDITIONS, Tables, g_id, l_id, rounded, with_
from seriesloom.plans.expression import DE_CTES, de_table
from seriesloom.plans.registry import query
from seriesloom.plans.tables import SHARED_N, STRONG, strong_pairs, strong_shared
from seriesloom.session import materialize

PARTS_BY_FLAG = "SELECT DISTINCT l_returnflag AS source, l_orderkey AS id FROM lineitem"


def orders_by_flag(t: Tables):
    return t.lineitem.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("id"))


@query("intersect_n", f"SELECT id FROM ({PARTS_BY_FLAG}) GROUP BY 1 HAVING count(*)=3")
def intersect_n(t):
    return S.intersect_n(orders_by_flag(t), 3)


@query(
    "intersect_time_then_condition",
    """WITH c AS (SELECT DISTINCT year(l_shipdate)-1995 AS time, l_returnflag AS f, l_partkey AS id FROM lineitem WHERE year(l_shipdate)-1995 BETWEEN 1 AND 6),
       p AS (SELECT time, id FROM c GROUP BY 1,2 HAVING count(*)=3)
       SELECT p_type AS kind, id FROM (SELECT id FROM p GROUP BY 1 HAVING count(*)=6) JOIN part ON p_partkey=id""",
)
def intersect_time_then_condition(t):
    """Parts seen under all conditions at every time 1..6, with their kind."""
    rows = t.lineitem.select(
        (F.year("l_shipdate") - 1995).alias("time"), F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("id")
    ).filter("time BETWEEN 1 AND 6")
    per_time = S.intersect_n(rows, 3, extra=["time"])
    core = S.intersect_n(per_time, 6, source="time")
    kinds = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return core.join(kinds, "id").select("kind", "id")


@query("exclusive_members", f"SELECT id FROM ({PARTS_BY_FLAG}) GROUP BY 1 HAVING min(source)='A' AND max(source)='A'")
def exclusive_members(t):
    return S.exclusive_members(orders_by_flag(t), "A")


@query(
    "union_distinct_background",
    with_("sites_g sites_l", "SELECT entity FROM sites_g WHERE entity LIKE 'G%' UNION SELECT entity FROM sites_l WHERE entity LIKE 'G%'"),
)
def union_distinct_background(t):
    both = t.site_rows_g.select("entity").union(t.site_rows_l.select("entity"))
    return both.filter(F.col("entity").startswith("G")).distinct()


TAGS = {"1-URGENT": "correlated", "2-HIGH": "proximal", "3-MEDIUM": "anticorrelated", "4-NOT SPECIFIED": "random", "5-LOW": "random"}


def tagged_values(t: Tables):
    """Line quantities tagged by the kind of their order, with a two-level group."""
    rows = t.lineitem.join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = {
        tag: rows.filter(F.col("o_orderpriority").isin([p for p, x in TAGS.items() if x == tag])).select(
            F.col("l_partkey").alias("id"), F.col("l_quantity").alias("value")
        )
        for tag in dict.fromkeys(TAGS.values())
    }
    return S.union_tagged(one).withColumn("group", F.when(F.col("cat") == "random", "random").otherwise("tested"))


def tagged_in_one_pass(t: Tables):
    """The same rows as ``tagged_values``, tagged while the join is read once."""
    rows = t.lineitem.join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cat = F.coalesce(*[F.when(F.col("o_orderpriority") == p, tag) for p, tag in TAGS.items()])
    return rows.select(cat.alias("cat"), F.col("l_quantity").alias("value")).filter("cat IS NOT NULL")


TAGGED = """SELECT l_partkey AS id, l_quantity AS value, CASE o_orderpriority WHEN '1-URGENT' THEN 'correlated' WHEN '2-HIGH' THEN 'proximal'
   WHEN '3-MEDIUM' THEN 'anticorrelated' ELSE 'random' END AS cat,
   CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN 'random' ELSE 'tested' END AS "group" FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""


@query("union_tagged", f'SELECT cat, "group", count(*) AS n, round(sum(value),4) AS total FROM ({TAGGED}) GROUP BY 1,2')
def union_tagged(t):
    out = tagged_values(t).groupBy("cat", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total", digits=4)


@query(
    "union_stat_tables",
    "SELECT DISTINCT l_returnflag AS condition, l_linestatus AS test, CAST(l_quantity AS BIGINT) AS stat FROM lineitem",
)
def union_stat_tables(t):
    """Stat tables per condition stacked, duplicates dropped."""
    tables = [
        t.lineitem.filter(F.col("l_returnflag") == c).select(
            F.lit(c).alias("condition"), F.col("l_linestatus").alias("test"), F.col("l_quantity").cast("long").alias("stat")
        )
        for c in CONDITIONS
    ]
    return tables[0].union(tables[1]).union(tables[2]).distinct()


@query(
    "set_difference",
    "SELECT l_partkey AS id FROM lineitem WHERE l_quantity>=49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount>=0.1",
)
def set_difference(t):
    a = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    b = t.lineitem.filter("l_discount >= 0.1").select(F.col("l_partkey").alias("id"))
    return a.distinct().join(b, "id", "left_anti")


@query(
    "intersect_de_sets",
    with_("expr_g", "SELECT entity FROM de WHERE padj<=0.05 AND entity IN (SELECT 'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0') FROM supplier WHERE s_acctbal>0)", **DE_CTES),
)
def intersect_de_sets(t):
    listed = t.table("supplier").filter("s_acctbal > 0").select(g_id("s_suppkey").alias("entity"))
    return de_table(t).filter("padj <= 0.05").select("entity").join(listed, "entity", "left_semi")


@query(
    "intersect_three_criteria",
    with_(
        "pairs cat_g cat_l",
        """SELECT DISTINCT s.condition, s.a AS entity FROM st s JOIN sh h ON h.a=s.a AND h.b=s.b WHERE h.n_shared>=5 AND s.value>=0.75
           AND s.a IN (SELECT 'L_'||p_brand FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1 HAVING count(*)/sum(l_quantity)*1000>39)""",
        st=STRONG,
        sh=SHARED_N,
    ),
)
def intersect_three_criteria(t):
    """Per condition the brands that are dense, share tokens with a partner and correlate highly with it."""
    listed, shared = strong_shared(t)
    dense = (
        t.lines_with_brand.groupBy(l_id("p_brand").alias("a"))
        .agg((F.count(F.lit(1)) / F.sum("l_quantity") * 1000).alias("density"))
        .filter("density > 39")
    )
    kept = listed.filter("value >= 0.75").join(shared.filter("n_shared >= 5"), ["a", "b"], "left_semi").join(dense, "a", "left_semi")
    return kept.select(*BY, F.col("a").alias("entity")).distinct()


VENN = f"""SELECT mask, count(*) AS n FROM (SELECT id, CAST(bit_or(CASE source WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) AS INTEGER) AS mask
   FROM ({PARTS_BY_FLAG}) GROUP BY 1) GROUP BY 1"""


@query("venn_regions", VENN)
def venn_regions(t):
    return S.venn_regions(orders_by_flag(t), CONDITIONS)


@query(
    "venn_totals",
    "SELECT " + ", ".join(f"CAST(sum(CASE WHEN mask & {c}={c} THEN n ELSE 0 END) AS BIGINT) AS n{name}" for c, name in
                          [(1, "1"), (2, "2"), (3, "12"), (4, "3"), (5, "13"), (6, "23"), (7, "123")]) + f" FROM ({VENN})",
)
def venn_totals(t):
    return S.venn_totals(S.venn_regions(orders_by_flag(t), CONDITIONS), 3)


@query("token_catalog", with_("cat_g", "SELECT entity, token FROM cat_g"))
def token_catalog(t):
    return S.token_catalog(t.site_rows_g)


@query("token_counts", with_("sites_l", "SELECT entity, token, count(*) AS n_sites FROM sites_l GROUP BY 1,2"))
def token_counts(t):
    return S.token_counts(t.site_rows_l)


SHARED_FULL = """SELECT s.condition, s.a, s.b, coalesce(h.n,0) AS n_shared, coalesce(za.n,0)-coalesce(h.n,0) AS n_unshared, coalesce(coalesce(h.n,0)/nullif(za.n,0),0) AS prop_a,
   coalesce(coalesce(h.n,0)/nullif(zb.n,0),0) AS prop_b, coalesce(h.tokens,'') AS tokens FROM st s
   LEFT JOIN (SELECT s.a, s.b, count(*) AS n, string_agg(CAST(x.token AS VARCHAR), ',' ORDER BY x.token) AS tokens FROM (SELECT DISTINCT a, b FROM st) s JOIN cat_l x ON x.entity=s.a
      JOIN cat_g y ON y.entity=s.b AND y.token=x.token GROUP BY 1,2) h ON h.a=s.a AND h.b=s.b
   LEFT JOIN (SELECT entity, count(*) AS n FROM cat_l GROUP BY 1) za ON za.entity=s.a
   LEFT JOIN (SELECT entity, count(*) AS n FROM cat_g GROUP BY 1) zb ON zb.entity=s.b"""


@query(
    "shared_tokens",
    with_(
        "pairs cat_g cat_l",
        "SELECT condition, a, b, n_shared, n_unshared, round(prop_a,6) AS prop_a, round(prop_b,6) AS prop_b, tokens FROM sf",
        st=STRONG,
        sf=SHARED_FULL,
    ),
)
def shared_tokens(t):
    listed, shared = strong_shared(t)
    return rounded(listed.select(*BY, "a", "b").join(shared, ["a", "b"]), "prop_a", "prop_b")


@query(
    "shared_token_counts",
    with_(
        "pairs sites_g sites_l",
        """SELECT s.condition, s.a, s.b, x.token, x.n AS sites_a, y.n AS sites_b FROM st s JOIN (SELECT entity, token, count(*) AS n FROM sites_l GROUP BY 1,2) x ON x.entity=s.a
           JOIN (SELECT entity, token, count(*) AS n FROM sites_g GROUP BY 1,2) y ON y.entity=s.b AND y.token=x.token""",
        st=STRONG,
    ),
)
def shared_token_counts(t):
    listed = materialize(strong_pairs(t))
    counted = S.shared_token_counts(listed, t.site_rows_l, t.site_rows_g)
    return listed.select(*BY, "a", "b").join(counted, ["a", "b"])


BY_DIRECTION = dict(
    st=STRONG,
    sf=SHARED_FULL,
    di="SELECT entity, CASE WHEN padj<=0.05 AND log2fc>0 THEN 'Up' WHEN padj<=0.05 AND log2fc<0 THEN 'Down' ELSE 'NoChange' END AS direction FROM de",
    tk="SELECT DISTINCT condition, direction, unnest(string_split(tokens, ',')) AS token FROM sf JOIN di ON di.entity=sf.b WHERE n_shared>=7",
)


def tokens_by_direction(t: Tables, classified: DataFrame | None = None):
    """Distinct tokens per condition of the pairs and direction of the partner (``classified``, where it is known)."""
    listed, shared = strong_shared(t)
    classified = classify_direction(de_table(t)) if classified is None else classified
    directions = classified.select(F.col("entity").alias("b"), "direction")
    rows = listed.select(*BY, "a", "b").join(shared.filter("n_shared >= 7"), ["a", "b"]).join(directions, "b")
    return S.distinct_tokens_by_group(rows, [*BY, "direction"], "tokens")


@query(
    "distinct_tokens_by_group",
    with_(
        "pairs cat_g cat_l expr_g",
        """SELECT condition, direction, count(*) AS n_tokens FROM tk WHERE token<>'' GROUP BY 1,2 UNION ALL
           SELECT condition, 'both', count(*) FROM (SELECT condition, token FROM tk WHERE direction='Up' AND token<>'' INTERSECT
              SELECT condition, token FROM tk WHERE direction='Down') GROUP BY 1""",
        **DE_CTES,
        **BY_DIRECTION,
    ),
)
def distinct_tokens_by_group(t):
    """Distinct shared tokens per condition and direction of the partner, and those of Up and Down alike."""
    tokens = materialize(tokens_by_direction(t))
    per = tokens.groupBy(*BY, "direction").agg(F.count(F.lit(1)).alias("n_tokens"))
    common = S.intersect_n(tokens.filter("direction IN ('Up', 'Down')"), 2, "direction", "token", extra=BY)
    both = common.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_tokens"))
    return per.unionByName(both.select(*BY, F.lit("both").alias("direction"), "n_tokens"))
