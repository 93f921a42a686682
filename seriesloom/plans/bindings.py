"""The neutral data model read from the given tables, in Spark and as oracle CTEs.

=============  ==================================================================
expr_g         replicated series: supplier x return flag x year x line number
expr_l         the same for part brands
catalog_g/_l   tokens (part keys) per supplier / brand
iv             events as intervals: user, epoch second, value * 600 s
sites          lineitem rows as sites of a token on a supplier or brand
reads          lineitem rows as read pairs named by their order
=============  ==================================================================
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMES = list(range(7))
CONDITIONS = ["A", "N", "R"]
#: Pairs, profiles and clusters belong to a condition.
BY = ["condition"]
FIRST_YEAR = 1995


def g_id(col: str) -> Column:
    return F.concat(F.lit("G"), F.lpad(F.col(col).cast("string"), 7, "0"))


def l_id(col: str) -> Column:
    return F.concat(F.lit("L_"), F.col(col))


def epoch_seconds(col: str) -> Column:
    """Whole seconds since 1970, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))


def day_number(col: str) -> Column:
    """Days since 1995-01-01."""
    return F.datediff(F.col(col).cast("date"), F.lit("1995-01-01").cast("date")).cast("long")


class Tables:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def part(self) -> DataFrame:
        return self.table("part")

    @cached_property
    def lines_with_brand(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))

    def _expression(self, rows: DataFrame, key: str, entity: Column) -> DataFrame:
        """Cells grouped by the raw key; ids are formatted once per cell."""
        cells = rows.groupBy(
            key,
            F.col("l_returnflag").alias("condition"),
            (F.year("l_shipdate") - FIRST_YEAR).alias("time"),
            F.col("l_linenumber").alias("replicate"),
        ).agg(F.avg("l_quantity").alias("value"))
        return cells.select(entity.alias("entity"), "condition", "time", "replicate", "value")

    @cached_property
    def expr_g(self) -> DataFrame:
        return self._expression(self.lineitem, "l_suppkey", g_id("l_suppkey"))

    @cached_property
    def effects(self) -> DataFrame:
        """Replicated quantities per supplier under conditions that matter: classes of quantity, turned by supplier.

        One supplier in four has its return flags for conditions, which do not matter.
        """
        size = F.when(F.col("l_quantity") <= 17, 0).when(F.col("l_quantity") <= 34, 1).otherwise(2)
        turned = F.get(F.array(*map(F.lit, CONDITIONS)), F.pmod(size + F.col("l_suppkey"), F.lit(3)).cast("int"))
        condition = F.when(F.col("l_suppkey") % 4 == 3, F.col("l_returnflag")).otherwise(turned)
        cells = self.lineitem.groupBy(
            "l_suppkey", condition.alias("condition"), (F.year("l_shipdate") - FIRST_YEAR).alias("time"), F.col("l_linenumber").alias("replicate")
        ).agg(F.avg("l_quantity").alias("value"))
        return cells.select(g_id("l_suppkey").alias("entity"), "condition", "time", "replicate", "value")

    @cached_property
    def expr_l(self) -> DataFrame:
        return self._expression(self.lines_with_brand, "p_brand", l_id("p_brand"))

    def mean_g(self, condition: str | None = None) -> DataFrame:
        return self._mean(self.expr_g, condition)

    def mean_l(self, condition: str | None = None) -> DataFrame:
        return self._mean(self.expr_l, condition)

    def _mean(self, df: DataFrame, condition: str | None) -> DataFrame:
        from seriesloom.operators.expression import replicate_mean

        if condition:
            df = df.filter(F.col("condition") == condition)
        return replicate_mean(df)

    @cached_property
    def counts(self) -> DataFrame:
        """Entity x sample counts; a sample is a condition at a time."""
        cells = self.lineitem.groupBy("l_suppkey", "l_returnflag", (F.year("l_shipdate") - FIRST_YEAR).alias("time")).agg(
            F.sum("l_quantity").alias("count")
        )
        sample = F.concat_ws(".", F.col("l_returnflag"), F.col("time").cast("string"))
        return cells.select(g_id("l_suppkey").alias("entity"), sample.alias("sample"), "count")

    @cached_property
    def site_rows_g(self) -> DataFrame:
        return self.lineitem.select(g_id("l_suppkey").alias("entity"), F.col("l_partkey").alias("token"))

    @cached_property
    def site_rows_l(self) -> DataFrame:
        return self.lines_with_brand.select(l_id("p_brand").alias("entity"), F.col("l_partkey").alias("token"))

    @cached_property
    def iv(self) -> DataFrame:
        start = epoch_seconds("ts").cast("long")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("chr"), F.col("user_id").cast("string")).alias("seq"),
            start.alias("start"),
            (start + F.floor(F.col("value") * 600).cast("long")).alias("end"),
            F.col("event_type").alias("feature"),
            F.when(F.col("event_type").isin("click", "purchase", "signup"), "+").otherwise("-").alias("strand"),
            "value",
        )

    def features(self, kind: str) -> DataFrame:
        return self.iv.filter(F.col("feature") == kind)

    @cached_property
    def reads(self) -> DataFrame:
        start = day_number("l_shipdate")
        return self.lineitem.select(
            F.col("l_orderkey").alias("qname"),
            F.lit("locus").alias("seq"),
            start.alias("start"),
            (start + F.col("l_quantity").cast("long")).alias("end"),
            F.when(F.col("l_linestatus") == "O", True).otherwise(False).alias("is_reverse"),
        )

    def segments(self, kind: str) -> DataFrame:
        """Locus segments named by brand: parts of one type, at their price in days."""
        start = F.floor("p_retailprice").cast("long")
        return self.part.filter(F.col("p_type") == kind).select(
            F.col("p_partkey").alias("id"),
            F.lit("locus").alias("seq"),
            start.alias("start"),
            (start + F.col("p_size")).alias("end"),
            F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("transcript_name"),
        )


G = "'G'||lpad(CAST(l_suppkey AS VARCHAR),7,'0')"
L = "'L_'||p_brand"
YEAR = "CAST(year(l_shipdate)-1995 AS INTEGER)"

# name -> (names it needs, definition); composed by ``with_``.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "expr_g": ((), f"SELECT {G} AS entity, l_returnflag AS condition, {YEAR} AS time, l_linenumber AS replicate, "
               "avg(l_quantity) AS value FROM lineitem GROUP BY 1,2,3,4"),
    "expr_l": ((), f"SELECT {L} AS entity, l_returnflag AS condition, {YEAR} AS time, l_linenumber AS replicate, "
               "avg(l_quantity) AS value FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4"),
    "mean_g": (("expr_g",), "SELECT entity, condition, time, avg(value) AS value FROM expr_g GROUP BY 1,2,3"),
    "mean_l": (("expr_l",), "SELECT entity, condition, time, avg(value) AS value FROM expr_l GROUP BY 1,2,3"),
    # z-scored series per condition; n tells whether they are complete over all seven times
    "z_g": (("mean_g",), """SELECT entity, condition, time, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z,
              value, count(*) OVER w AS n FROM mean_g WINDOW w AS (PARTITION BY entity, condition)"""),
    "z_l": (("mean_l",), """SELECT entity, condition, time, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z,
              value, count(*) OVER w AS n FROM mean_l WINDOW w AS (PARTITION BY entity, condition)"""),
    "pairs": (("z_g", "z_l"), """SELECT l.condition, l.entity AS l_id, g.entity AS g_id, sum(l.z*g.z)/7 AS value
              FROM z_l l JOIN z_g g ON l.time=g.time AND l.condition=g.condition WHERE l.n=7 AND g.n=7 AND l.z IS NOT NULL AND g.z IS NOT NULL
              GROUP BY 1,2,3"""),
    "d_g": (("mean_g",), """SELECT * FROM (SELECT entity, condition, time, lead(value) OVER w - value AS d, count(*) OVER (PARTITION BY entity, condition) AS n
              FROM mean_g WINDOW w AS (PARTITION BY entity, condition ORDER BY time)) WHERE d IS NOT NULL AND n=7"""),
    "d_l": (("mean_l",), """SELECT * FROM (SELECT entity, condition, time, lead(value) OVER w - value AS d, count(*) OVER (PARTITION BY entity, condition) AS n
              FROM mean_l WINDOW w AS (PARTITION BY entity, condition ORDER BY time)) WHERE d IS NOT NULL AND n=7"""),
    "counts": ((), f"SELECT {G} AS entity, l_returnflag||'.'||CAST({YEAR} AS VARCHAR) AS sample, "
               "sum(l_quantity) AS count FROM lineitem GROUP BY 1,2"),
    "sites_g": ((), f"SELECT {G} AS entity, l_partkey AS token FROM lineitem"),
    "sites_l": ((), f"SELECT {L} AS entity, l_partkey AS token FROM lineitem JOIN part ON l_partkey=p_partkey"),
    "cat_g": (("sites_g",), "SELECT DISTINCT entity, token FROM sites_g"),
    "cat_l": (("sites_l",), "SELECT DISTINCT entity, token FROM sites_l"),
    "iv": ((), """SELECT event_id AS id, 'chr'||CAST(user_id AS VARCHAR) AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS start,
            CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value*600) AS BIGINT) AS "end", event_type AS feature,
            CASE WHEN event_type IN ('click','purchase','signup') THEN '+' ELSE '-' END AS strand, value FROM events"""),
    "reads": ((), """SELECT l_orderkey AS qname, 'locus' AS seq, s AS start, s + CAST(l_quantity AS BIGINT) AS "end",
            l_linestatus='O' AS is_reverse FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s FROM lineitem)"""),
    "seg": ((), """SELECT p_partkey AS id, 'locus' AS seq, CAST(floor(p_retailprice) AS BIGINT) AS start,
            CAST(floor(p_retailprice) AS BIGINT)+p_size AS "end", p_brand||'-'||CAST(p_partkey AS VARCHAR) AS transcript_name,
            p_brand AS symbol, p_type FROM part"""),
}


def with_(names: str, body: str, **extra: str) -> str:
    """Oracle SQL: the named CTEs with all they need, further CTEs, then ``body``."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            need(dep)
        done.append(name)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in done] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round reported doubles: engines add numbers in different orders."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Entities with clusters, classes and places, again in Spark and as CTEs.


def g_clusters(t: Tables) -> DataFrame:
    """Suppliers by nation."""
    return t.table("supplier").select(
        g_id("s_suppkey").alias("entity"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("cluster")
    )


def l_clusters(t: Tables) -> DataFrame:
    """Brands by the last digit of their number."""
    return t.part.select("p_brand").distinct().select(
        l_id("p_brand").alias("entity"), F.concat(F.lit("M"), F.right("p_brand", F.lit(1))).alias("cluster")
    )


def l_classes(t: Tables) -> DataFrame:
    """Brands with a class, an exon status and a length, from the sizes of their parts."""
    return (
        t.part.groupBy(l_id("p_brand").alias("entity"))
        .agg(F.sum("p_size").alias("length"), F.avg("p_size").alias("m"))
        .select(
            "entity",
            "length",
            F.when(F.col("m") >= 25, "intergenic").otherwise("antisense").alias("class"),
            F.when(F.col("length") >= 1900, "m").otherwise("s").alias("exon_status"),
        )
    )


def g_places(t: Tables) -> DataFrame:
    start = F.floor("s_acctbal").cast("long") + 1000
    return t.table("supplier").select(
        g_id("s_suppkey").alias("id"), F.lit("locus").alias("seq"), start.alias("start"), (start + 50).alias("end")
    )


def l_places(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    return t.part.groupBy(l_id("p_brand").alias("id"), (number * 400).alias("start")).agg(
        F.count(F.lit(1)).alias("_n")
    ).select("id", F.lit("locus").alias("seq"), "start", (F.col("start") + F.col("_n")).alias("end"))


CTES.update({
    "clu_g": ((), "SELECT 'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0') AS entity, 'N'||CAST(s_nationkey AS VARCHAR) AS cluster FROM supplier"),
    "clu_l": ((), "SELECT DISTINCT 'L_'||p_brand AS entity, 'M'||right(p_brand,1) AS cluster FROM part"),
    "class_l": ((), """SELECT 'L_'||p_brand AS entity, CAST(sum(p_size) AS BIGINT) AS length,
        CASE WHEN avg(p_size)>=25 THEN 'intergenic' ELSE 'antisense' END AS class,
        CASE WHEN sum(p_size)>=1900 THEN 'm' ELSE 's' END AS exon_status FROM part GROUP BY p_brand"""),
    "place_g": ((), """SELECT 'G'||lpad(CAST(s_suppkey AS VARCHAR),7,'0') AS id, 'locus' AS seq,
        CAST(floor(s_acctbal) AS BIGINT)+1000 AS start, CAST(floor(s_acctbal) AS BIGINT)+1050 AS "end" FROM supplier"""),
    "place_l": ((), """SELECT 'L_'||p_brand AS id, 'locus' AS seq, CAST(regexp_extract(p_brand,'(\\d+)$',1) AS BIGINT)*400 AS start,
        CAST(regexp_extract(p_brand,'(\\d+)$',1) AS BIGINT)*400+count(*) AS "end" FROM part GROUP BY p_brand"""),
    "prof_g": (("mean_g", "clu_g"), """SELECT condition, cluster, time, avg(value) AS value FROM mean_g JOIN clu_g USING(entity)
        GROUP BY 1,2,3"""),
    "prof_l": (("mean_l", "clu_l"), """SELECT condition, cluster, time, avg(value) AS value FROM mean_l JOIN clu_l USING(entity)
        GROUP BY 1,2,3"""),
    "cpairs": (("prof_g", "prof_l"), """SELECT l.condition, l.cluster AS set1, g.cluster AS set2, corr(l.value,g.value) AS value
        FROM prof_l l JOIN prof_g g ON l.time=g.time AND l.condition=g.condition GROUP BY 1,2,3"""),
})
