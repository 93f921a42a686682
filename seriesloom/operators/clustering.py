"""Agreement of clusterings and threshold clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import safe_div
from seriesloom.operators.pairs import block_pairs
from seriesloom.operators.skew import salted_join
from seriesloom.session import materialize, shuffle_width

#: Members of a class in a list on average at most, and the lists of a class on the left that meet one copy of it on the right.
LIST = 64
#: Pairs that a task deals out on average.
PAIRS_A_TASK = 4_000_000


def concordance(df: DataFrame) -> DataFrame:
    """Pair counts and agreement measures for every pair of clusterings.

    ``df`` has clustering, entity and cluster.  Pairs include an entity with itself, so
    the counts a + b + c + d add up to n(n+1)/2.  They follow from the sizes of clusters
    and of their intersections; no entity pair is formed.
    """
    first = df.select(F.col("clustering").alias("c1"), "entity", F.col("cluster").alias("k1"))
    second = df.select(F.col("clustering").alias("c2"), "entity", F.col("cluster").alias("k2"))
    cells = (
        first.join(second, "entity").filter("c1 < c2").groupBy("c1", "c2", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    )

    def pairs(n):
        return F.sum(n.cast("decimal(19,0)") * (n + 1).cast("decimal(19,0)") / 2).cast("double")

    by = ["c1", "c2"]
    both = cells.groupBy(*by).agg(pairs(F.col("n")).alias("a"), F.sum("n").alias("n"))
    rows = cells.groupBy(*by, "k1").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(F.col("n")).alias("same1"))
    cols = cells.groupBy(*by, "k2").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(F.col("n")).alias("same2"))
    t = both.join(rows, by).join(cols, by)
    t = t.withColumn("c", F.col("same1") - F.col("a")).withColumn("d", F.col("same2") - F.col("a"))
    n = F.col("n").cast("double")
    t = t.withColumn("b", n * (n + 1.0) / 2.0 - F.col("a") - F.col("c") - F.col("d"))
    return concordance_metrics(t.select(*by, "a", "b", "c", "d"))


def concordance_metrics(df: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in "abcd")
    precision, recall = safe_div(a, a + c), safe_div(a, a + d)
    return df.withColumns(
        {
            "rand": safe_div(a + b, a + b + c + d),
            "adj_rand": safe_div(2 * (a * b - c * d), (a + d) * (d + b) + (a + c) * (c + b)),
            "precision": precision,
            "recall": recall,
            "f1": safe_div(2 * precision * recall, precision + recall),
            "jaccard": safe_div(a, a + c + d),
        }
    )


def _label_arrays(df: DataFrame, iterations: Sequence) -> DataFrame:
    """``entity, labels``: the labels of every entity as one short array."""
    cells = [F.max(F.when(F.col("iteration") == it, F.col("cluster"))).alias(f"_{i}") for i, it in enumerate(iterations)]
    return df.groupBy("entity").agg(*cells).select("entity", F.array(*[F.col(f"_{i}") for i in range(len(iterations))]).alias("labels"))


def _needed(iterations: Sequence, min_fraction: float | None) -> int:
    return 0 if min_fraction is None else math.ceil(min_fraction * len(iterations) - 1e-9)


def _agreeing(labels: DataFrame, needed: int) -> tuple[DataFrame, DataFrame]:
    """(entities that agree with themselves, their classes ``labels, representative, _n``): a class has equal labels."""
    kept = labels.filter((F.size(F.filter("labels", lambda v: v.isNotNull())) >= needed) & F.col("entity").isNotNull())
    return kept, materialize(kept.groupBy("labels").agg(F.min("entity").alias("representative"), F.count(F.lit(1)).alias("_n")))


def agreement_classes(df: DataFrame, iterations: Sequence, min_fraction: float) -> DataFrame:
    """``entity, representative``: entities of equal labels go by the smallest one of them.

    An entity with too few labels to agree with itself is a class of its own.
    """
    labels, needed = materialize(_label_arrays(df, iterations)), _needed(iterations, min_fraction)
    kept, classes = _agreeing(labels, needed)
    sized = classes.select("labels", "_n")
    found = salted_join(kept, classes.drop("_n"), "labels", key_counts=sized, nulls_meet=True).select("entity", "representative")
    others = labels.join(kept.select("entity"), "entity", "left_anti")
    return found.unionByName(others.select("entity", F.col("entity").alias("representative")))


def co_occurrence(df: DataFrame, iterations: Sequence, min_fraction: float | None = None, representatives: bool = False) -> DataFrame:
    """Share of iterations in which two entities fall into one cluster (a <= b).

    Entities carry their labels as one short array.  Without a least share all pairs meet on a grid
    of blocks, since all of them are the result.  With one, entities may differ in so many iterations
    at most; the iterations are cut into one group more than that, and by the pigeonhole
    principle a pair agrees throughout some group.  So labels meet by those of a group, on a grid
    of their own for every such key, and a pair counts at the first group it agrees in.  Entities of equal
    labels are compared once, by their representative, and then dealt out to pairs in lists; with
    ``representatives`` (of ``agreement_classes``) only the pairs of these are given.
    """
    n, needed = len(iterations), _needed(iterations, min_fraction)
    labels = _label_arrays(df, iterations)
    equal = [F.coalesce(F.col("a_labels")[i] == F.col("b_labels")[i], F.lit(False)) for i in range(n)]
    share = (sum((F.when(e, 1).otherwise(0) for e in equal), F.lit(0)) / F.lit(n)).alias("fraction")
    pair = [F.col("a_entity").alias("a"), F.col("b_entity").alias("b")]
    if needed <= 0:
        return block_pairs(labels, labels, "entity", same=True).select(*pair, share)
    if needed > n:
        return block_pairs(labels.filter("false"), labels, "entity", same=True).select(*pair, share)
    kept, classes = _agreeing(labels if representatives else materialize(labels), needed)
    groups = [list(g) for g in np.array_split(np.arange(n), n - needed + 1)]
    keys = [F.struct(F.lit(k).alias("_group"), F.array(*[F.col("labels")[int(i)].cast("string") for i in g]).alias("_same")) for k, g in enumerate(groups)]
    listed = classes.select(F.col("representative").alias("entity"), "labels", F.inline(F.array(*keys)))
    filed = listed.filter(~F.exists("_same", lambda x: x.isNull()))
    met = block_pairs(filed, filed, "entity", same=True, by=["_group", "_same"])
    first = F.lit(None).cast("int")
    for k in reversed(range(len(groups))):
        agrees = F.lit(True)
        for i in groups[k]:
            agrees = agrees & equal[int(i)]
        first = F.when(agrees, k).otherwise(first)
    scored = met.filter(first == F.col("_group")).select(*pair, share)
    found = scored.filter(F.col("fraction") >= needed / n - 1e-9)
    return found if representatives else _dealt_out(found, kept, classes)


def _dealt_out(pairs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b, fraction`` of all members of the classes that ``pairs`` of representatives join.

    Members come in lists of bounded size.  A class on the right is repeated for every so many lists that meet it,
    so neither a large class nor one with many partners ends up in one task.
    """
    pairs, sized = materialize(pairs), classes.select("labels", "_n")
    known = salted_join(members, classes, "labels", key_counts=sized, nulls_meet=True)
    part = F.pmod(F.xxhash64("entity"), F.ceil(F.col("_n") / LIST)).cast("int")
    lists = known.groupBy("representative", part.alias("_part")).agg(F.collect_list("entity").alias("_list"))
    lists = materialize(lists)
    left = lists.select(F.col("representative").alias("a"), F.col("_part").alias("_i"), F.col("_list").alias("_x"))
    met = salted_join(pairs, left, "a", key_counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")))
    met = materialize(met)
    salts = materialize(met.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_salts")))
    right = salted_join(lists.select(F.col("representative").alias("b"), F.col("_list").alias("_y")), salts, "b")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    met = salted_join(met, salts, "b").withColumn("_salt", F.pmod(F.xxhash64("a", "_i"), F.col("_salts")).cast("int")).drop("_salts")
    # Lists go in and pairs come out: the tasks follow the pairs.
    sizes = classes.select("representative", "_n")
    count = pairs.join(sizes.toDF("a", "_a"), "a").join(sizes.toDF("b", "_b"), "b").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 1
    tasks, on = max(shuffle_width(pairs), count // PAIRS_A_TASK), ["b", "_salt"]
    dealt = met.repartition(tasks, *on).join(right.repartition(tasks, *on), on)
    rows = dealt.select((F.col("a") == F.col("b")).alias("_own"), "fraction", "_y", F.explode("_x").alias("_l")).select("_own", "fraction", "_l", F.explode("_y").alias("_r"))
    rows = rows.filter(~F.col("_own") | (F.col("_l") <= F.col("_r")))
    return rows.select(F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"), "fraction")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable id per node: ``entity, component``.

    Every round takes the smallest label among the neighbours and then follows labels
    one step further (pointer jumping), so the number of rounds grows with the logarithm
    of the longest chain.  Labels are checkpointed per round in the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    degrees = materialize(both.groupBy("v").agg(F.count(F.lit(1)).alias("_n")))
    labels = nodes.select(F.col("entity").alias("v"), F.col("entity").alias("label"))
    while True:
        near = (
            salted_join(both, labels, "v", key_counts=degrees)
            .groupBy("u")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("u", "v")
        )
        step = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step)
        parent = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        holders = step.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        jumped = salted_join(step, parent, "label", "left", key_counts=holders).select("v", "old", F.least("label", "up").alias("label"))
        jumped = materialize(jumped)
        labels = jumped.select("v", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels.select(F.col("v").alias("entity"), F.col("label").alias("component"))


def threshold_clusters(
    pairs: DataFrame, nodes: DataFrame, cut: float, min_size: int = 30, by: Sequence[str] = (), members: DataFrame | None = None
) -> DataFrame:
    """Single-linkage clusters at distance ``cut``, per value of ``by``; clusters below ``min_size`` become '0'.

    With ``members`` (``entity, representative``, the smallest of a class) the pairs are those of representatives,
    and every entity goes where its representative does.
    """
    by = list(by)
    near = pairs.filter(F.col("distance") <= cut)
    if by:  # an entity under another value of ``by`` is another node
        node = lambda c: F.struct(*by, F.col(c).alias("entity"))
        near, nodes = near.select(node("a").alias("a"), node("b").alias("b")), nodes.select(node("entity").alias("entity"))
        members = members and members.select(node("entity").alias("entity"), node("representative").alias("representative"))
    if members is None:
        comp = connected_components(near, nodes)
    else:
        members = materialize(nodes.join(members, "entity"))
        sized = members.groupBy("representative").agg(F.count(F.lit(1)).alias("_n"))
        comp = connected_components(near, sized.select(F.col("representative").alias("entity")))
        comp = salted_join(members, comp.withColumnRenamed("entity", "representative"), "representative", key_counts=sized).drop("representative")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    out = salted_join(comp, sizes, "component", key_counts=sizes.withColumnRenamed("size", "_n"))
    label = F.col("component.entity") if by else F.col("component")
    own = [F.col(f"entity.{c}").alias(c) for c in [*by, "entity"]] if by else ["entity"]
    return out.select(*own, F.when(F.col("size") >= min_size, label).otherwise("0").alias("cluster"))
