"""Set algebra over ids and over the token sets of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import safe_div
from seriesloom.operators.skew import salted_join
from seriesloom.session import materialize

#: Rows that may meet on a token for each of its rows, and rows of a token that meet in one task.
MEETINGS, HOLDERS = 8, 100_000


def intersect_n(df: DataFrame, sources: int, source: str = "source", key: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """Ids that occur in all ``sources`` lists.

    The pairs are made distinct first; an id then has at most ``sources`` rows.
    """
    seen = df.select(*extra, source, key).distinct()
    return seen.groupBy(*extra, key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == sources).drop("_n")


def exclusive_members(df: DataFrame, reference: str, source: str = "source", key: str = "id") -> DataFrame:
    """Ids of the reference list that no other list holds."""
    is_ref = F.col(source) == reference
    return (
        df.groupBy(key)
        .agg(F.bool_or(is_ref).alias("_in"), F.bool_or(~is_ref).alias("_out"))
        .filter("_in AND NOT _out")
        .select(key)
    )


def venn_regions(df: DataFrame, sources: Sequence[str], source: str = "source", key: str = "id") -> DataFrame:
    """Number of ids per membership pattern: bit i of ``mask`` stands for ``sources[i]``."""
    bit = F.lit(0)
    for i, name in enumerate(sources):
        bit = F.when(F.col(source) == name, 1 << i).otherwise(bit)
    return df.groupBy(key).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def venn_totals(regions: DataFrame, sources: int) -> DataFrame:
    """Set and intersection sizes (n1, n12, ...) from the disjoint regions."""
    aggs = []
    for combo in range(1, 1 << sources):
        name = "n" + "".join(str(i + 1) for i in range(sources) if combo >> i & 1)
        inside = F.col("mask").bitwiseAND(F.lit(combo)) == combo
        aggs.append(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(name))
    return regions.agg(*aggs)


def union_tagged(frames: dict[str, DataFrame], label: str = "cat") -> DataFrame:
    """Stack frames of one schema with their tag."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def token_catalog(sites: DataFrame) -> DataFrame:
    """Distinct (entity, token)."""
    return sites.select("entity", "token").distinct()


def token_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("entity", "token").agg(F.count(F.lit(1)).alias("n_sites"))


def _per_entity(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))


def _shared_rows(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per pair and token that both its entities have, with the other columns of both catalogs.

    ``pairs`` and both catalogs are stored.  All holders of a token meet and those that are a listed
    pair stay, so each catalog is read once however many pairs there are.  Crowded tokens, on which
    many more rows would come out than go in or more than a task should hold, are listed per pair.
    """
    held = [c.groupBy("token").agg(F.count(F.lit(1)).alias(n)) for c, n in ((left, "_l"), (right, "_r"))]
    rows = F.col("_l") + F.col("_r")
    many = F.col("_l").cast("double") * F.col("_r") > MEETINGS * rows
    crowded = materialize(held[0].join(held[1], "token").filter(many | (rows > HOLDERS)).select("token"))
    if crowded.isEmpty():
        return _shared_by_token(pairs, left, right)
    few = [c.join(crowded, "token", "left_anti") for c in (left, right)]
    rest = [materialize(c.join(crowded, "token", "left_semi").select(*c.columns)) for c in (left, right)]
    return _shared_by_token(pairs, *few).unionByName(_shared_by_pair(pairs, *rest))


def _shared_by_token(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    met = left.withColumnRenamed("entity", "a").join(right.withColumnRenamed("entity", "b"), "token")
    return met.join(pairs.select("a", "b"), ["a", "b"])


def _shared_by_pair(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Only the smaller of a pair's two sets is listed; the other one is looked up by (entity, token).

    Catalogs are unique on those, so no pairs form within a token, however common it is, and an
    entity with very many tokens or pairs is salted.
    """
    sizes = [c.groupBy(F.col("entity").alias(k)).agg(F.count(F.lit(1)).alias(f"_{k}")) for c, k in ((left, "a"), (right, "b"))]
    sized = salted_join(pairs, sizes[0], "a", key_counts=_per_entity(pairs, "a"))
    sized = materialize(salted_join(sized, sizes[1], "b", key_counts=_per_entity(pairs, "b")))

    def listed(some: DataFrame, small: DataFrame, large: DataFrame, key: str, other: str) -> DataFrame:
        # The rows to come follow from the stored sizes: a key's own, and the sum of its partners'.
        own = some.groupBy(key).agg(F.any_value(f"_{key}").alias("_n"))
        expanded = some.groupBy(other).agg(F.sum(f"_{key}").alias("_n"))
        tokens = salted_join(small.withColumnRenamed("entity", key), some.select("a", "b"), key, key_counts=own)
        return salted_join(tokens, large.withColumnRenamed("entity", other), [other, "token"], key_counts=expanded)

    by_a = listed(sized.filter("_a <= _b"), left, right, "a", "b")
    return by_a.unionByName(listed(sized.filter("_a > _b"), right, left, "b", "a"))


def shared_tokens(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared and unshared tokens per pair, shares of both sets and the joined list."""
    pairs, left, right = materialize(pairs.select("a", "b").distinct()), materialize(left), materialize(right)
    shared = (
        _shared_rows(pairs, left, right)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.array_sort(F.collect_list("token")).alias("_tokens"))
    )
    size_a = left.groupBy(F.col("entity").alias("a")).agg(F.count(F.lit(1)).alias("size_a"))
    per = salted_join(pairs, size_a, "a", "left", key_counts=_per_entity(pairs, "a")).join(shared, ["a", "b"], "left")
    per = per.na.fill({"size_a": 0, "n_shared": 0}).withColumn("_tokens", F.coalesce("_tokens", F.array().cast(shared.schema["_tokens"].dataType)))
    size_b = right.groupBy(F.col("entity").alias("b")).agg(F.count(F.lit(1)).alias("size_b"))
    out = salted_join(per, size_b, "b", "left", key_counts=_per_entity(pairs, "b"))
    n = F.col("n_shared")
    return out.select(
        "a",
        "b",
        "n_shared",
        (F.col("size_a") - n).alias("n_unshared"),
        F.coalesce(safe_div(n, F.col("size_a")), F.lit(0.0)).alias("prop_a"),
        F.coalesce(safe_div(n, F.col("size_b")), F.lit(0.0)).alias("prop_b"),
        F.array_join(F.transform("_tokens", lambda t: t.cast("string")), ",").alias("tokens"),
    )


def shared_token_counts(pairs: DataFrame, left_sites: DataFrame, right_sites: DataFrame) -> DataFrame:
    """Sites of each shared token on both entities of a pair."""
    pairs = materialize(pairs.select("a", "b").distinct())
    left = materialize(token_counts(left_sites).withColumnRenamed("n_sites", "sites_a"))
    right = materialize(token_counts(right_sites).withColumnRenamed("n_sites", "sites_b"))
    return _shared_rows(pairs, left, right).select("a", "b", "token", "sites_a", "sites_b")


def share_ratios(df: DataFrame) -> DataFrame:
    s, u = F.col("n_shared"), F.col("n_unshared")
    return df.withColumn("ratio_shared", safe_div(s, u)).withColumn("prop_shared", safe_div(s, s + u))


def distinct_tokens_by_group(df: DataFrame, group: str | Sequence[str], token_list: str) -> DataFrame:
    """Distinct tokens per group from a comma-joined list column."""
    group = [group] if isinstance(group, str) else group
    exploded = df.select(*group, F.explode(F.split(F.col(token_list), ",")).alias("token"))
    return exploded.filter("token <> ''").distinct()
