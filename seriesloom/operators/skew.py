"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import shuffle_width



def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; keeps the left side's key columns."""
    on = list(on)
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    salts: int = 8,
    key_counts: DataFrame | None = None,
    nulls_meet: bool = False,
) -> DataFrame:
    """Equi-join that spreads each hot left key over ``salts`` tasks.

    ``right`` is the narrow side.  Without ``key_counts`` every right row is repeated
    once per salt and the left side is read once.  With ``key_counts`` (some or all of
    the columns ``on`` and ``_n``, the left rows per key) only keys that hold more than
    half of a task's even share are salted; there are fewer of them than twice the tasks
    of a shuffle, a bound that makes the list safe to broadcast.  With ``nulls_meet``
    null keys are keys like others.  Adaptive skew splitting still applies on top.
    """
    on = [on] if isinstance(on, str) else list(on)
    # A deterministic salt: a recomputed task must send its rows where it sent them before.
    # The columns beside the key spread it; rows that are nothing but a key, the task they are in.
    rest = [c for c, t in left.dtypes if c not in on and not t.startswith("map")]
    spread = F.pmod(F.xxhash64(*rest) if rest else F.spark_partition_id(), F.lit(salts)).cast("int")
    last = F.lit(salts - 1)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = on + ["_salt"]
        return (null_safe(a, b, keys, how) if nulls_meet else a.join(b, keys, how)).drop("_salt")

    if key_counts is None:
        return met(left.withColumn("_salt", spread), right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))))
    by = [c for c in key_counts.columns if c != "_n"]
    even = key_counts.agg(F.sum("_n") / F.lit(2.0 * shuffle_width(left))).scalar()
    hot = F.broadcast(key_counts.filter(F.col("_n") > even).select(*by, F.lit(True).alias("_hot")))
    flagged = null_safe(left, hot, by, "left"), null_safe(right, hot, by, "left")
    salted_left = flagged[0].withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), last).otherwise(0)
    salted_right = flagged[1].withColumn("_salt", F.explode(F.sequence(F.lit(0), copies))).drop("_hot")
    return met(salted_left, salted_right)
