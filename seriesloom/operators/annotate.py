"""Joins with dimension tables, explicit-order dedupe, zips and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.pairs import dedupe_last
from seriesloom.operators.scan import global_row_number, running


def inner_enrich(pairs: DataFrame, rows: DataFrame, on: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Pairs with the joined rows of one side, then the last row per key."""
    return dedupe_last(pairs.join(rows, on), keys, order)


def symbol_lookup(df: DataFrame, symbols: DataFrame, key: str, out: str = "symbol") -> DataFrame:
    """Symbol of an id, the id itself where none is known.  ``symbols``: id, symbol, one row per id."""
    named = symbols.groupBy(F.col("id").alias(key)).agg(F.max("symbol").alias("_symbol"))
    return df.join(named, key, "left").withColumn(out, F.coalesce("_symbol", F.col(key))).drop("_symbol")


def positional_zip(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Line up row i of ``a`` with row i of ``b`` along an explicit order; rows of the longer side meet nulls."""
    left = global_row_number(a, order, "_i").select("_i", *[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = global_row_number(b, order, "_i").select("_i", *[F.col(c).alias(f"b_{c}") for c in b.columns])
    return left.join(right, "_i", "full").drop("_i")


def concordant_de_join(a: DataFrame, b: DataFrame, alpha: float = 0.01, column: str = "padj") -> DataFrame:
    """Entities significant in both tables with both fold changes, their gap and whether the signs agree."""
    left = a.filter(F.col(column) <= alpha).select("entity", F.col("log2fc").alias("fc_a"))
    right = b.filter(F.col(column) <= alpha).select("entity", F.col("log2fc").alias("fc_b"))
    joined = left.join(right, "entity")
    return joined.withColumns(
        {"diff": F.abs(F.col("fc_a") - F.col("fc_b")), "concordant": F.signum("fc_a") == F.signum("fc_b")}
    )


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, column: str, out: str) -> DataFrame:
    """Last non-null value up to each row; (keys, order) identifies a row."""
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col(order), F.col(column).alias("v")))
    filled = running(df, keys, order, {"_last": ("max", seen)})
    return filled.withColumn(out, F.col("_last.v")).drop("_last")


def split_by_null(df: DataFrame, column: str, alpha: float, null_side: bool) -> DataFrame:
    """Significant rows with (without) a value in ``column``."""
    side = F.col(column).isNull() if null_side else F.col(column).isNotNull()
    return df.filter(side & (F.col("padj") <= alpha))


def top_terms_per_cluster(df: DataFrame, by: str, k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``k`` terms per cluster; ``rank`` 1 is the best."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(k)
