"""Intermediate tables in the cluster's shared folder, and ids of task-local rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import materialize, scratch_path, shuffle_width

__all__ = ["arrow_map", "fresh", "join_checked", "materialize", "scratch_path", "shuffle_width", "small_batches"]


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` batch by batch; ``work`` yields small batches so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch; by default 10,000 texts make one, which tasks and their workers each hold several times.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session end at ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: A side that is counted and has at most so many rows, and so many values in its arrays, is broadcast.
BROADCAST_ROWS, BROADCAST_VALUES = 100_000, 1_000_000


def join_checked(wide: DataFrame, narrow: DataFrame, on, how: str = "inner", values: Column | None = None) -> DataFrame:
    """Join with a stored narrow side: broadcast if it is counted as small, else by a shuffle; the rows are the same.

    ``values`` is how many values the arrays of a narrow row hold; without it its columns are single values.
    """
    rows, held = narrow.agg(F.count(F.lit(1)), F.sum(F.lit(0) if values is None else values)).first()
    few = rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_VALUES
    return wide.join(F.broadcast(narrow) if few else narrow, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
