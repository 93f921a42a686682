"""Near-equal vectors by collision counting on one-dimensional projections.

Every vector is projected on ``PROJECTIONS`` random directions.  For two unit vectors at
distance d the difference of a projection is normal with deviation d, so the chance that one
falls into a window centred at the other is known exactly, and with it the count of
collisions that pairs of the least similarity reach with a wanted recall.  The first few
projections, sorted and cut into slabs of a window's width, bring together the vectors that
can collide there; collisions on all projections are counted tile by tile, and pairs with
the count are verified by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import connected_components, node_ids
from seriesloom.llm.store import materialize, shuffle_width

#: Projections counted, and how many deviations a window is wide to either side.
PROJECTIONS, WINDOW = 24, 1.5
#: Deviations of the wider windows of the projections that slabs are cut along.
SLAB = 3.0
#: Projections that slabs may be cut along at most.
MAX_SLABS = 8
#: The chance to reach the count that is asked of pairs of the least similarity.
RECALL = 0.995
#: Vectors of a tile on average.
TILE_ROWS = 1024
#: Vectors of a label for which one more projection cuts slabs.
SLAB_ROWS = 20_000


class Plan(NamedTuple):
    similarity: float
    window: float  # of the counted projections
    width: float  # of slabs
    needed: int  # collisions


def collisions_needed(similarity: float, recall: float = RECALL) -> Plan:
    """Windows and count for pairs of ``similarity``: the count a share ``recall`` of them reaches; closer pairs do oftener."""
    distance = math.sqrt(max(2 - 2 * similarity, 1e-12))
    p = math.erf(WINDOW / math.sqrt(2))
    chance = [math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k) for k in range(PROJECTIONS + 1)]
    needed = max(k for k in range(PROJECTIONS + 1) if sum(chance[k:]) >= recall)
    return Plan(similarity, WINDOW * distance, SLAB * distance, needed)


def directions(dimensions: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, PROJECTIONS))


def projected(vectors: DataFrame, plan: Plan) -> DataFrame:
    """``node, vec_id, label, size, unit, slabs`` of ``vectors(vec_id, label, embedding)``, stored.

    ``unit`` is the normalised vector as doubles in bytes; null where the vector or label is
    null, zero, empty or holds null or non-finite components.
    """
    schema = "node bigint, vec_id bigint, label bigint, size int, unit binary, slabs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, known = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            ids, labels = (batch.column(c) for c in ("vec_id", "label"))
            whole = batch.column("embedding")
            at, values = whole.offsets.to_numpy(), whole.values.cast(pa.float64())
            odd = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            values = values.to_numpy(zero_copy_only=False)
            usable = whole.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            sizes, units, slabs = [], [], []
            for i in range(batch.num_rows):
                a, b = at[i], at[i + 1]
                unit = unit_vector(values[a:b]) if usable[i] and odd[a] == odd[b] else None
                sizes.append(0 if unit is None else len(unit))
                units.append(None if unit is None else unit.tobytes())
                if unit is not None and len(unit) not in known:
                    known[len(unit)] = directions(len(unit))[:, :MAX_SLABS]
                slabs.append(None if unit is None else np.floor(unit @ known[len(unit)] / plan.width).astype(np.int32).tolist())
            columns = [pa.array(node_ids(task, seen, len(sizes))), ids, labels, pa.array(sizes, pa.int32())]
            columns += [pa.array(units, pa.binary()), pa.array(slabs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "vec_id", "label", "size", "unit", "slabs"])
            seen += len(sizes)

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    return materialize(rows.mapInArrow(run, schema))


def unit_vector(x: np.ndarray) -> np.ndarray | None:
    """The vector at length one in double precision, or None where it has no direction."""
    if not len(x):
        return None
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def link_parts(stored: DataFrame, plan: Plan) -> DataFrame:
    """``node, links, other``: links counted tile by tile, and for each tile links that connect what it connects.

    ``stored`` has distinct vectors with their ``copies``.
    """
    sizes = stored.groupBy("label", "size").agg(F.count(F.lit(1)).alias("_n"))
    # One projection more per factor of SLAB_ROWS; the wide windows lose almost none either way.
    along = F.least(F.lit(MAX_SLABS), F.greatest(F.lit(1), F.ceil(F.log(F.col("_n") / SLAB_ROWS) / F.log(F.lit(4.0))) + 1)).cast("int")
    rows = stored.join(sizes.select("label", "size", along.alias("_along")), ["label", "size"])
    cell = F.slice("slabs", F.lit(1), F.col("_along"))
    rows = rows.withColumn("cell", cell)
    cells = rows.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("label", "size", "cell", F.ceil(F.col("_n") / TILE_ROWS).cast("int").alias("tiles"))
    cells = materialize(cells)
    # A vector meets its own cell and, of every pair of neighbouring cells, the tiles of the other one.
    shifts = F.transform(F.sequence(F.lit(0), F.pow(F.lit(3), F.size("cell")).cast("int") - 1), lambda k: F.transform(
        F.sequence(F.lit(0), F.size("cell") - 1), lambda i: F.pmod(F.floor(k / F.pow(F.lit(3), i)).cast("int"), F.lit(3)) - 1
    ))
    near = cells.withColumn("_shift", F.explode(shifts)).select(
        "label", "size", "cell", "tiles", F.zip_with("cell", "_shift", lambda a, b: a + b).alias("beside")
    )
    other = cells.select("label", "size", F.col("cell").alias("beside"), F.col("tiles").alias("there"))
    near = near.join(other, ["label", "size", "beside"])
    own = F.struct(F.col("cell").alias("c"), F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("t"))
    met = rows.join(near, ["label", "size", "cell"]).withColumn("_own", own)
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
    met = met.withColumn("_other", F.struct(F.col("beside").alias("c"), F.col("_other").alias("t")))
    dealt = met.select(
        "label", "size", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"),
        F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).alias("side"),
        "node", "copies", "unit",
    )
    dealt = dealt.withColumn("tile", F.xxhash64("label", "size", "low", "high")).select("tile", "label", "size", "low", "high", "side", "node", "copies", "unit")
    dealt = dealt.repartition(shuffle_width(stored), "tile").sortWithinPartitions("tile", "label", "size", "low", "high", "side", "node")
    names = ["label", "size", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            sides, nodes, copies = (batch.column(c).to_pylist() for c in ("side", "node", "copies"))
            units = batch.column("unit")
            for i, k in enumerate(keys):
                if k != key:
                    yield from _count(held, plan)
                    key, held = k, []
                held.append((sides[i], nodes[i], copies[i], np.frombuffer(units[i].as_py())))
        yield from _count(held, plan)

    return dealt.mapInArrow(run, "node bigint, links bigint, other bigint")


def _count(held: list[tuple], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Links of one tile with itself (side 2) or between its two sides."""
    if len(held) < 2:
        return
    sides = np.array([h[0] for h in held])
    nodes, copies = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2))
    units = np.array([h[3] for h in held])
    lines = units @ directions(units.shape[1])
    if sides[0] == 2:
        left = right = np.arange(len(held))
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(left) or not len(right):
            return
    links, roots = np.zeros(len(held), dtype=np.int64), np.arange(len(held))
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        hits = np.zeros((len(some), len(right)), dtype=np.int8)
        for k in range(PROJECTIONS):
            hits += np.abs(lines[some, k][:, None] - lines[right, k][None, :]) <= plan.window
        for i, row in zip(some.tolist(), hits >= plan.needed):
            near = right[row]
            near = near[near != i]
            near = near[units[near] @ units[i] >= plan.similarity]
            if not len(near):
                continue
            links[i] += copies[near].sum()
            if sides[0] != 2:
                links[near] += copies[i]
            if (roots[near] != roots[i]).any():
                met = np.unique(np.append(roots[near], roots[i]))
                roots[np.isin(roots, met)] = met[0]
    found = links > 0
    if found.any():
        yield pa.record_batch([pa.array(nodes[found]), pa.array(links[found]), pa.array(nodes[roots[found]])], ["node", "links", "other"])


def near_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, label, embedding)``.

    Rows of equal labels link where their cosine in double precision is ``similarity`` or more;
    none below it ever links, and at that similarity a pair is found with about the chance
    ``RECALL``, closer ones more surely.  Vectors or labels that are null, and vectors that are
    empty, zero or hold null or non-finite components, link with nothing, and vectors of
    different length do not link.  Equal vectors are compared once.  ``component_id`` is the
    smallest vec_id reachable; rows that share a vec_id are rows of their own; other columns are
    ignored.
    """
    plan = collisions_needed(similarity)
    stored = projected(vectors, plan)
    classes = stored.filter("unit IS NOT NULL").groupBy("label", "size", "unit").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.any_value("slabs").alias("slabs")
    )
    classes = materialize(classes)
    parts = materialize(link_parts(classes, plan))
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    found = connected_components(parts.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("label", "size", "unit", "node", "copies", "first").join(found, "node", "left").join(counts, "node", "left")
    named = materialize(
        named.select(
            "label", "size", "unit", "first", F.coalesce("component", "node").alias("component"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("label", "size", "unit", "n_links", "component_id")
    rows = stored.select("vec_id", "label", "size", "unit").join(named, ["label", "size", "unit"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
